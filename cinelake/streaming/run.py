"""Running a stateful stream over the files present now, into a Parquet folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from cinelake.session import shared_dir

PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """State kept in RocksDB, which the stateful operators need; the session's choice is put back."""
    before = spark.conf.get(PROVIDER_KEY, None)
    spark.conf.set(PROVIDER_KEY, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER_KEY)
        else:
            spark.conf.set(PROVIDER_KEY, before)


def drain(stream: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Process everything available, with checkpoint and output in the shared folder; returns the output.

    With the ``base`` folder of an earlier run it goes on with its state, from what has come since. For streams without timers: one whose timers keep firing never counts as drained.
    """
    spark = stream.sparkSession
    base = base or shared_dir(spark, name)
    with rocksdb_state(spark):
        query = (
            stream.writeStream.format("parquet")
            .option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
