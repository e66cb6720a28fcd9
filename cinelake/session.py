"""Session defaults for running the library on its own."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cinelake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, prefix: str) -> str:
    """A fresh folder for data that must outlive an executor.

    It lies in the folder the cluster names in ``spark.checkpoint.dir``, whose owner decides how long it
    stays. Only a local session without that setting gets a temporary one, which goes when Python ends.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set(CHECKPOINT_KEY, root)
    return f"{root.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def saved(df: DataFrame, prefix: str) -> DataFrame:
    """Write a result once to the shared folder and go on from the written table.

    For results that several later steps need: they are not computed again, and a lost executor
    costs only a read.
    """
    path = shared_dir(df.sparkSession, prefix)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
