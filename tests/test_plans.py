"""Properties every plan must have at any scale."""

import pytest

import __spark_entry__ as entry
from cinelake.operators import codes as C
from cinelake.operators import fit, frames, scan
from pyspark.sql import functions as F

# queries whose building already runs jobs are covered by the result tests
LAZY = [n for n in entry.queries() if not n.startswith("stream_") and n not in ("file_frames", "reassemble_reused")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_and_no_row_udfs(spark, sf_dir, name):
    plan = plan_of(entry.queries()[name](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "RDDScan", "GlobalLimit"):
        assert bad not in plan


def test_scans_read_only_needed_columns(spark, sf_dir):
    plan = plan_of(entry.queries()["vote_majority"](spark, sf_dir))
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_returnflag:string>" in plan


def test_filter_reaches_parquet_after_writing_frames(spark, tmp_path):
    rows = spark.range(50).selectExpr("id seq", "id % 3 file_id", "named_struct('rl_chroma', 1, 'rl', 2, 'dc', 1) header")
    rows.write.parquet(f"{tmp_path}/frames")
    plan = plan_of(frames.with_config(spark.read.parquet(f"{tmp_path}/frames")).select("seq"))
    assert "EqualTo(header.rl_chrom" in plan and "header:struct<rl_chroma:int,rl:int,dc:int>" in plan


def test_filter_skips_files_of_a_clustered_table(spark, tmp_path):
    rows = spark.range(4000).selectExpr("id seq", "named_struct('rl_chroma', int(id % 3), 'rl', int(id div 3 % 3), 'dc', int(id % 2)) header")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files of a small table
    try:
        frames.by_config(rows).write.parquet(f"{tmp_path}/frames")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    table = spark.read.parquet(f"{tmp_path}/frames")
    assert table.count() == 4000 and frames.with_config(table).count() == frames.with_config(rows).count() > 0
    files = table.groupBy(F.input_file_name()).agg(F.min("header.rl_chroma").alias("low"), F.max("header.rl_chroma").alias("high"))
    assert 0 < files.filter("low <= 1 AND high >= 1").count() < files.count()
    assert "EqualTo(header.rl_chr" in plan_of(frames.with_config(table).select("seq"))


def test_running_aggregates_never_window_over_a_whole_key(spark):
    df = spark.range(1000).selectExpr("id div 100000 as file_id", "id as seq", "id % 7 as v")
    out = scan.ordered_scan(df, ["file_id"], ["seq"], {"s": scan.Running("sum", F.col("v"))}, chunk_rows=10)
    plan = plan_of(out)
    assert "hashpartitioning(file_id#" in plan and "_chunk0#" in plan
    groups = out.groupBy(F.spark_partition_id()).count().count()
    assert groups > 1
    last = out.orderBy(F.desc("seq")).first()
    assert last.s == sum(i % 7 for i in range(1000))


def test_limits_apply_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 file_id", "id seq")
    assert plan_of(frames.head_per_file(df, 2)).count("WindowGroupLimit") == 2
    votes = spark.range(100).selectExpr("'t' table_id", "id % 3 symbol", "bin(id) code", "id n")
    assert plan_of(C.top_codes(votes, 2)).count("WindowGroupLimit") == 2
    events = spark.range(100).selectExpr("id % 3 blk", "id k", "id % 4 run", "id value")
    assert plan_of(fit.expand_runs(events, ["blk"], ["k"])).count("WindowGroupLimit") == 2
