"""Streams of several batches over tables of more files and later times than the smallest tables have."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from memspark.sources import memories as src
from memspark.sources.durable import checkpoint_dir
from memspark.streaming import store as streams

from .test_queries import SF, normal


def equals_sql(name, spark, sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf):
        path = f"{sf}/{f}/*.parquet" if os.path.isdir(f"{sf}/{f}") else f"{sf}/{f}"
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    found = con.execute(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, sf).select(*[d[0] for d in found.description])
    assert normal(map(tuple, got.collect())) == normal(found.fetchall())


@pytest.fixture
def small_files(spark):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "15")
    yield
    spark.conf.unset("spark.sql.files.maxRecordsPerFile")


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    """Conversations whose times lie about the queries' present: from before it to weeks after it."""
    sf = str(tmp_path_factory.mktemp("late"))
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    shift = F.explode(F.array(*[F.lit(x).cast("long") for x in (1100, 1250, 1300, 1500)]))
    rows.withColumn("by", shift).withColumn("conv_id", F.col("conv_id") + F.col("by")).drop("by").write.parquet(f"{sf}/conversations.parquet")
    return sf


def test_evicted_keys_with_parts_of_many_files(spark, small_files):
    equals_sql("evicted_keys_from_batches", spark, SF)


def batches(spark, name):
    before = set(glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/stream-*"))
    entry.queries()[name](spark, SF)
    (base,) = set(glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/stream-*")) - before
    files = len(glob.glob(f"{base}/feed/*.parquet"))
    # With no data of its own, a batch only moves the watermark on.
    return files, len(glob.glob(f"{base}/state/sources/0/*"))


@pytest.mark.parametrize("name", ["decisions_from_stream", "context_from_batches", "usage_from_batches"])
def test_a_part_is_one_batch(name, spark, small_files):
    files, n = batches(spark, name)
    assert files > 3
    assert n == 3


@pytest.mark.parametrize("name", ["resumed_summaries", "summaries_from_state"])
def test_summaries_of_later_times(name, spark, late):
    equals_sql(name, spark, late)


def test_scopes_with_summaries_only_have_no_window(spark):
    with streams.state_in_rocksdb(spark):
        rows = src.memories_from_conversations(spark, SF).filter("layer = 'stable' and metadata.is_summary")
        got = streams.summary_stream(rows.withColumn("archived", F.lit(False)), as_of=0, skips=True).collect()
    assert {r["action"] for r in got} == {"skipped_not_enough_inputs"}
    assert {r["summarized_count"] for r in got} == {0}
