"""Text search through trigram postings, and pages of an order through a directory of its parts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.durable import durable
from ..sources.memories import bucket_of
from .insight import haystack, search

#: Partitions of the postings, and grams of a needle that must all be in a row before it is read.
PARTS, RAREST = 64, 3
#: Memories of a chunk, and characters that it ends at.
CHUNK, CHARS = 4096, 4_000_000
#: A chunk's row for each gram, and one with gram and part -1 for its memories by place.
POSTINGS = "part int, gram long, chunk string, n int, places array<smallint>, ids array<string>, buckets array<int>"


def _part(gram):
    """Of a gram as one number, three code points of 21 bits."""
    return gram % 1_000_003 % PARTS


def _chunks(hay: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Where each chunk begins, and its texts."""
    start, texts, chars = 0, [], 0
    for i, text in enumerate(hay.cast(pa.binary()).to_pylist()):
        if texts and (len(texts) == CHUNK or chars >= CHARS):
            yield start, texts
            start, texts, chars = i, [], 0
        texts.append((text or b"").decode("utf-8", "replace"))
        chars += len(texts[-1])
    if texts:
        yield start, texts


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' distinct trigrams as numbers, ascending; the places of the texts that hold them, gram after gram, and where each gram's places begin."""
    row = np.repeat(np.arange(len(texts), dtype=np.int16), [len(x) for x in texts])
    at = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    within = row[2:] == row[:-2]
    gram, row = (at[:-2] | at[1:-1] << 21 | at[2:] << 42)[within], row[2:][within]
    order = np.argsort(gram, kind="stable")
    gram, row = gram[order], row[order]
    new = np.ones(len(gram), bool)
    new[1:] = gram[1:] != gram[:-1]
    first = new.copy()
    first[1:] |= row[1:] != row[:-1]
    return gram[new], row[first], np.append(np.flatnonzero(new[first]), first.sum())


def write_postings(memories: DataFrame, path: str) -> None:
    """The distinct trigrams of what search() looks through. Memories are numbered in chunks, and a chunk has one row for each gram, with the places of those that hold it.

    So what is written and moved is a number for each gram and memory, not a row.
    """
    call = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = 0
        for batch in batches:
            for start, texts in _chunks(batch.column("hay")):
                gram, places, begin = _grams(texts)
                name, one = f"{call}-{TaskContext.get().partitionId()}-{chunk}", [0, len(texts)]
                known = [pa.ListArray.from_arrays(pa.array(one, pa.int32()), batch.column(c).slice(start, len(texts))) for c in ("id", "bucket")]
                rows = len(gram)
                yield pa.record_batch([_part(gram).astype(np.int32), gram, pa.array([name] * rows, pa.string()), np.diff(begin).astype(np.int32), pa.ListArray.from_arrays(begin.astype(np.int32), places), pa.nulls(rows, known[0].type), pa.nulls(rows, known[1].type)], names)
                yield pa.record_batch([pa.array([-1], pa.int32()), pa.array([-1], pa.int64()), pa.array([name]), pa.array([len(texts)], pa.int32()), pa.nulls(1, pa.list_(pa.int16())), *known], names)
                chunk += 1

    names = [x.split()[0] for x in POSTINGS.split(", ")]
    hay = memories.select("id", bucket_of("chat_id", "character_id").alias("bucket"), F.lower(haystack()).alias("hay"))
    # Written before it moves, as a chunk that was made again might number its memories otherwise.
    durable(hay.mapInArrow(run, POSTINGS)).hint("rebalance", "part").write.mode("append").partitionBy("part").parquet(path)


def search_postings(spark: SparkSession, memories: DataFrame, path: str, query: str) -> DataFrame:
    """search() over a table that is partitioned by bucket: the needle's rarest trigrams propose memories, only their buckets are read, and contents are verified.

    A needle of fewer than three characters has no trigrams, so it reads the table.
    """
    needle = " ".join(query.lower().split())
    if len(needle) < 3:
        return search(memories, query)
    at = list(map(ord, needle))
    grams = sorted({a | b << 21 | c << 42 for a, b, c in zip(at, at[1:], at[2:], strict=False)})
    postings = spark.read.schema(POSTINGS).parquet(path)
    wanted = postings.filter(F.col("part").isin(sorted({_part(g) for g in grams})))
    # One row for each of the needle's grams comes to the driver.
    often = {r["gram"]: r["n"] for r in wanted.filter(F.col("gram").isin(grams)).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    if len(often) < len(grams):
        return memories.filter(F.lit(False))
    rarest = sorted(grams, key=lambda g: (often[g], g))[:RAREST]
    met = wanted.filter(F.col("gram").isin(rarest)).groupBy("chunk").agg(F.collect_list("places").alias("all")).filter(F.size("all") == len(rarest))
    met = met.select("chunk", F.reduce("all", F.col("all")[0], F.array_intersect).alias("places"))
    held = postings.filter("part = -1").select("chunk", "ids", "buckets")
    proposed = durable(met.join(held, "chunk").select(F.explode(F.transform("places", lambda i: F.struct(F.col("ids")[i].alias("id"), F.col("buckets")[i].alias("bucket")))).alias("p")).select("p.*"))
    buckets = [r["bucket"] for r in proposed.select("bucket").distinct().collect()]  # as many as the table has, at most
    return search(memories.filter(F.col("bucket").isin(buckets)).join(proposed.select("id"), "id", "left_semi"), query)


def write_pages(rows: DataFrame, order: list[Column], path: str) -> None:
    """rows in ranges of the order, a folder each, so that a page reads the ranges it lies in. Rows that tie in the whole order share a range."""
    rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    counts = rows.sparkSession.read.parquet(f"{path}/rows").groupBy("part").agg(F.count("*").alias("n"))
    counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/directory")


def read_page(spark: SparkSession, path: str, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of what write_pages() wrote, with the total. Of the table only the ranges that the page lies in are read; the directory has a row for each range."""
    at, parts, skip = 0, [], 0
    directory = sorted((r["part"], r["n"]) for r in spark.read.parquet(f"{path}/directory").collect())
    for part, n in directory:
        if at + n > offset and at < offset + limit:
            skip = offset - at if not parts else skip
            parts.append(part)
        at += n
    rows = spark.read.parquet(f"{path}/rows").filter(F.col("part").isin(parts)).drop("part")
    return rows.orderBy(*order).offset(max(skip, 0)).limit(limit).withColumn("total", F.lit(at).cast("long"))
