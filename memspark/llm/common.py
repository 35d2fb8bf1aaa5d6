"""Helpers shared by the corpus operators."""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.durable import durable as durable

#: A word: a run of characters that are neither a space nor one of \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: A licence word: ASCII letters and digits and everything outside ASCII.
ALNUM_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only, unlike lower()."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def counted(df: DataFrame, rows: int = 200_000) -> tuple[DataFrame, int]:
    """compact(df) and its number of rows, which is counted while they are written: jobs of their own cost the driver threads, compiled plans and broadcasts."""
    seen = Observation()
    done = durable(df.observe(seen, F.count(F.lit(1)).alias("n")))
    n = seen.get["n"]
    return done.coalesce(max(1, -(-n // rows))), n


def compact(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A durable table of narrow rows in no more partitions than it needs, so that small ones don't cost a task and a file per shuffle partition."""
    return counted(df, rows)[0]


class KeyFilter:
    """A Bloom filter over 64-bit keys of fixed size, so its broadcast has a bound whatever the data.

    More keys only raise its share of false positives; callers must stay exact under those.
    """

    #: 64-bit words that travel together, as one binary.
    PAGE = 1024

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @staticmethod
    def places(key: Column, log2_bits: int) -> list[Column]:
        return [F.shiftrightunsigned(key, s).bitwiseAND(F.lit((1 << log2_bits) - 1)) for s in (0, 64 - log2_bits)]

    @classmethod
    def build(cls, keys: DataFrame, key: str, log2_bits: int = 24) -> KeyFilter:
        """keys: a column of well mixed longs. The filter's pages are made in tasks; 2**log2_bits / 8 bytes at most reach the driver, as they are."""
        place = F.explode(F.array(*cls.places(F.col(key), log2_bits)))
        words = (
            keys.select(place.alias("place"))
            .groupBy(F.shiftright("place", 6).cast("int").alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("mask"))
        )
        pages = words.groupBy(F.floor(F.col("word") / cls.PAGE).cast("int").alias("page")).agg(F.collect_list(F.struct((F.col("word") % cls.PAGE).alias("at"), "mask")).alias("words"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for cell in batch.column("words"):
                    page = np.zeros(cls.PAGE, dtype="<i8")
                    page[cell.values.field("at").to_numpy(zero_copy_only=False)] = cell.values.field("mask").to_numpy(zero_copy_only=False)
                    out.append(zlib.compress(page.tobytes(), 1))
                yield pa.record_batch([batch.column("page"), pa.array(out, pa.binary())], ["page", "bits"])

        got = pages.mapInArrow(run, "page int, bits binary").toArrow()
        out = np.zeros((max(1, (1 << log2_bits - 6) // cls.PAGE), cls.PAGE), dtype="<i8")
        for page, bits in zip(got.column("page").to_pylist(), got.column("bits"), strict=True):
            out[page] = np.frombuffer(zlib.decompress(bits.as_buffer()), dtype="<i8")
        return cls(out.ravel()[: 1 << log2_bits - 6].view(np.uint64), log2_bits)

    def has(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys).astype(np.int64, copy=False).view(np.uint64)
        found = np.ones(len(keys), dtype=bool)
        for s in (0, 64 - self.bits):
            place = (keys >> np.uint64(s)) & np.uint64((1 << self.bits) - 1)
            found &= (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return found
