"""Which needles occur in texts of any length, without holding each needle against each text.

Windows of a power of two characters have a hash that is made of their halves' hashes. A needle's first and last window, each at least
half of it long, tell it by 128 bits. Texts are cut into pieces that overlap, and a piece's windows of all lengths are looked up among the needles' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a piece at least; bits of the table that hashes are looked up in first; pairs of a place and a needle that are held at once.
PIECE, TABLE, PAIRS = 1 << 20, 22, 1 << 22
TOLD = ["size", "head", "tail"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _singles(text: str) -> np.ndarray:
    """The hashes of windows of one character."""
    return _mixed(np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _halves(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mixed(left * np.uint64(0xD6E8FEB86659FD93) + _mixed(right + np.uint64(0x632BE59BD9B4E019)))


def _level(size: int) -> int:
    """The power of two whose window covers half of so many characters or more, and not all of them from two on."""
    return max(size - 1, 1).bit_length() - 1


def _one(singles: np.ndarray) -> np.uint64:
    while len(singles) > 1:
        singles = _halves(singles[::2], singles[1::2])
    return singles[0]


def _texts(column: pa.Array) -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def told_apart(rows: DataFrame, needle: str) -> DataFrame:
    """rows with the size, head and tail of a needle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, ends = [], []
            for text in _texts(batch.column(needle)):
                singles, window = _singles(text), 1 << _level(len(text))
                size.append(len(text))
                ends.append((_one(singles[:window]), _one(singles[-window:])) if text else (0, 0))
            ends = np.array(ends, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.record_batch([*batch.columns, pa.array(size, pa.int32()), ends[:, 0].copy(), ends[:, 1].copy()], [*batch.schema.names, *TOLD])

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, size int, head long, tail long")


def _found(text: str, size: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Which of the needles are in the text. Heads and tails are unsigned."""
    hit, levels = np.zeros(len(size), bool), np.array([_level(n) for n in size.tolist()])
    windows = _singles(text)
    for level in range(levels.max(initial=-1) + 1):
        if level:
            half = 1 << level - 1
            if len(windows) <= half:
                break
            windows = _halves(windows[:-half], windows[half:])
        own = np.flatnonzero((levels == level) & (size > 0))
        if not len(own):
            continue
        own = own[np.argsort(head[own])]
        heads, after = head[own], size[own].astype(np.int64) - (1 << level)
        some = np.zeros(1 << TABLE, bool)
        mask = np.uint64((1 << TABLE) - 1)
        some[heads & mask] = True
        at = np.flatnonzero(some[windows & mask])
        first, last = (np.searchsorted(heads, windows[at], side) for side in ("left", "right"))
        at, first, n = at[last > first], first[last > first], (last - first)[last > first]
        done = 0
        while done < len(at):
            # As many places as give PAIRS pairs, one at least.
            upto = done + max(1, int(np.searchsorted(np.cumsum(n[done:]), PAIRS)))
            m = n[done:upto]
            which = np.repeat(first[done:upto] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            end = np.repeat(at[done:upto], m) + after[which]
            fits = end < len(windows)
            which, end = which[fits], end[fits]
            hit[own[which[windows[end] == tail[own[which]]]]] = True
            done = upto
    return hit


def contained(needles: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, size, head and tail of those needles (key and the columns of told_apart()) that occur in their key's text. Empty needles occur in none."""
    asked = needles.select(key, *TOLD).distinct()
    most = needles.agg(F.max("size")).first()[0] or 1
    step = max(PIECE, most)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, whole in enumerate(_texts(batch.column(text))):
                for piece, start in enumerate(range(0, len(whole), step)):
                    yield pa.record_batch([batch.column(key).slice(i, 1), pa.array([piece], pa.int32()), pa.array([whole[start : start + step + most - 1]])], [key, "piece", "part"])

    kind = dict(texts.dtypes)[key]
    told = texts.select(key, F.ceil(F.char_length(text) / step).cast("int").alias("pieces"))
    pieces = texts.select(key, text).mapInArrow(cut, f"`{key}` {kind}, piece int, part string")
    ask = asked.join(told, key).filter("pieces > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        hit = np.zeros(left.num_rows, bool)
        size, head, tail = (left[c].to_numpy() for c in TOLD)
        for part in right["part"].to_pylist() if left.num_rows else ():
            hit |= _found(part, size, head.view(np.uint64), tail.view(np.uint64))
        return left.select([key, *TOLD]).filter(pa.array(hit))

    met = ask.select(key, "piece", *TOLD).groupBy(key, "piece").cogroup(pieces.groupBy(key, "piece"))
    return met.applyInArrow(run, f"`{key}` {dict(asked.dtypes)[key]}, size int, head long, tail long").distinct()
