"""Joins of token sets by overlap, in a grid of token blocks.

Tokens are numbered and ordered by rarity. If |A & B| >= needed for the smaller set A, one of A's first |A| - needed + 1 tokens is in B, so A posts
these and B posts all. A token's two lists of postings are cut into blocks and each pair of blocks is a cell, so a token that every text
holds is met in many tasks. In a cell a bitmap of A's rarest tokens drops pairs that miss too much. What is left is packed per set and block of sets, verified there
on whole sets, and comes back as what each set gathers from the sets it is linked with: pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.durable import durable

#: Postings of a token on one side of a cell; sets of a block at least, and sets that are held against a block in one task at least; words of the bitmap, and tokens in it.
CELL, SETS, AGAINST, WORDS, RAREST = 1024, 512, 4096, 8, 256
#: Blocks that the tokens are dealt into, as far as SETS allows; tokens of a block at most; tokens that are looked up at once.
SPREAD, TOKENS, PIECE = 8, 8 << 20, 1 << 20
#: Keys that may be broadcast as heavy, and rows that a key may have without being one.
HEAVY, LIGHT = 10_000, 20_000
NEVER = 2**62


def by_key(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """rows with the columns of table, which has a row for each key and, in weight, about how many rows the key has.

    Keys with more than 1 / HEAVY of the whole weight are met by broadcast, so none of them gathers its rows in one task; there are
    fewer than HEAVY of these whatever the data. The others are met by a shuffle.
    """
    about = table.agg(F.sum(weight).alias("all"), F.max(weight).alias("most")).first()
    cut = max(LIGHT, (about["all"] or 0) / HEAVY)
    if (about["most"] or 0) <= cut:
        return rows.join(table, keys)
    heavy = table.filter(F.col(weight) > cut)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(table.filter(F.col(weight) <= cut), keys)
    return rows.join(F.broadcast(heavy), keys).unionByName(rest)


def in_cells(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """left joined with right on keys, which many rows of both sides may share: each side's rows of a key are dealt into blocks by a or b, and each pair of blocks is a key of its own."""
    counts = durable(left.groupBy(*keys).agg(F.count("*").alias("asks")).join(right.groupBy(*keys).agg(F.count("*").alias("has")), keys))
    cut = lambda c: F.ceil(F.col(c) / CELL).cast("int")
    grid = counts.withColumns({"rows": cut("asks"), "columns": cut("has")})
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    side = lambda rows, weight, c, own, mine, other, theirs: by_key(rows, grid.select(*keys, weight, "rows", "columns"), keys, weight).withColumn(own, place(c, mine)).withColumn(other, each(theirs)).drop(weight, "rows", "columns")
    return side(left, "asks", a, "i", "rows", "j", "columns").join(side(right, "has", b, "j", "columns", "i", "rows"), [*keys, "i", "j"]).drop("i", "j")


def _names(x: str) -> list[str]:
    return [f"{x}{w}" for w in range(WORDS)]


def _bitmap(tokens: str) -> list[Column]:
    """A bit for each token, by its hash, in WORDS longs."""
    bit = "shiftleft(1L, cast(xxhash64(x) & 63 as int))"
    return [F.expr(f"aggregate({tokens}, 0L, (acc, x) -> CASE WHEN shiftright(xxhash64(x), 6) & {WORDS - 1} = {w} THEN acc | {bit} ELSE acc END)") for w in range(WORDS)]


def ranked_sets(sets: DataFrame, scope: list[str], percent: int) -> DataFrame:
    """sets (scope, id, tokens, n, m, last, first) with k, a number for the set, ts, their tokens' numbers from the rarest on, dfs, how many sets have each, and needed.

    Tokens of one set only are shared by none, so they and sets of nothing else are left out here; n still counts them.
    """
    long = sets.select(*scope, "id", F.explode("tokens").alias("token"))
    # A number for each token of each scope, so that later joins need neither the token nor the scope. Written, as numbers must stay.
    numbered = durable(long.groupBy(*scope, "token").agg(F.count("*").alias("df")).withColumn("t", F.monotonically_increasing_id()).filter("df > 1"))
    held = by_key(long, numbered, [*scope, "token"], "df").groupBy(*scope, "id").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("held"))
    needed = F.ceil(F.col("n") * percent / 100).cast("int")
    rows = sets.drop("tokens").join(held, [*scope, "id"]).withColumn("needed", needed)
    part = lambda c: F.transform("held", lambda x: x[c])
    rows = rows.withColumn("k", F.monotonically_increasing_id()).withColumn("ts", part("t")).withColumn("dfs", part("df")).drop("held")
    # Bitmaps are made here, a set each; beside a generator they would be made for each token.
    return durable(rows.withColumns(dict(zip(_names("a"), _bitmap(f"slice(ts, 1, {RAREST})"), strict=True)) | dict(zip(_names("b"), _bitmap("ts"), strict=True))))


def _blocks(ranked: DataFrame) -> tuple[Callable[[str, str], Column], int]:
    """The block of a set by its number and size, and how many sets are held against a block in one task.

    Sets travel once for each block that they may have a partner in, and blocks once for each share of the sets that are held against them. So both are as large as
    a task may hold, and a block has sets of like sizes: large ones, whose bitmaps drop little, are in few blocks.
    """
    level = lambda n: F.length(F.bin(n))
    told = {r["level"]: (r["sets"], r["tokens"]) for r in ranked.groupBy(level("n").alias("level")).agg(F.count("*").alias("sets"), F.sum(F.size("ts")).alias("tokens")).collect()} or {1: (1, 1)}
    sets, tokens = (sum(x) for x in zip(*told.values(), strict=True))
    each = max(1, tokens // sets)
    most = min(max(SETS * each, tokens // SPREAD), TOKENS)
    parts = {x: -(-told[x][1] // most) for x in sorted(told)}
    first = dict(zip(parts, np.cumsum([0, *parts.values()]).tolist(), strict=False))
    of = lambda known, n: F.element_at(F.create_map(*map(F.lit, chain(*known.items()))), level(n))
    return lambda k, n: of(first, n) + F.pmod(F.xxhash64(k), of(parts, n)), max(AGAINST, most // each)


def _proposed(ranked: DataFrame) -> tuple[DataFrame, tuple[Callable[[str, str], Column], int]]:
    """k, block, others: for each set the larger sets of a block that it may overlap enough; and the blocks."""
    blocks = _blocks(ranked)
    token = lambda ts: F.explode(F.arrays_zip(*ts)).alias("p")
    # What a set may miss beside the tokens that it alone has.
    spare = F.size("ts") - F.col("needed")
    prefix = spare + 1
    first = [F.slice(c, F.lit(1), prefix).alias(c) for c in ("ts", "dfs")]
    small = ranked.filter(spare >= 0).select(F.col("k").alias("a"), F.col("n").alias("n_a"), spare.alias("spare"), *_names("a"), token(first)).select("*", F.col("p.ts").alias("t"), F.col("p.dfs").alias("df")).drop("p")
    large = ranked.select(F.col("k").alias("b"), F.col("n").alias("n_b"), *_names("b"), token([F.col("ts"), F.col("dfs")])).select("*", F.col("p.ts").alias("t")).drop("p")
    small = durable(small)
    cut = lambda c: F.ceil(F.col(c) / CELL).cast("int")
    grid = durable(small.groupBy("t", "df").agg(F.count("*").alias("asks")).select("t", "df", "asks", cut("asks").alias("rows"), cut("df").alias("columns")))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = by_key(small.drop("df"), grid.select("t", "asks", "rows", "columns"), ["t"], "asks").withColumn("i", place("a", "rows")).withColumn("j", each("columns")).drop("asks", "rows", "columns")
    right = by_key(large, grid.select("t", "df", "rows", "columns"), ["t"], "df").withColumn("j", place("b", "columns")).withColumn("i", each("rows")).drop("df", "rows", "columns")
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    missed = reduce(lambda x, y: x + y, [F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y)))) for x, y in zip(_names("a"), _names("b"), strict=True)])
    met = left.join(right, ["t", "i", "j"]).filter(smaller).filter(missed <= F.col("spare"))
    return durable(met.withColumn("block", blocks[0]("b", "n_b")).groupBy("a", "block").agg(F.collect_set("b").alias("others")).withColumnRenamed("a", "k")), blocks


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a column of lists, and where each list begins."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))


class _Block:
    """The sets of a block, and which of some of them share enough tokens with a given set."""

    def __init__(self, rows: pa.Table):
        self.k = rows["k"].to_numpy()
        self.order = np.argsort(self.k)
        tokens, self.first = _flat(rows["ts"])
        self.known, self.tokens = np.unique(tokens, return_inverse=True)
        self.held = np.zeros(len(self.known) + 1, bool)  # the last place is for tokens that the block doesn't have

    def _shared(self, theirs: np.ndarray) -> np.ndarray:
        """How many held tokens each of these sets has."""
        lo, n = self.first[theirs], self.first[theirs + 1] - self.first[theirs]
        starts = np.cumsum(n) - n
        return np.add.reduceat(self.held[self.tokens[np.repeat(lo - starts, n) + np.arange(n.sum())]], starts, dtype=np.int64)

    def asking(self, left: pa.Table):
        """For each row of left: its number, the places of those of its others that share the tokens it needs, and how many they share."""
        (tokens, at), (others, to), needed = _flat(left["ts"]), _flat(left["others"]), left["needed"].to_numpy()
        where = np.searchsorted(self.known, tokens)
        where = np.where(self.known[np.minimum(where, len(self.known) - 1)] == tokens, where, len(self.known))
        places = self.order[np.searchsorted(self.k, others, sorter=self.order)]
        for row in range(left.num_rows):
            mine, theirs = where[at[row] : at[row + 1]], places[to[row] : to[row + 1]]
            self.held[mine] = True
            self.held[-1] = False
            ends = np.cumsum(self.first[theirs + 1] - self.first[theirs])
            shared = np.concatenate([self._shared(part) for part in np.split(theirs, np.flatnonzero(np.diff(ends // PIECE)) + 1)])
            self.held[mine] = False
            enough = shared >= needed[row]
            yield row, theirs[enough], shared[enough]


def _gathered(left: pa.Table, right: pa.Table) -> pa.Table:
    """For a cogroup of asking sets and a block: what either side gathers from its linked sets: the sum of m, the largest last, the smallest first."""
    names, start = ("m", "last", "first"), (0, -1, NEVER)
    block = _Block(right)
    mine, theirs = ([x[c].to_numpy() for c in names] for x in (left, right))
    own, out = ([np.full(x.num_rows, s, np.int64) for s in start] for x in (left, right))
    some, hit = np.zeros(left.num_rows, bool), np.zeros(right.num_rows, bool)
    for row, at, _ in block.asking(left):
        if len(at):
            some[row], hit[at] = True, True
            own[0][row], own[1][row], own[2][row] = theirs[0][at].sum(), theirs[1][at].max(), theirs[2][at].min()
            out[0][at] += mine[0][row]
            out[1][at], out[2][at] = np.maximum(out[1][at], mine[1][row]), np.minimum(out[2][at], mine[2][row])
    keys = np.concatenate((left["k"].to_numpy()[some], block.k[hit]))
    return pa.table([pa.array(keys), *(pa.array(np.concatenate((x[some], y[hit]))) for x, y in zip(own, out, strict=True))], ["k", *names])


def _listed(left: pa.Table, right: pa.Table) -> pa.Table:
    """For a cogroup of asking sets and a block: the linked pairs."""
    block, keys, found = _Block(right), left["k"].to_numpy(), []
    for row, at, shared in block.asking(left):
        found.append((np.full(len(at), keys[row]), block.k[at], shared))
    none = np.zeros(0, np.int64)
    return pa.table([pa.array(np.concatenate([none, *x])) for x in (zip(*found, strict=True) if found else ((), (), ()))], ["k", "other", "n_shared"])


def _verified(ranked: DataFrame, each, schema: str) -> DataFrame:
    proposed, (block, against) = _proposed(ranked)
    loads = durable(proposed.groupBy("block").agg(F.count("*").alias("asks")).withColumn("shares", F.ceil(F.col("asks") / against).cast("int")))
    kept = ranked.select("k", "ts", "needed", "m", "last", "first")
    left = by_key(proposed, loads, ["block"], "asks").withColumn("share", F.pmod(F.xxhash64("k"), F.col("shares")).cast("int")).drop("asks", "shares").join(kept, "k")
    right = ranked.select("k", "ts", "m", "last", "first", block("k", "n").alias("block")).join(loads, "block").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    right = right.select(*[F.col(c).alias(c) for c in ("block", "share", "k", "ts", "m", "last", "first")])  # columns of its own, as both sides come from one table

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        return each(x, y)

    return left.groupBy("block", "share").cogroup(right.groupBy("block", "share")).applyInArrow(run, schema)


def linked_sets(ranked: DataFrame) -> DataFrame:
    """k, m, last, first for every set of ranked_sets() that is linked: the sum of the linked sets' m, their largest last and smallest first."""
    found = _verified(ranked, _gathered, "k long, m long, last long, first long")
    return durable(found.groupBy("k").agg(F.sum("m").alias("m"), F.max("last").alias("last"), F.min("first").alias("first")))


def linked_pairs(ranked: DataFrame) -> DataFrame:
    """k, other, n_shared: a row for each linked pair, the smaller set first; for reports of a bounded number of sets."""
    return _verified(ranked, _listed, "k long, other long, n_shared long")
