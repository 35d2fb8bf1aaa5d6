"""A trie of conversation prefixes by ROLLUP over positional turn columns.

Each conversation becomes rows of BLOCK positional columns, a turn's identity in each. A row is keyed by its prior block's node, so one GROUP BY
of that key with a ROLLUP of the columns aggregates all prefixes of all blocks together, and grouping_id tells how deep a group is. A
node's key is the exclusive or of a 128-bit hash of each of its turns with its position, which blocks combine without reading a conversation in order.

What a node gathers from its whole subtree comes from a second ROLLUP: a node belongs to its smallest conversation, those of one conversation are
a suffix of its path, so sums over conversations give sums over subtrees without a row for each node and ancestor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import durable

#: Turns of a block.
BLOCK = 8
#: Characters of a text that order rows with the same turn number and role; their hash orders the rest.
HEAD = 64
KEY = ["depth", "x1", "x2"]


def positioned(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, pos from 1, hi, lo, bytes) of every turn, and (conv, n). hi and lo name role and text.

    Rows are dealt by ranges of conversation and turn, so a conversation with very many turns is numbered in many tasks: each counts its part, and starts from what earlier parts hold.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    ids = [F.xxhash64(F.lit(s), role, text).alias(x) for s, x in ((1, "hi"), (2, "lo"))]
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), F.substring(text, 1, HEAD).alias("head"), *ids, F.octet_length(text).cast("long").alias("bytes")).filter("conv is not null")
    order = [F.asc_nulls_first("turn"), "role", "head", "hi", "lo"]
    dealt = durable(turns.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id()))
    counts = durable(dealt.groupBy("conv", "part").agg(F.count("*").alias("n")))
    before = F.sum("n").over(W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    # A part holds one conversation at most that an earlier part began: no more rows than parts.
    later = counts.withColumn("before", before).filter("before > 0").select("conv", "part", "before")
    numbered = dealt.withColumn("nth", F.row_number().over(W.partitionBy("conv", "part").orderBy(*order)))
    placed = numbered.join(F.broadcast(later), ["conv", "part"], "left").select("conv", (F.col("nth") + F.coalesce("before", F.lit(0))).alias("pos"), "hi", "lo", "bytes")
    return durable(placed), counts.groupBy("conv").agg(F.sum("n").alias("n"))


def rebuilt(placed: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of every conversation c after its first h were replaced by those of conversation c - c % 5, h = crc32(c) % 9; and (conv, len)."""
    convs = sizes.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % 9).withColumn("donor", F.expr("conv - conv % 5"))
    given = sizes.select(F.col("conv").alias("donor"), F.col("n").alias("dn"))
    convs = durable(convs.join(given, "donor", "left").withColumn("lent", F.least("h", F.coalesce("dn", F.lit(0)))).select("conv", "n", "h", "donor", "lent"))
    heads = placed.filter("pos <= 8").withColumnRenamed("conv", "donor").join(convs.select("donor", "conv", "h"), "donor").filter("pos <= h").select("conv", "pos", "hi", "lo", "bytes")
    own = placed.join(convs.select("conv", "h", "lent"), "conv").filter("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "hi", "lo", "bytes")
    return heads.unionByName(own), convs.select("conv", (F.col("lent") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("len"))


def _mixed(seed: int, pos: Column, hi: Column, lo: Column) -> Column:
    return F.xxhash64(F.lit(seed), pos.cast("long"), hi, lo)


def paths(turns: DataFrame, lengths: DataFrame, block: int) -> DataFrame:
    """conv, len, block, k1, k2 (the key of the prior block's node), x1, x2 (of the block's turns), and t1, t2, ...: hi, lo and bytes by position, null beyond the end. Without turns: one row."""
    slot, pos = (F.col("pos") - 1) % block, F.col("pos")
    at = [F.max(F.when(slot == j, F.col(c))).alias(f"{c}{j + 1}") for j in range(block) for c in ("hi", "lo", "bytes")]
    mixes = [F.bit_xor(_mixed(s, pos, F.col("hi"), F.col("lo"))).alias(x) for s, x in ((3, "x1"), (4, "x2"))]
    rows = turns.groupBy("conv", F.floor((pos - 1) / block).alias("block")).agg(*at, *mixes)
    earlier = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    keys = [F.coalesce(F.bit_xor(x).over(earlier), F.lit(0)).alias(k) for x, k in (("x1", "k1"), ("x2", "k2"))]
    slots = [F.when(F.col(f"hi{j}").isNotNull(), F.struct(F.col(f"hi{j}").alias("hi"), F.col(f"lo{j}").alias("lo"), F.col(f"bytes{j}").alias("bytes"))).alias(f"t{j}") for j in range(1, block + 1)]
    some = rows.select("conv", "block", *keys, "x1", "x2", *slots)
    all_ = lengths.join(some, "conv", "left")
    return durable(all_.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("block", "k1", "k2", "x1", "x2")}))


def rolled(rows: DataFrame, aggregates: str, block: int) -> DataFrame:
    """The aggregates of every prefix, with its depth, its node's key and its parent's (x1, x2; p1, p2), and bytes of its last text."""
    columns = ", ".join(f"t{j}" for j in range(1, block + 1))
    groups = rows.sparkSession.sql(f"SELECT block, k1, k2, {columns}, {block} - bit_count(grouping_id()) AS level, {aggregates} FROM {{rows}} GROUP BY block, k1, k2, ROLLUP({columns})", rows=rows)
    last = F.get(F.array(*[F.col(f"t{j}") for j in range(1, block + 1)]), F.col("level") - 1)
    # A level whose own column is null holds conversations that ended before it; level 0 is the prior block's node, which only the root lacks.
    real = groups.withColumn("last", F.when(F.col("level") > 0, last)).filter("last is not null or (level = 0 and block = 0)")

    def key(seed: int, prior: str, through: Column) -> Column:
        out = F.col(prior)
        for j in range(1, block + 1):
            t = F.col(f"t{j}")
            out = out.bitwiseXOR(F.when(t.isNotNull() & (F.lit(j) <= through), _mixed(seed, F.col("block") * block + j, t["hi"], t["lo"])).otherwise(F.lit(0)))
        return out

    level = F.col("level")
    keys = [key(s, k, level - up).alias(x) for up, name in ((0, "x"), (1, "p")) for s, k, x in ((3, "k1", f"{name}1"), (4, "k2", f"{name}2"))]
    kept = [c for c in groups.columns if c not in ("block", "k1", "k2", "level") and not (c[0] == "t" and c[1:].isdigit())]
    return real.select((F.col("block") * block + level).cast("long").alias("depth"), *keys, F.coalesce("last.bytes", F.lit(0)).alias("bytes"), *kept)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with the same key as comma-joined ids, in order."""
    seq = 0
    for batch in batches:
        keys = [batch.column(c).to_numpy() for c in KEY]
        changes = np.zeros(batch.num_rows, bool)
        for k in keys:
            changes[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(changes | (np.arange(batch.num_rows) == 0))
        ids, part = batch.column("conv").to_pylist(), batch.column("part").take(pa.array(starts))
        texts = [",".join(map(str, ids[a:b])) for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]
        yield pa.record_batch([*(pa.array(k[starts]) for k in keys), part, pa.array(np.arange(seq, seq + len(starts))), pa.array(texts, pa.string())], [*KEY, "part", "seq", "ids"])
        seq += len(starts)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest for each key over its texts, which come in order; none is held longer than its batch."""
    key, digest = None, None
    for batch in batches:
        out = []
        for *now, text in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
            if now != key:
                if key:
                    out.append((*key, digest.hexdigest()))
                key, digest = now, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        yield pa.record_batch([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], [*KEY, "ends_sha256"])
    if key:
        yield pa.record_batch([pa.array([x]) for x in (*key, digest.hexdigest())], [*KEY, "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """depth, x1, x2, ends_sha256 of the nodes where conversations end. Ids are joined in ranges, then a node's ranges are hashed in order, so no task holds a node's ids."""
    last = rows.groupBy("conv").agg(F.max("len").alias("depth"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    dealt = last.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv").withColumn("part", F.spark_partition_id())
    runs = dealt.mapInArrow(_joined, "depth long, x1 long, x2 long, part int, seq long, ids string")
    return runs.repartition(*KEY).sortWithinPartitions(*KEY, "part", "seq").mapInArrow(_digests, "depth long, x1 long, x2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), then role, then the text's first characters, then a hash; null roles and texts are empty. Rows without conv_id belong to no
    conversation and are left out. Repeated rows are turns of their own. Texts count whole, of any length. Without conversations the result is empty.
    """
    turns, lengths = rebuilt(*positioned(conversations))
    rows = paths(turns, lengths, block)
    nodes = rolled(rows, "count(*) AS n_convs, min(conv) AS conv_id, max(len) AS longest", block)
    nodes = nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("bytes")).withColumn("leaf", (F.col("longest") == F.col("depth")).cast("long"))
    nodes = durable(nodes.drop("longest", "bytes"))
    # Each conversation's own nodes: those of which it is the smallest member, down to its last.
    own = nodes.groupBy("conv_id").agg(F.sum("own").alias("total"), F.sum("leaf").alias("leaves"))
    below = F.sum("own").over(W.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0))
    weighed = rows.join(own.withColumnRenamed("conv_id", "conv"), "conv")
    sums = rolled(weighed, "sum(total) AS totals, sum(leaves) AS n_leaves", block).select(*KEY, "totals", "n_leaves")
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")]
    kids = nodes.filter("depth > 0").select(*parent).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.withColumn("below", below).join(own.select("conv_id", "total"), "conv_id").join(sums, KEY).join(kids, KEY, "left").join(ends(rows), KEY, "left").join(above, ["depth", "p1", "p2"], "left")
    saved = F.col("totals") - F.col("total") + F.col("below")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    parent_id = F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id")
    return out.select("conv_id", "depth", parent_id, "n_convs", count("n_children"), count("n_leaves"), saved.cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
