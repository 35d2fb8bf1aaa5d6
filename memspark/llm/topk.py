"""Exact top-k by inner product with multi-resolution segment statistics.

Vectors are cut into segments; a segment's mean and deviation bound its part of an inner product (and so bound the
distance from below). A coarse level with few segments drops most candidates against a score that k rows are known to
reach, a finer level drops more, and exact scores are computed for what is left. Vectors of like coarse statistics share a block, and
a block keeps their envelope: pairs of blocks whose envelopes can't reach a score to beat are dropped before any vector moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import durable

LEVELS = (4, 16)
#: Queries whose survivors are scored together: exact scores are computed for candidates that one of them still needs.
SLICE = 64
LONGEST = 2**63 - 1
#: Rows of a block of candidates and of queries, and of the candidates that give each query its first score to beat.
CANDIDATES, QUERIES, SEEDS = 4096, 1024, 1024


def quantized(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """row, vec_id, dim, vec: floor(scale * x) of each component as a long, those beyond 64 bits as the nearest long; rows whose vector is null or holds null or non-finite parts are left out."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    x = F.col(vector).cast("array<double>")
    valid = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(x, fine)
    most = float(2**63 - 1024)  # the largest double below 2**63
    whole = lambda v: F.when(v >= most, F.lit(LONGEST)).when(v <= -most, F.lit(-LONGEST)).otherwise(F.floor(F.when(F.abs(v) < most, v).otherwise(F.lit(0.0))).cast("long"))
    ints = F.transform(x, lambda v: whole(v * scale))
    kept = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), vector)
    return kept.filter(valid).select("row", "vec_id", F.size(vector).alias("dim"), ints.alias("vec"))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Features whose inner product bounds the vectors' from above: per segment sqrt(length) times mean and deviation."""
    edges = np.unique(np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int))
    length = np.diff(edges).astype(x.dtype)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / length
    square = np.add.reduceat(x * x, edges[:-1], axis=1) / length
    deviation = np.sqrt(np.maximum(square - mean * mean, 0.0))
    return np.concatenate((mean, deviation), axis=1) * np.sqrt(np.concatenate((length, length)))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a with all rows of b; through floating point where it can't round. Those beyond 64 bits become the nearest long."""
    most = bound(a, b)
    for kind, bits in ((np.float32, 24), (np.float64, 53)):
        if most < 2**bits:
            return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    product = a.astype(object) @ b.astype(object).T
    return np.array(np.clip(product, -LONGEST, LONGEST), dtype=np.int64).reshape(len(a), len(b))


def bound(a: np.ndarray, b: np.ndarray) -> float:
    """What no inner product of their rows, nor a part of it, exceeds."""
    return float(np.abs(a.astype(np.float64)).max(initial=0.0)) * float(np.abs(b.astype(np.float64)).max(initial=0.0)) * a.shape[1]


def block_top(q_row, q, floor, c_row, c_id, c, k):
    """(query index, candidate index, score) of each query's best k in a block that reach its floor; ties to smaller ids."""
    # Bounds are of vectors scaled to 1 at most, so single precision holds them; the slack covers its rounding.
    largest = lambda x: max(float(np.abs(x.astype(np.float64)).max(initial=0.0)), 1.0)
    unit = largest(q) * largest(c)
    qf, cf = (q / largest(q)).astype(np.float32), (c / largest(c)).astype(np.float32)
    slack = 0.5 / unit + 1e-5 * float(np.linalg.norm(qf, axis=1).max(initial=0.0)) * float(np.linalg.norm(cf, axis=1).max(initial=0.0))
    least = (np.maximum(floor / unit, -1e30) - slack).astype(np.float32)
    levels = [n for n in LEVELS if n <= max(1, q.shape[1] // 2)]
    stats = [(statistics(qf, n), statistics(cf, n)) for n in levels]
    out_q, out_c, out_score = [], [], []
    for at in range(0, len(q), SLICE):
        some = slice(at, at + SLICE)
        alive, columns = q_row[some, None] != c_row[None, :], np.arange(len(c))
        for sq, sc in stats:
            alive &= sq[some] @ sc[columns].T >= least[some, None]
            needed = alive.any(axis=0)
            alive, columns = alive[:, needed], columns[needed]
        score = exact(q[some], c[columns])
        alive &= score >= floor[some, None]
        i, j = np.nonzero(alive)
        out_q.append(i + at)
        out_c.append(columns[j])
        out_score.append(score[i, j])
    alive_q, alive_c, score = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (out_q, out_c, out_score))
    order = np.lexsort((c_row[alive_c], c_id[alive_c], -score, alive_q))
    alive_q, alive_c, score = alive_q[order], alive_c[order], score[order]
    nth = np.arange(len(alive_q)) - np.searchsorted(alive_q, alive_q, "left")
    return alive_q[nth < k], alive_c[nth < k], score[nth < k]


def _dealt(rows: DataFrame, per_block: int, name: str) -> DataFrame:
    """Rows with the number of their block: about per_block rows of one dimension and cell, dealt by a hash. As many cells as their key allows are counted and broadcast."""
    n_blocks = F.ceil(F.col("n") / per_block).cast("long")
    cells = rows.groupBy("dim", "cell").agg(F.count("*").alias("n")).withColumn(name + "_n", n_blocks)
    first = F.sum(name + "_n").over(W.partitionBy("dim").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    cells = cells.select("dim", "cell", name + "_n", F.coalesce(first, F.lit(0)).alias("first"))
    own = F.col("first") + F.pmod(F.xxhash64("row"), F.col(name + "_n"))
    return rows.join(cells, ["dim", "cell"]).withColumn(name, own).drop("first", name + "_n")


def _packed(dealt: DataFrame, name: str) -> DataFrame:
    return dealt.groupBy(name, "dim").agg(F.collect_list(F.struct("row", "vec_id", "vec")).alias(name + "_rows"))


#: Blocks of a group. Blocks are numbered along their cells, so those of a group are alike. And shares that groups are dealt into where they meet.
GROUP, MEETINGS = 32, 16


def _envelopes(dealt: DataFrame, name: str, *more) -> DataFrame:
    """Per block the least and the largest of each coarse statistic, and the block's group."""
    ends = [f(F.col("stat")[i]).alias(f"{name}_{which}{i}") for i in range(2 * LEVELS[0]) for which, f in (("lo", F.min), ("hi", F.max))]
    return durable(dealt.groupBy(name, "dim").agg(*ends, *more).withColumn(f"{name}_group", F.floor(F.col(name) / GROUP)))


def _grouped(envelopes: DataFrame, name: str, *more) -> DataFrame:
    """The envelopes of groups of blocks."""
    ends = [(F.min if which == "lo" else F.max)(f"{name}_{which}{i}").alias(f"{name}_{which}{i}") for i in range(2 * LEVELS[0]) for which in ("lo", "hi")]
    return envelopes.groupBy("dim", f"{name}_group").agg(*ends, *more)


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """dim, qb, cb of blocks that may hold a score that some query has to beat: first groups of blocks meet, in shares, then the blocks of those that are left. The slack covers rounding."""
    reach = _reach("qb", "cb")
    may = F.isnan(reach) | (reach + F.abs(reach) * 1e-9 + 0.5 >= F.col("floor"))
    share = F.explode(F.sequence(F.lit(0), F.lit(MEETINGS - 1))).alias("share")
    asked = _grouped(left, "qb", F.min("floor").alias("floor")).select("*", share)
    given = _grouped(right, "cb").withColumn("share", F.pmod(F.xxhash64("cb_group"), F.lit(MEETINGS)).cast("int"))
    groups = asked.join(given, ["dim", "share"]).filter(may).select("dim", "qb_group", "cb_group")
    return groups.join(left, ["dim", "qb_group"]).join(right, ["dim", "cb_group"]).filter(may).select("dim", "qb", "cb")


def _reach(a: str, b: str):
    """What no product of a statistic vector in one envelope with one in the other exceeds."""
    parts = []
    for i in range(2 * LEVELS[0]):
        corners = [F.col(f"{a}_{x}{i}") * F.col(f"{b}_{y}{i}") for x in ("lo", "hi") for y in ("lo", "hi")]
        parts.append(F.greatest(*corners))
    return sum(parts[1:], parts[0])


def _unpack(cell: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = cell.values
    vec = rows.field("vec")
    flat = vec.flatten().to_numpy(zero_copy_only=False)
    return rows.field("row").to_numpy(zero_copy_only=False), rows.field("vec_id").to_numpy(zero_copy_only=False), flat.reshape(len(rows), -1)


def top_k(rows: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query row's k best other rows, all if there are fewer, ties to smaller ids.

    is_query: a condition on vec_id. Rows that repeat count each for itself, so a copy of the query's row may be found. Vectors
    are compared with those of the same length. Null ids are not queries and come first among ties. Components and scores beyond
    64 bits become the nearest long. Empty table: empty result.
    """
    spark = rows.sparkSession
    vectors = durable(quantized(rows, id_col, vector, scale).withColumn("vec_id", F.coalesce("vec_id", F.lit(-(2**63)))))
    # The longest vectors tend to score highest: k of them set each query's score to beat. Any rows would give right results.
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    seeds = [(r["row"], r["dim"], r["vec"]) for r in vectors.orderBy(norm.desc(), "row").limit(SEEDS).select("row", "dim", "vec").collect()]
    by_dim = {d: (np.array([r for r, x, _ in seeds if x == d]), np.array([v for _, x, v in seeds if x == d], dtype=np.int64)) for d in {x for _, x, _ in seeds}}
    known = spark.sparkContext.broadcast(by_dim)
    lowest = float("-inf")

    def floors(q_row: np.ndarray, q: np.ndarray) -> np.ndarray:
        row, vec = known.value.get(q.shape[1], (np.zeros(0, np.int64), np.zeros((0, q.shape[1]), np.int64)))
        if len(row) <= k:
            return np.full(len(q), lowest)
        score = exact(q, vec).astype(np.float64)
        score[q_row[:, None] == row[None, :]] = lowest
        floor = -np.partition(-score, k - 1, axis=1)[:, k - 1]
        return np.where(floor <= -float(LONGEST), lowest, floor)  # scores below 64 bits all tie there

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the coarse statistics, the cell, and for queries the score to beat."""
        kind = pa.list_(pa.float64())
        for whole in batches:
            for d in sorted(set(whole.column("dim").to_pylist())):
                same = whole.filter(pc.equal(whole.column("dim"), d))
                for at in range(0, same.num_rows, 1024):
                    batch = same.slice(at, 1024)
                    x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
                    got = statistics(x.astype(np.float64), LEVELS[0])
                    got = np.where(np.isfinite(got), got, np.inf)
                    stat = np.zeros((len(x), 2 * LEVELS[0]))
                    n = got.shape[1] // 2
                    stat[:, :n], stat[:, LEVELS[0] : LEVELS[0] + n] = got[:, :n], got[:, n:]
                    # Like vectors: the same signs of segment means, and lengths that differ by half an octave at most.
                    length = np.log2(np.maximum(np.sqrt((x.astype(np.float64) ** 2).sum(1)), 1.0))
                    cell = ((stat[:, : LEVELS[0]] > 0) << np.arange(LEVELS[0])).sum(1) * 256 + np.minimum(np.floor(2 * length), 255).astype(np.int64)
                    floor = np.full(len(x), lowest)
                    asks = batch.column("asks").to_numpy(zero_copy_only=False)
                    if asks.any():
                        floor[asks] = floors(batch.column("row").to_numpy()[asks], x[asks])
                    yield pa.record_batch([*batch.columns, pa.array(list(stat), kind), pa.array(cell), pa.array(floor)], [*batch.schema.names, "stat", "cell", "floor"])

    asking = F.coalesce(is_query, F.lit(False)) & (F.col("vec_id") != -(2**63))
    rows_ = vectors.withColumn("asks", asking)
    featured = durable(rows_.mapInArrow(features, f"{', '.join(f'{n} {t}' for n, t in rows_.dtypes)}, stat array<double>, cell long, floor double"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["q_row", "query_id", "row", "vec_id", "score"]
        for batch in batches:
            for left, right in zip(batch.column("qb_rows"), batch.column("cb_rows"), strict=True):
                (q_row, q_id, q), (c_row, c_id, c) = _unpack(left), _unpack(right)
                a, b, score = block_top(q_row, q, floors(q_row, q), c_row, c_id, c, k)
                yield pa.record_batch([pa.array(x) for x in (q_row[a], q_id[a], c_row[b], c_id[b], score)], names)

    asked, given = _dealt(featured.filter("asks"), QUERIES, "qb"), _dealt(featured, CANDIDATES, "cb")
    met = _pairs(_envelopes(asked, "qb", F.min("floor").alias("floor")), _envelopes(given, "cb"))
    blocks = met.join(_packed(asked, "qb"), ["dim", "qb"]).join(_packed(given, "cb"), ["dim", "cb"]).select("qb_rows", "cb_rows")
    found = blocks.mapInArrow(pairs, "q_row long, query_id long, row long, vec_id long, score long")
    best = W.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    vec_id = F.when(F.col("vec_id") != -(2**63), F.col("vec_id"))
    return ranked.select("query_id", "rank", vec_id.alias("vec_id"), "score")
