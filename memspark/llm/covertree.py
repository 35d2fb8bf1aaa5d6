"""Near-duplicate vectors by a cover tree and a dual traversal: all pairs whose cosine reaches a threshold, exactly.

Distances are those of unit vectors, sqrt(2 - 2 cos). The tree has nested levels whose radii halve: a node's centers are
further apart than the level's radius, its own center is among them, and each row goes to the nearest. The upper levels are
Spark jobs: nodes with more than BLOCK rows are split at a bounded number of their rows, all of which are then placed and the
nodes' covering radii measured, so bounds hold whatever rows were drawn. The lower levels are built in tasks, a block of rows
each. Two nodes whose covering balls are further apart than the threshold are dropped with all that stands below them; two
whose balls lie within it are counted whole, so a large group of near copies never becomes pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, durable
from .components import components

#: Rows of a block, and centers that a node is split at in one round, at most.
BLOCK, FANOUT = 2048, 64
#: Rows of a task that places rows of a node.
SHARE = 8192
#: Covers the rounding of distances: the square root of a rounding error of a cosine, with room.
SLACK = 1e-6


@dataclass
class Tree:
    """A block's levels. Rows stand in the tree's order, so a node is a range of them: first[k][i] to first[k][i + 1]."""

    unit: np.ndarray
    weight: np.ndarray
    center: list[np.ndarray]
    first: list[np.ndarray]
    radius: list[np.ndarray]


def reach(cosine: float) -> float:
    """The distance of unit vectors with that cosine."""
    return math.sqrt(max(0.0, 2.0 - 2.0 * cosine))


def radii(cosine: float) -> list[float]:
    """Radii of the levels below the root, halving until balls are well inside the threshold."""
    out = [1.0]
    while out[-1] > reach(cosine) / 4 and out[-1] > 1e-3:
        out.append(out[-1] / 2)
    return out


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


def apart(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * dots, 0.0))


def thinned(dots: np.ndarray, start: int, rows: np.ndarray, radius: float) -> list[int]:
    """Of rows those that are further than radius from each other, start first; each row is within radius of one of them. dots: of all pairs."""
    near, out, left, c = 1.0 - radius * radius / 2.0, [], rows, start
    while True:
        out.append(int(c))
        left = left[(dots[c, left] < near) & (left != c)]
        if not left.size:
            return out
        c = left[0]


def built(x: np.ndarray, levels: list[float]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """order of the rows of x (unit vectors), and the centers, first rows and covering radii of each level; the last level holds single rows."""
    n = len(x)
    dots = x @ x.T
    order, first, center = np.arange(n), np.array([0, n]), np.array([int(np.argmax(x @ x.sum(0)))])
    found = [(center, first)]
    for r in levels:
        orders, sizes, centers = [], [], []
        for g, c in enumerate(center):
            own = order[first[g] : first[g + 1]]
            if len(own) == 1:
                orders.append(own)
                sizes.append(1)
                centers.append(int(own[0]))
                continue
            heads = thinned(dots, c, own, r)
            which = np.argmax(dots[np.ix_(own, heads)], axis=1)
            orders.append(own[np.argsort(which, kind="stable")])
            count = np.bincount(which, minlength=len(heads))
            sizes += count[count > 0].tolist()
            centers += [h for h, k in zip(heads, count, strict=True) if k]
        order, first, center = np.concatenate(orders), np.concatenate(([0], np.cumsum(sizes))), np.array(centers)
        found.append((center, first))
    found.append((order, np.arange(n + 1)))
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    radius = []
    for center, first in found:
        least = np.minimum.reduceat(dots[np.repeat(center, np.diff(first)), order], first[:-1])
        radius.append(np.where(np.diff(first) > 1, apart(least), 0.0))
    return order, [place[c] for c, _ in found], [f for _, f in found], radius


def hook(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the components of u and v; label holds each place's smallest one of its component."""
    while len(u):
        lu, lv = label[u], label[v]
        open_ = lu != lv
        u, v, lu, lv = u[open_], v[open_], lu[open_], lv[open_]
        np.minimum.at(label, np.maximum(lu, lv), np.minimum(lu, lv))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    n = hi - lo
    return np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())


def traverse(a: Tree, b: Tree, cosine: float, same: bool, raw=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """links of a's rows, links of b's rows (weights of the other side's rows that reach the cosine; of both in one if same), and a label for each row of a, then of b.

    raw(i, j): cosines of rows of a with rows of b from the given vectors, asked for where rounding could decide. A row isn't linked with itself.
    """
    t, na = reach(cosine), len(a.unit)
    to_a, to_b = np.zeros(na, np.int64), np.zeros(len(b.unit), np.int64)
    label = np.arange(na if same else na + len(b.unit))
    shift = 0 if same else na
    heavy = lambda tree, k: np.add.reduceat(tree.weight, tree.first[k][:-1])
    ua, ub = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for k in range(len(a.first) - 1):
        if not len(ua):
            break
        last, next_a, next_b = k + 2 == len(a.first), [], []
        wa, wb = heavy(a, k + 1), heavy(b, k + 1)
        fa, fb = np.searchsorted(a.first[k + 1], a.first[k]), np.searchsorted(b.first[k + 1], b.first[k])
        firsts = np.flatnonzero(np.concatenate(([True], ua[1:] != ua[:-1])))
        for at, end in zip(firsts, [*firsts[1:], len(ua)], strict=True):
            node, partners = ua[at], ub[at:end]
            ca, cb = np.arange(fa[node], fa[node + 1]), _ranges(fb[partners], fb[partners + 1])
            dots = a.unit[a.center[k + 1][ca]] @ b.unit[b.center[k + 1][cb]].T
            once = (ca[:, None] < cb[None, :]) if same else np.ones(dots.shape, bool)
            if last:
                linked = dots >= cosine + SLACK * SLACK
                i, j = np.nonzero((dots >= cosine - 1e-9) & (dots < cosine + 1e-9) & once)
                if len(i):
                    linked[i, j] = raw(ca[i], cb[j]) >= cosine if raw else dots[i, j] >= cosine
                i, j = np.nonzero(linked & once)
                np.add.at(to_a, ca[i], wb[cb[j]])
                np.add.at(to_b, cb[j], wa[ca[i]])
                hook(label, ca[i], cb[j] + shift)
                continue
            both, far = a.radius[k + 1][ca][:, None] + b.radius[k + 1][cb][None, :], apart(dots)
            whole = (far + both <= t - SLACK) & once
            kept = (far <= t + both + SLACK) & once & ~whole
            if same:  # a node with itself: its distances go up to twice its radius
                i, j = np.nonzero(ca[:, None] == cb[None, :])
                inside = 2 * a.radius[k + 1][ca[i]] <= t - SLACK
                kept[i, j] = ~inside
                for c in ca[i[inside]]:
                    lo, hi = a.first[k + 1][c], a.first[k + 1][c + 1]
                    to_a[lo:hi] += wa[c] - a.weight[lo:hi]
                    hook(label, np.arange(lo, hi), np.full(hi - lo, lo))
            for i, j in zip(*np.nonzero(whole), strict=True):
                la, ha = a.first[k + 1][ca[i]], a.first[k + 1][ca[i] + 1]
                lb, hb = b.first[k + 1][cb[j]], b.first[k + 1][cb[j] + 1]
                to_a[la:ha] += wb[cb[j]]
                to_b[lb:hb] += wa[ca[i]]
                hook(label, np.arange(la, ha), np.full(ha - la, lb + shift))
                hook(label, np.arange(lb, hb) + shift, np.full(hb - lb, la))
            i, j = np.nonzero(kept)
            next_a.append(ca[i])
            next_b.append(cb[j])
        ua, ub = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (next_a, next_b))
    return (to_a + to_b if same else to_a), to_b, label


def _vectors(cell: pa.ListScalar | pa.ListArray | pa.ChunkedArray, n: int) -> np.ndarray:
    if isinstance(cell, pa.ChunkedArray):
        cell = cell.combine_chunks()
    flat = cell.values if isinstance(cell, pa.Scalar) else cell.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(n, -1)


def _split(left: pa.Table, right: pa.Table) -> pa.Table:
    """Places a share of a node's rows at the nearest of its centers (one row with their list)."""
    ids, gap = np.zeros(0, np.int64), np.zeros(0)
    if left.num_rows:
        heads = right.column("heads").combine_chunks().flatten()
        known = heads.field("cid").to_numpy()
        x, far = (units(_vectors(v, n).astype(np.float64)) for v, n in ((left.column("vec").combine_chunks(), left.num_rows), (heads.field("vec"), len(known))))
        dots = x @ far.T
        which = np.argmax(dots, axis=1)
        ids, gap = known[which], apart(dots[np.arange(len(x)), which])
    keep = [left.column(c) for c in ("cid", "n", "dim", "vec", "node")]
    return pa.table([*keep, pa.array(ids), pa.array(gap)], ["cid", "n", "dim", "vec", "parent", "node", "gap"])


def _heads(radius: float):
    """The centers of nodes: of the rows drawn those further apart than the radius, the node's own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, drawn in zip(batch.column("node").to_pylist(), batch.column("drawn"), strict=True):
                ids = drawn.values.field("cid").to_numpy()
                vec = drawn.values.field("vec")
                x = units(_vectors(vec, len(ids)).astype(np.float64))
                own = np.flatnonzero(ids == node)
                start = int(own[0]) if len(own) else 0
                got = thinned(x @ x.T, start, np.arange(len(ids)), radius)
                out.append(drawn.values.take(pa.array(got)).to_pylist())
            yield pa.record_batch([batch.column("node"), pa.array(out, batch.schema.field("drawn").type)], ["node", "heads"])

    return run


def _place(classes: DataFrame, cosine: float, block: int, fanout: int) -> tuple[DataFrame, list[DataFrame]]:
    """classes with the node (its center's cid) they end in, and the nodes of each level: node, parent, dim, n, w, radius, center.

    The root of a label's vectors of one length is its smallest cid.
    """
    roots = classes.groupBy("label", "dim").agg(F.min("cid").alias("node"))
    roots = roots.select(F.col("label").alias("rl"), F.col("dim").alias("rd"), "node")
    placed = durable(classes.join(roots, (F.col("label") == F.col("rl")) & (F.col("dim") == F.col("rd"))).select("cid", "n", "dim", "vec", F.col("node").alias("parent"), "node", F.lit(2.0).cast("double").alias("gap")))

    def nodes(placed: DataFrame) -> DataFrame:
        own = F.col("cid") == F.col("node")
        kind = dict(placed.dtypes)["vec"]
        told = placed.groupBy("node").agg(F.min("parent").alias("parent"), F.count("*").alias("rows"), F.sum("n").alias("w"), F.max("gap").alias("radius"))
        center = placed.filter(own).select("node", "dim", F.col("vec").cast(kind).alias("center"))
        return compact(told.join(center, "node"))

    levels = [nodes(placed)]
    for radius in radii(cosine):
        # Balls that lie within the threshold are counted whole, so they needn't be split.
        big = levels[-1].filter((F.col("rows") > block) & (2 * F.col("radius") > reach(cosine) - SLACK))
        big = big.select("node", "rows", F.least(F.lit(fanout), F.ceil(2 * F.col("rows") / block)).alias("heads_n"), F.ceil(F.col("rows") / SHARE).cast("int").alias("shares"))
        if big.isEmpty():
            break
        chance = F.pmod(F.xxhash64("cid", F.lit(len(levels))), F.lit(1 << 30)) / float(1 << 30)
        met = placed.join(big, "node")
        drawn = met.filter((F.col("cid") == F.col("node")) | (chance < F.col("heads_n") / F.col("rows"))).groupBy("node").agg(F.collect_list(F.struct("cid", "vec")).alias("drawn"))
        kind = dict(drawn.dtypes)["drawn"]
        heads = durable(drawn.mapInArrow(_heads(radius), f"node long, heads {kind}")).join(big.select("node", "shares"), "node")
        dealt = met.select("cid", "n", "dim", "vec", "node", F.pmod(F.xxhash64("cid", F.lit("share")), F.col("shares")).cast("int").alias("share"))
        spread = heads.select("node", "heads", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
        vec = dict(placed.dtypes)["vec"]
        split = dealt.groupBy("node", "share").cogroup(spread.groupBy("node", "share")).applyInArrow(_split, f"cid long, n long, dim int, vec {vec}, parent long, node long, gap double")
        kept = placed.join(big.select(F.col("node").alias("b")), F.col("node") == F.col("b"), "left_anti").withColumn("parent", F.col("node"))
        placed = durable(split.unionByName(kept.select(*placed.columns)))
        levels.append(nodes(placed))
    return placed, levels


def _node_pairs(levels: list[DataFrame], cosine: float) -> DataFrame:
    """a, b, whole: pairs of nodes of the last level that may hold a link, each pair once, through their parents' pairs."""
    t = reach(cosine)
    pairs = levels[0].select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(False).alias("whole"))
    as_unit = F.transform("center", lambda v: v.cast("double"))
    big = F.array_max(F.transform(as_unit, F.abs))
    scaled = F.transform(as_unit, lambda v: v / big)
    size = F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda s, v: s + v * v))
    for below in levels[1:]:
        kids = durable(below.select("node", "parent", "radius", F.transform(scaled, lambda v: v / size).alias("u")))
        side = lambda x: kids.select(F.col("parent").alias(f"p{x}"), F.col("node").alias(f"n{x}"), F.col("radius").alias(f"r{x}"), F.col("u").alias(f"u{x}"))  # noqa: E731, B023
        met = pairs.filter("not whole").join(side("a"), F.col("a") == F.col("pa")).join(side("b"), F.col("b") == F.col("pb"))
        met = met.filter("a <> b or na <= nb")
        dot = F.aggregate(F.zip_with("ua", "ub", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
        far = F.when(F.col("na") == F.col("nb"), 0.0).otherwise(F.sqrt(F.greatest(2.0 - 2.0 * dot, F.lit(0.0))))
        met = met.withColumn("far", far).withColumn("both", F.col("ra") + F.col("rb")).filter(F.col("far") <= t + F.col("both") + SLACK)
        now = met.select(F.col("na").alias("a"), F.col("nb").alias("b"), (F.col("far") + F.col("both") <= t - SLACK).alias("whole"))
        # A pair that is whole stays so; its nodes may have been split on account of other pairs.
        kept = pairs.filter("whole").join(side("a").drop("ua"), F.col("a") == F.col("pa")).join(side("b").drop("ub"), F.col("b") == F.col("pb")).filter("a <> b or na <= nb")
        pairs = durable(now.unionByName(kept.select(F.col("na").alias("a"), F.col("nb").alias("b"), F.lit(True).alias("whole"))))
    return pairs


def _packed(batches: Iterator[pa.RecordBatch], levels: list[float]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows with their trees."""
    for batch in batches:
        for i, (node, rows) in enumerate(zip(batch.column("node").to_pylist(), batch.column("rows"), strict=True)):
            x = _vectors(rows.values.field("vec"), len(rows))
            order, center, first, radius = built(units(x.astype(np.float64)), levels)
            cid, n = (rows.values.field(c).to_numpy()[order] for c in ("cid", "n"))
            flat = lambda xs, kind: pa.array([[np.asarray(v) for v in xs]], pa.list_(pa.list_(kind)))
            vec = pa.ListArray.from_arrays([0, x.size], pa.array(x[order].ravel()))
            columns = [pa.array([node]), batch.column("share").slice(i, 1), pa.array([cid]), pa.array([n]), vec, flat(center, pa.int32()), flat(first, pa.int32()), flat(radius, pa.float64())]
            yield pa.record_batch(columns, ["node", "share", "cid", "n", "vec", "center", "first", "radius"])


def _tree(row: pa.StructScalar) -> tuple[np.ndarray, np.ndarray, Tree]:
    cid, n = (row[c].values.to_numpy() for c in ("cid", "n"))
    x = _vectors(row["vec"], len(cid)).astype(np.float64)
    parts = [[v.values.to_numpy(zero_copy_only=False) for v in row[c].values] for c in ("center", "first", "radius")]
    return cid, x, Tree(units(x), n, *parts)


def _met(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Per pair of blocks a row for each linked class: cid, links here, and the smallest cid that it reaches here."""
    for batch in batches:
        for left, right, same in zip(batch.column("left"), batch.column("right"), batch.column("same").to_pylist(), strict=True):
            (ida, xa, a), (idb, xb, b) = _tree(left), _tree(right)

            def raw(i, j, xa=xa, xb=xb):
                # Powers of two keep squares in range and round nothing.
                x, y = (v * np.exp2(-np.frexp(np.abs(v).max(axis=1, keepdims=True))[1].astype(float)) for v in (xa[i], xb[j]))
                return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))

            to_a, to_b, label = traverse(a, b, cosine, same, raw)
            ids, links = (ida, to_a) if same else (np.concatenate((ida, idb)), np.concatenate((to_a, to_b)))
            low = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(low, label, ids)
            some = links > 0
            yield pa.record_batch([pa.array(ids[some]), pa.array(links[some]), pa.array(low[label][some])], ["cid", "links", "head"])


def near_vectors(rows: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK, fanout: int = FANOUT) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of the table; links are pairs of rows with equal labels and a cosine of at least `cosine` (above 0).

    Null labels, and vectors that are null, empty, zero or hold null or non-finite parts, link with nothing: 0 links, their own component.
    Vectors are compared with those of the same length. Rows that repeat, ids included, are vectors of their own, linked with each other;
    equal vectors of a label are compared once, as a class with a weight. component_id is the smallest id that links reach, null ids passed by; kept: the id
    equals it, or both are null. Empty table: empty result.
    """
    vec = F.col(vector)
    whole = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec, lambda v: v != 0)
    given = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.when(whole, F.col(label)).alias("label"), F.when(whole & F.col(label).isNotNull(), vec).alias("vec"))
    # 128 bits name a label's vector from here on, so members of a class are found again without moving vectors.
    keys = [F.when(F.col("vec").isNotNull(), F.xxhash64(F.lit(s), "label", "vec")).alias(k) for k, s in (("k1", 1), ("k2", 2))]
    given = durable(given.select("*", *keys))
    classes = given.filter("vec is not null").groupBy("k1", "k2", "label", "vec").agg(F.min("row").alias("cid"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = durable(classes.withColumn("dim", F.size("vec")))
    placed, levels = _place(classes.select("cid", "n", "dim", "vec", "label"), cosine, block, fanout)
    pairs = durable(_node_pairs(levels, cosine))
    nodes = levels[-1]
    # Whole pairs of nodes: each row gets the weight of the other node (of its own, less itself).
    told = nodes.select("node", "w")
    other = lambda a, b: pairs.filter("whole").select(F.col(a).alias("to"), F.col(b).alias("node"))
    adds = other("a", "b").unionByName(other("b", "a").filter("to <> node")).join(told, "node").groupBy("to").agg(F.sum("w").alias("add"), F.max((F.col("to") == F.col("node")).cast("int")).alias("self"))
    by_node = placed.select("cid", "n", F.col("node").alias("to")).join(durable(adds), "to").select("cid", (F.col("add") - F.when(F.col("self") == 1, F.col("n")).otherwise(0)).alias("links"), F.col("to").alias("head"))
    # Blocks of the others.
    open_ = pairs.filter("not whole")
    used = open_.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    shares = used.join(nodes.select("node", F.ceil(F.col("rows") / block).cast("int").alias("shares")), "node")
    packed = placed.join(shares, "node").withColumn("share", F.pmod(F.xxhash64("cid"), F.col("shares")).cast("int")).groupBy("node", "share").agg(F.collect_list(F.struct("cid", "n", "vec")).alias("rows"))
    kind, steps = dict(placed.dtypes)["vec"], radii(cosine)
    blocks = durable(packed.mapInArrow(lambda b: _packed(b, steps), f"node long, share int, cid array<long>, n array<long>, vec {kind}, center array<array<int>>, first array<array<int>>, radius array<array<double>>"))
    body = F.struct("cid", "n", "vec", "center", "first", "radius")
    a, b = (blocks.select(F.col("node").alias(f"{x}n"), F.col("share").alias(f"{x}s"), body.alias(side)) for x, side in (("a", "left"), ("b", "right")))
    keys_ = blocks.select("node", "share")
    ends = lambda x: keys_.select(F.col("node").alias(x), F.col("share").alias(f"{x}s"))
    dealt = open_.join(ends("a"), "a").join(ends("b"), "b").filter("a <> b or as <= bs").select(F.col("a").alias("an"), "as", F.col("b").alias("bn"), "bs")
    dealt = dealt.join(a, ["an", "as"]).join(b, ["bn", "bs"]).select("left", "right", F.expr("an = bn and as = bs").alias("same"))
    met = dealt.mapInArrow(lambda x: _met(x, cosine), "cid long, links long, head long")
    found = durable(met.unionByName(by_node).groupBy("cid", "head").agg(F.sum("links").alias("links")))
    # Links and components of classes, then of rows.
    whole_ends = pairs.filter("whole").select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = found.select(F.col("cid").alias("u"), F.col("head").alias("v")).unionByName(whole_ends)
    comps = components(edges)
    links = found.groupBy("cid").agg(F.sum("links").alias("links")).filter("links > 0")
    known = classes.join(links, "cid", "left").filter("n > 1 or links > 0").join(comps.withColumnRenamed("node", "cid"), "cid", "left")
    known = durable(known.select("k1", "k2", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("comp", "cid").alias("comp")))
    lowest = known.groupBy("comp").agg(F.min("least").alias("component"))
    named = known.join(lowest, "comp").select("k1", "k2", "n_links", "component")
    out = given.select("vec_id", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
