"""Connected components of an edge table, as Spark jobs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted


#: Nodes that a task holds at once when it contracts edges, and edges of a partition.
ROWS = 200_000


def _contract(batches: Iterator[pa.RecordBatch], whole: bool = False) -> Iterator[pa.RecordBatch]:
    """The partition's edges as stars: each node with the smallest one of its component, as far as ROWS nodes at a time show it. whole: these smallest ones too, with themselves."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def stars() -> pa.RecordBatch:
        found = [(x, t) for x in parent if (t := top(x)) != x or whole]
        parent.clear()
        return pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["u", "v"])

    for batch in batches:
        for at in range(0, batch.num_rows, 10_000):
            some = batch.slice(at, 10_000)
            for u, v in zip(some.column("u").to_pylist(), some.column("v").to_pylist(), strict=True):
                low, high = sorted((top(u), top(v)))
                parent[high] = low
            if len(parent) > ROWS:
                yield stars()
    yield stars()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node or edges from larger ones only: then the smaller ends are the components."""
    ends = edges.select("u", F.lit(1).alias("out")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("out")))
    roles = ends.groupBy("u").agg(F.sum("out").alias("n"), F.min("out").alias("low"))
    return roles.filter("n > 1 or (n = 1 and low = 0)").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, comp (the smallest node that can be reached) for every node of edges (u, v).

    Edges that one task can hold are settled there. More are first contracted within partitions, in runs of a bounded number of nodes, each to stars around its components' smallest nodes.
    What is left is joined up between partitions: it alternates large-star and small-star steps (Kiveris et al., SoCC 2014): each node hangs its larger, then its
    smaller neighbours on the smallest node it knows, until nothing changes. Steps are grouped minima and joins,
    so a node with very many neighbours is combined before the shuffle and split by adaptive joins after it.
    """
    edges, n = counted(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), ROWS)
    if 2 * n > ROWS:
        edges, n = counted(edges.distinct(), ROWS)
    if 2 * n > ROWS:
        edges, n = counted(edges.mapInArrow(_contract, "u long, v long"), ROWS)
    for _ in range(max_rounds):
        if 2 * n <= ROWS:
            return edges.coalesce(1).mapInArrow(partial(_contract, whole=True), "u long, v long").toDF("node", "comp")
        if _are_stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges, n = counted(small.select("e.u", "e.v").filter("u <> v").distinct(), ROWS)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
