"""Sharding over fixed virtual slots.

Records hash by id into a fixed number of slots, bytes are summed per slot, and a stored, versioned table maps
slots to shards. Rebalancing adds a version of that table only: a record's slot never changes, whatever its text becomes.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.durable import checkpoint_dir
from .common import durable

SLOTS = 4096
MAP_SCHEMA = "version int, virtual_slot int, shard int"


def with_slots(docs: DataFrame, n_slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of each row. Size: UTF-8 bytes of the text plus 8; a null text has none and CRC 0.

    The slot hashes the id alone. An id that repeats, or null, names no record, so its rows are dealt by their place in the table and
    even one that holds most rows spreads over all slots.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("place")
    )
    rows = durable(rows)
    repeated = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("again"), F.lit(True).alias("repeats"))
    marked = rows.join(repeated, rows["doc_id"].eqNullSafe(repeated["again"]), "left")
    key = F.when(F.col("repeats"), F.xxhash64("doc_id", "place")).otherwise(F.xxhash64("doc_id"))
    return marked.select("doc_id", "size", "text_crc32", F.pmod(key, F.lit(n_slots)).cast("int").alias("virtual_slot"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))


def build_map(usage: DataFrame, n_shards: int, n_slots: int = SLOTS, version: int = 1) -> DataFrame:
    """Version 1 of the map: the heaviest slot first, each to the lightest shard. At most n_slots rows reach the driver."""
    heap = [(0, k) for k in range(n_shards)]
    weight = {r["virtual_slot"]: r["bytes"] for r in usage.collect()}
    rows = []
    for slot in sorted(range(n_slots), key=lambda s: (-weight.get(s, 0), s)):
        load, shard = heapq.heappop(heap)
        rows.append((version, slot, shard))
        heapq.heappush(heap, (load + weight.get(slot, 0), shard))
    return usage.sparkSession.createDataFrame(rows, MAP_SCHEMA)


def rebalance(slot_map: DataFrame, usage: DataFrame, n_shards: int) -> DataFrame:
    """The next version for n_shards shards (more than before): slots move into the new shards only, from the heaviest old ones."""
    weight = {r["virtual_slot"]: r["bytes"] for r in usage.collect()}
    old = slot_map.orderBy("virtual_slot").collect()
    version, by_shard, load = old[0]["version"] + 1, {}, {}
    place = {r["virtual_slot"]: r["shard"] for r in old}
    for slot, shard in place.items():
        by_shard.setdefault(shard, []).append(slot)
        load[shard] = load.get(shard, 0) + weight.get(slot, 0)
    goal = sum(load.values()) / n_shards
    for slots in by_shard.values():
        slots.sort(key=lambda s: (weight.get(s, 0), s))
    for new in range(max(load) + 1, n_shards):
        got = 0
        heap = [(-v, k) for k, v in load.items()]  # of old shards; one that gave no more to the last new shard may give to this one
        heapq.heapify(heap)
        while heap and got < goal:
            heaviest, shard = heapq.heappop(heap)
            fits = [s for s in by_shard[shard] if 0 < weight.get(s, 0) <= min(goal - got, -heaviest - goal)]
            if not fits:
                continue  # this shard gives no more
            slot = fits[-1]
            by_shard[shard].remove(slot)
            place[slot] = new
            got += weight[slot]
            load[shard] -= weight[slot]
            heapq.heappush(heap, (heaviest + weight[slot], shard))
    return slot_map.sparkSession.createDataFrame([(version, s, k) for s, k in sorted(place.items())], MAP_SCHEMA)


def save_map(slot_map: DataFrame, path: str) -> None:
    """Adds a version to the stored map; earlier versions stay readable."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    """A version of the stored map, as it was saved."""
    return spark.read.schema(MAP_SCHEMA).parquet(path).filter(F.col("version") == version)


def assign(rows: DataFrame, slot_map: DataFrame, usage: DataFrame) -> DataFrame:
    """rows with shard and slot, the row's place in its shard, gapless from 0.

    Rows of a shard are ordered by virtual slot, then id: the place is the slot's offset, from the
    row counts of the at most SLOTS slots, plus the rank within the slot. So no task sorts a whole shard.
    """
    before = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    offsets = slot_map.join(usage, "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("offset"))
    within = W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("rank", F.row_number().over(within))
        .join(F.broadcast(offsets), "virtual_slot")
        .withColumn("slot", (F.col("offset") + F.col("rank") - 1).cast("long"))
        .drop("offset", "rank")
    )


def shard_documents(docs: DataFrame, n_shards: int = 24, n_slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, next_shard for each row of docs.

    Law `bytes`: the map is drawn from bytes per slot, so shards are near equal in size. It is stored at path (in the shared
    checkpoint folder, if none is given) as version 1; version 2 is that map rebalanced for one more shard, and next_shard is
    what it says: the old shard, or the new one for rows of the slots that move. Empty table: empty result. Null texts
    count 8 bytes. Repeated rows each get a place. Other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or f"{checkpoint_dir(spark)}/slot-maps-{uuid.uuid4().hex}"
    rows = durable(with_slots(docs, n_slots))
    usage = durable(slot_bytes(rows))
    save_map(build_map(usage, n_shards, n_slots), path)
    save_map(rebalance(load_map(spark, path, 1), usage, n_shards + 1), path)
    placed = assign(rows, load_map(spark, path, 1), usage)
    after = load_map(spark, path, 2).select("virtual_slot", F.col("shard").alias("next_shard"))
    return placed.join(F.broadcast(after), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "next_shard"
    )
