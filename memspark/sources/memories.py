"""Schemas, readers and writers of memory tables, and the relations derived from chat tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .durable import durable

HISTORY = "array<struct<action:string,timestamp:timestamp,related_memory_id:string,note:string>>"
METADATA_FIELDS = {
    "entities": "array<string>",
    "keywords": "array<string>",
    "is_summary": "boolean",
    "summary_kind": "string",
    "summary_generated_at": "timestamp",
    "summary_source_memory_ids": "array<string>",
    "summarized_memory_count": "int",
    "consolidation_note": "string",
    "related_memory_id": "string",
    "review_status": "string",
    "consolidation_history": HISTORY,
}
METADATA = f"struct<{','.join(f'{k}:{v}' for k, v in METADATA_FIELDS.items())}>"
FIELDS = {
    "id": "string",
    "chat_id": "string",
    "character_id": "string",
    "type": "string",
    "content": "string",
    "normalized_content": "string",
    "source": "string",
    "layer": "string",
    "importance": "double",
    "created_at": "timestamp",
    "updated_at": "timestamp",
    "last_accessed_at": "timestamp",
    "access_count": "bigint",
    "pinned": "boolean",
    "archived": "boolean",
    "metadata": METADATA,
}
MEMORY = ", ".join(f"{k} {v}" for k, v in FIELDS.items())
COLUMNS = list(FIELDS)
TYPES, SOURCES, STORED_LAYERS, ROLES = ("profile", "relationship", "event", "summary"), ("auto", "manual"), ("episodic", "stable"), ("user", "assistant", "system")


def metadata(**given: Column) -> Column:
    """A metadata struct; what isn't given has its default."""
    empty = F.array().cast("array<string>")
    defaults = {
        "entities": empty, "keywords": empty, "is_summary": F.lit(False), "summary_kind": None, "summary_generated_at": None, "summary_source_memory_ids": empty,
        "summarized_memory_count": F.lit(0), "consolidation_note": None, "related_memory_id": None, "review_status": None, "consolidation_history": F.array().cast(HISTORY),
    }
    filled = {k: F.coalesce(given.get(k, F.lit(None)).cast(kind), F.lit(None) if defaults[k] is None else defaults[k]) for k, kind in METADATA_FIELDS.items()}
    return F.struct(*[c.cast(METADATA_FIELDS[k]).alias(k) for k, c in filled.items()])


def with_defaults(col: Column) -> Column:
    """A decoded metadata struct with defaults for missing parts."""
    return metadata(**{name: col[name] for name in METADATA_FIELDS})


def read_memories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MEMORY).parquet(path)


def decode_flat(flat: DataFrame) -> DataFrame:
    """The flat form, with JSON metadata, ISO times as text and 0/1 flags, to typed memories. Unreadable parts become defaults or null."""
    parsed = F.from_json("metadata_json", ", ".join(f"{k} {v}" for k, v in METADATA_FIELDS.items()))
    times = {c: F.col(c).try_cast("timestamp") for c in ("created_at", "updated_at", "last_accessed_at")}
    flags = {c: F.coalesce(F.col(c).cast("int"), F.lit(0)) != 0 for c in ("pinned", "archived")}
    typed = {"importance": F.col("importance").cast("double"), "access_count": F.coalesce(F.col("access_count").cast("long"), F.lit(0))}
    return flat.withColumns({**times, **flags, **typed, "metadata": with_defaults(parsed)}).select(*COLUMNS)


def encode_flat(memories: DataFrame) -> DataFrame:
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    times = {c: iso(c) for c in ("created_at", "updated_at", "last_accessed_at")}
    return memories.withColumns({**times, "pinned": F.col("pinned").cast("int"), "archived": F.col("archived").cast("int"), "metadata_json": F.to_json("metadata")}).drop("metadata")


BUCKETS = 64


def bucket_of(chat_id: str | Column, character_id: str | Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(chat_id, character_id), F.lit(buckets)).cast("int")


def append_memories(memories: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Appends by a bucket of the scope, so that a chat's rows stay together. A bucket gets one file, or several if it is large."""
    keyed = memories.withColumn("bucket", bucket_of("chat_id", "character_id", buckets)).hint("rebalance", "bucket")
    keyed.write.mode("append").partitionBy("bucket").parquet(path)


def rewrite_memories(spark: SparkSession, path: str, changes: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Applies change(memories, changes) to a table of append_memories() and returns the numbers of the buckets that were rewritten.

    changes: rows with the id of a memory each. They are routed to buckets by a scan of ids alone; only these buckets are read, changed and replaced, the files of others stay.
    A bucket that loses all its rows is deleted. Ids that the table doesn't have are ignored.
    """
    table = spark.read.schema(f"{MEMORY}, bucket int").parquet(path)
    held = table.select("id", "bucket").join(changes.select("id").distinct(), "id", "left_semi").select("bucket").distinct()
    touched = sorted(r["bucket"] for r in held.collect())  # as many as the table has buckets, at most
    if not touched:
        return []
    part = table.filter(F.col("bucket").isin(touched))
    # A scope doesn't change, so neither does a row's bucket. Written elsewhere first, as the result replaces what it is made of.
    new = durable(change(part.select(*COLUMNS), changes).join(part.select("id", "bucket"), "id"))
    new.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    emptied = set(touched) - {r["bucket"] for r in new.select("bucket").distinct().collect()}
    for bucket in emptied:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return touched


def create(requests: DataFrame, as_of: Column) -> DataFrame:
    """New memories from requests (id, scope, type, content, source, layer, importance, pinned, archived, metadata)."""
    return requests.withColumns(
        {
            "content": F.trim("content"), "normalized_content": text.normalize_content(F.col("content")), "created_at": as_of, "updated_at": as_of,
            "last_accessed_at": F.lit(None).cast("timestamp"), "access_count": F.lit(0).cast("long"),
        }
    ).select(*COLUMNS)


def widen(old: DataFrame, new: DataFrame) -> DataFrame:
    """A snapshot under a wider schema: missing columns become null."""
    return old.unionByName(new, allowMissingColumns=True)


def violations(memories: DataFrame) -> DataFrame:
    """memories with the names of the rules each row breaks."""
    rules = {
        "id": F.col("id").isNull(), "chat_id": F.col("chat_id").isNull(), "character_id": F.col("character_id").isNull(), "content": F.coalesce(F.trim("content"), F.lit("")) == "",
        "type": ~F.coalesce(F.col("type").isin(*TYPES), F.lit(False)), "source": ~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)),
        "layer": ~F.coalesce(F.col("layer").isin(*STORED_LAYERS), F.lit(False)), "importance": ~F.coalesce(F.col("importance").between(0, 1), F.lit(False)),
        "access_count": ~F.coalesce(F.col("access_count") >= 0, F.lit(False)),
    }
    return memories.withColumn("violations", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()])))


def split_valid(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with their violations."""
    checked = violations(memories)
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)


def clamp_importance(col: Column) -> Column:
    return F.least(F.greatest(col, F.lit(0.0)), F.lit(1.0))


def message_lines(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """One user message per line that isn't blank, with its place."""
    lines = rows.select("*", F.posexplode(F.split(text_col, r"\R")).alias("line_no", "line"))
    return lines.withColumn("line", F.trim("line")).filter("line <> ''").withColumn("role", F.lit("user"))


def parse_list(col: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def resolve_scope(contexts: DataFrame) -> DataFrame:
    """contexts (chatId, groupId, characterId) with the effective chat and character, where each came from, and their key."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    chat, group, character = some("chatId"), some("groupId"), some("characterId")
    chat_id = F.coalesce(chat, group, F.lit("default"))
    character_id = F.coalesce(character, chat_id)
    return contexts.withColumns(
        {
            "chat_id": chat_id,
            "character_id": character_id,
            "chat_scope_source": F.when(chat.isNotNull(), F.lit("chatId")).when(group.isNotNull(), F.lit("groupId_fallback")).otherwise(F.lit("default_fallback")),
            "character_scope_source": F.when(character.isNotNull(), F.lit("characterId")).otherwise(F.lit("chatId_fallback")),
            "scope_key": F.concat_ws("::", chat_id, character_id),
        }
    )


def lore_entries(raw: DataFrame) -> DataFrame:
    """entry_id, comment, content, tags from loosely named columns; columns that are missing count as null."""

    def first(*names: str, default: str | None = "") -> Column:
        have = [F.col(n).cast("string") for n in names if n in raw.columns]
        return F.coalesce(*have, F.lit(default)) if have else F.lit(default).cast("string")

    comment, content = first("comment", "label", "title", "name"), first("content", "entry", "text", "value")
    listed = next((n for n in ("tags", "tag_list", "keytags") if n in raw.columns), None)
    if listed is None:
        tags = F.array().cast("array<string>")
    elif dict(raw.dtypes)[listed].startswith("array"):
        tags = F.coalesce(F.col(listed), F.array().cast("array<string>"))
    else:
        tags = F.split(F.coalesce(F.col(listed), F.lit("")), r"[,\s]+")
    tags = F.filter(F.transform(tags, lambda t: text.collapse(F.lower(t))), lambda t: t != "")
    return raw.select("*", F.coalesce(first("uid", "id", "world_info_uid", default=None), comment).alias("lore_id"), comment.alias("lore_comment"), content.alias("lore_content"), tags.alias("lore_tags"))


# Relations over the chat tables, for queries and benchmarks.

AS_OF = "2026-03-27 00:00:00"
BASE_TIME = "2026-02-01 00:00:00"


def messages_from_conversations(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """rows: turns (conv_id, turn, role, text) in place of the table's."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet") if rows is None else rows
    return rows.select(
        F.concat(F.lit("r"), F.col("conv_id")).alias("request_id"), F.concat(F.lit("chat-"), F.col("conv_id")).alias("chat_id"),
        F.concat(F.lit("char-"), F.col("conv_id") % 7).alias("character_id"), F.col("turn").cast("int").alias("msg_idx"), "role", F.coalesce("text", F.lit("")).alias("text"),
    )


def memories_from_conversations(spark: SparkSession, sf_dir: str, keyword_cap: int = 8, rows: DataFrame | None = None) -> DataFrame:
    """One memory per turn, with type, layer, flags and times as fixed functions of the ids. rows: turns in place of the table's."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet") if rows is None else rows
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    k = F.col("conv_id") * 7 + F.col("turn")
    kind = F.element_at(F.array(*map(F.lit, ("profile", "relationship", "event", "event", "summary"))), (k % 5 + 1).cast("int"))
    updated = F.timestamp_micros(F.unix_micros(F.lit(BASE_TIME).cast("timestamp")) + F.col("turn") * 86_400_000_000 + F.col("conv_id") * 3_600_000_000)
    meta = metadata(entities=text.entities(F.col("text")), keywords=text.keywords(F.col("text"), keyword_cap), is_summary=k % 5 == 4, summary_kind=F.when(k % 5 == 4, F.lit("rolling_v1")))
    return rows.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat(F.lit("chat-"), F.col("conv_id")).alias("chat_id"), F.concat(F.lit("char-"), F.col("conv_id") % 7).alias("character_id"),
        kind.alias("type"), F.trim("text").alias("content"), text.normalize_content(F.col("text")).alias("normalized_content"),
        F.when(k % 4 == 0, F.lit("manual")).otherwise(F.lit("auto")).alias("source"), F.when(k % 3 == 0, F.lit("stable")).otherwise(F.lit("episodic")).alias("layer"),
        ((F.col("turn") % 10) / 10.0).alias("importance"), updated.alias("created_at"), updated.alias("updated_at"),
        F.lit(None).cast("timestamp").alias("last_accessed_at"), F.lit(0).cast("long").alias("access_count"), (k % 11 == 0).alias("pinned"), (k % 13 == 0).alias("archived"), meta.alias("metadata"),
    )


def access_log_from_events(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """id, ts: views and clicks as uses of memories, moved to the memories' time. rows: events in place of the table's, such as a stream of it."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet") if rows is None else rows
    rows = rows.filter(F.col("event_type").isin("view", "click"))
    return rows.select(F.concat_ws("-", "user_id", (F.col("event_id") % 8)).alias("id"), (F.col("ts") + F.expr("interval 790 days")).alias("ts"))
