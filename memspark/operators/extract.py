"""Typed memories from chat messages, by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as t
from ..functions.policy import ExtractPolicy, GatePolicy
from ..sources.memories import metadata


def blocked_question(role: Column, col: Column, p: ExtractPolicy) -> Column:
    """A user's question about a relationship or a scene, which isn't a memory."""
    asks = t.is_relationship_question(col) | t.is_scene_question(col) | (t.is_scene_query(col) & t.looks_like_event(col, p)) | t.looks_like_relationship(col, p)
    return F.coalesce((role == "user") & t.is_question_like(col) & asks, F.lit(False))


def classify(messages: DataFrame, p: ExtractPolicy | None = None) -> DataFrame:
    """messages with type, layer and importance; type is null for what is no memory."""
    p = p or ExtractPolicy()
    col = F.col("text")
    usable = (F.char_length(F.trim(col)) >= p.min_length) & ~blocked_question(F.col("role"), col, p)
    typed = messages.withColumn("type", F.when(usable, t.detect_type(col, p)))
    return typed.withColumns(
        {"layer": F.when(F.col("type").isNotNull(), t.detect_layer(F.col("type"), col, p)), "importance": F.when(F.col("type").isNotNull(), t.default_importance(F.col("type"), p))}
    )


def extract(messages: DataFrame, p: ExtractPolicy | None = None, lemmas: dict[str, str] | None = None) -> DataFrame:
    """At most p.per_request candidates a request, the first by message order. Features come from the whole text, the content is cut.

    messages: request_id, chat_id, character_id, msg_idx, role, text. Candidates carry an id derived from request and message.
    """
    p = p or ExtractPolicy()
    typed = classify(messages, p).filter("type is not null")
    first = typed.withColumn("nth", F.row_number().over(W.partitionBy("request_id").orderBy("msg_idx"))).filter(F.col("nth") <= p.per_request)
    col = F.col("text")
    return first.select(
        F.sha2(F.concat_ws("#", "request_id", "msg_idx"), 256).alias("id"),
        "request_id", "msg_idx", "chat_id", "character_id", "type",
        t.truncate_at_sentence(col, p.max_length).alias("content"),
        F.lit("auto").alias("source"), "layer", "importance", F.lit(False).alias("pinned"), F.lit(False).alias("archived"),
        metadata(entities=t.entities(col, lemmas=lemmas), keywords=t.keywords(col, lemmas=lemmas)).alias("metadata"),
    )


# The gate's reasons, here those that pass and below all.
PASSED = ("non_auto_bypass", "has_keywords", "has_entities", "rich_content")


def quality_gate(candidates: DataFrame, p: GatePolicy | None = None) -> DataFrame:
    """candidates with gate_reason and gate_ok."""
    p = p or GatePolicy()
    content = F.regexp_replace(F.col("content"), r"^\s+|\s+$", "")
    normalized = t.normalize_similarity(content)
    n_words = F.size(t.words(normalized))
    n = lambda c: F.coalesce(F.size(F.col(f"metadata.{c}")), F.lit(0))
    reason = (
        F.when(F.col("source") != "auto", F.lit("non_auto_bypass"))
        .when(content == "", F.lit("empty_content"))
        .when(normalized == "", F.lit("empty_after_normalization"))
        .when(normalized.isin(p.low_value), F.lit("low_value_pattern"))
        .when(F.char_length(content) < p.min_length, F.lit("content_too_short"))
        .when(n_words < p.min_words, F.lit("too_few_words"))
        .when(n("keywords") >= p.min_keywords, F.lit("has_keywords"))
        .when(n("entities") >= p.min_entities, F.lit("has_entities"))
        .when(n_words >= p.rich_words, F.lit("rich_content"))
        .otherwise(F.lit("insufficient_retrieval_signal"))
    )
    return candidates.withColumn("gate_reason", reason).withColumn("gate_ok", F.col("gate_reason").isin(*PASSED))
