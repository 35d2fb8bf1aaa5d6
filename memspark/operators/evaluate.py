"""Labelled retrieval cases, all evaluated in one retrieval job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import memory as m
from ..functions.policy import ScorePolicy
from .retrieve import retrieve

CASES = (
    "name string, query string, recent array<struct<role:string,text:string>>, `limit` int, top_ids array<string>, contains_ids array<string>, "
    "forbidden_ids array<string>, layer_counts map<string,int>"
)


def matching_cases(cases: DataFrame, needle: str | None = None) -> DataFrame:
    return cases.filter(F.lower("name").contains(needle.lower())) if needle else cases


def evaluate(cases: DataFrame, memories: DataFrame, as_of: Column, p: ScorePolicy | None = None, lemmas: dict[str, str] | None = None) -> DataFrame:
    """A row per case: retrieved_ids in order, missing and forbidden ids, layer mismatches, passed.

    cases: see CASES. memories: memory rows with `name`, the case they belong to; each case is a scope of its own.
    top_ids are expected at their ranks, contains_ids anywhere, forbidden_ids nowhere.
    """
    scoped = memories.withColumn("chat_id", F.col("name")).withColumn("character_id", F.lit("case")).drop("name")
    requests = cases.select(
        F.col("name").alias("request_id"), F.col("name").alias("chat_id"), F.lit("case").alias("character_id"), F.col("query").alias("user_input"), F.col("recent").alias("recent_messages"),
        F.coalesce("limit", F.lit(5)).alias("limit"), F.lit(False).alias("include_archived"),
    )
    got = retrieve(requests, scoped, as_of, p, lemmas).filter("selected")
    counts = [F.count_if(F.col("ret_layer") == x).cast("int").alias(x) for x in m.LAYERS]
    found = got.groupBy(F.col("request_id").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("retrieved_ids"), *counts)
    none = F.array().cast("array<string>")
    list_ = lambda c: F.coalesce(c, none)
    rows = cases.join(found, "name", "left").withColumns({"retrieved_ids": list_("retrieved_ids"), **{c: list_(c) for c in ("top_ids", "contains_ids", "forbidden_ids")}, **{x: F.coalesce(x, F.lit(0)) for x in m.LAYERS}})
    at_rank = F.filter("top_ids", lambda x, i: ~F.coalesce(F.get("retrieved_ids", i) == x, F.lit(False)))
    wanted = [F.when(F.coalesce(F.col("layer_counts")[x], F.col(x)) != F.col(x), F.concat(F.lit(f"{x}: "), F.col(x).cast("string"), F.lit(" for "), F.col("layer_counts")[x].cast("string"))) for x in m.LAYERS]
    rows = rows.withColumns(
        {
            "missing_top_ids": at_rank, "missing_contains_ids": F.array_except("contains_ids", "retrieved_ids"), "forbidden_present": F.array_intersect("forbidden_ids", "retrieved_ids"),
            "layer_mismatches": F.array_compact(F.array(*wanted)),
        }
    )
    failures = F.size("missing_top_ids") + F.size("missing_contains_ids") + F.size("forbidden_present") + F.size("layer_mismatches")
    return rows.withColumn("passed", failures == 0).select("name", "passed", "retrieved_ids", "missing_top_ids", "missing_contains_ids", "forbidden_present", "layer_mismatches", *m.LAYERS)


def summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def report(results: DataFrame) -> DataFrame:
    """name, status and one line of what went wrong."""
    parts = {"missing at rank": "missing_top_ids", "missing": "missing_contains_ids", "forbidden": "forbidden_present", "layers": "layer_mismatches"}
    lines = [F.when(F.size(c) > 0, F.concat(F.lit(f"{k}: "), F.array_join(c, ", "))) for k, c in parts.items()]
    return results.select("name", F.when(F.col("passed"), F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"), F.array_join("retrieved_ids", ", ").alias("retrieved"), F.concat_ws("; ", *lines).alias("details"))
