"""Layered selection from a frontier against selection from all entries, and scoring with bounds."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from memspark.functions.policy import ScorePolicy
from memspark.operators import retrieve
from memspark.plans import more

SCORED = "request_id string, top int, id string, ret_layer string, score double, updated_at timestamp, norm string, tokens array<string>, passed boolean"


def entries(seed, n, words):
    rng = random.Random(seed)
    return [{"score": rng.choice([0.9, 0.8, 0.78, 0.5, 0.47, 0.3]) + rng.choice([0, 0.01]), "updated_at": rng.randint(0, 9), "id": f"m{i:03}", "layer": rng.choice(retrieve.PRIORITY), "norm": rng.choice(["", *map(str, range(n))]), "tokens": set(rng.sample(words, 4))} for i in range(n)]


@pytest.mark.parametrize("words", [list("abcdef"), list("abcdefghijklmnopqrstuvwxyz")])
def test_a_frontier_chooses_the_same_or_asks_for_more(words):
    p, deeper = ScorePolicy(), 0
    for seed in range(300):
        everything, top = entries(seed, 40, words), seed % 7
        whole = retrieve.select_entries(everything, top, p)
        for size in (1, 3, 8):
            kept, cuts = [], {}
            for layer in retrieve.PRIORITY:
                own = sorted((e for e in everything if e["layer"] == layer), key=lambda e: (-e["score"], e["id"]))
                kept += own[: size + 1]
                if len(own) > size:
                    cuts[layer] = own[size]["score"]
            try:
                assert retrieve.select_entries(kept, top, p, cuts) == whole
            except retrieve.NeedsDeeper:
                deeper += 1
    assert 50 < deeper < 800


def test_requests_run_again_until_their_frontier_is_deep_enough(spark):
    p, rows, words = ScorePolicy(), [], list("abcdefgh")
    for r in range(12):
        some = entries(r, 150, words[: 5 + r % 3 * 3])
        rows += [(f"r{r}", r % 6, e["id"], e["layer"], e["score"], None, e["norm"], sorted(e["tokens"]), r != 5) for e in some]
    df = spark.createDataFrame(rows, SCORED)
    shown = lambda got: {r["request_id"]: ([x["id"] for x in r["selected"]], r["filtered_ids"]) for r in got.collect()}
    whole = shown(retrieve.select_layered(df, p, 10_000))
    assert shown(retrieve.select_layered(df, p, 2)) == whole
    assert len(whole) == 11


def test_a_million_entries_of_one_request(spark):
    n = 1_000_000
    rows = spark.range(n).select(
        F.lit("r").alias("request_id"), F.lit(5).alias("top"), F.format_string("m%07d", "id").alias("id"), F.element_at(F.array(*map(F.lit, retrieve.PRIORITY)), (F.col("id") % 3 + 1).cast("int")).alias("ret_layer"),
        (F.lit(0.3) + F.pmod(F.xxhash64("id"), F.lit(600_000)) / 1e6).alias("score"), F.lit(None).cast("timestamp").alias("updated_at"), F.col("id").cast("string").alias("norm"),
        F.array(*[F.concat(F.lit(x), F.col("id")) for x in "abc"]).alias("tokens"), F.lit(True).alias("passed"),
    )
    got = retrieve.select_layered(rows).collect()
    assert [len(r["selected"]) for r in got] == [5]
    best = {r["ret_layer"]: r["m"] for r in rows.groupBy("ret_layer").agg(F.max("score").alias("m")).collect()}
    chosen = got[0]["selected"]
    assert {x["layer"] for x in chosen} == set(best)
    assert all(best[x["layer"]] - x["score"] < ScorePolicy().band + 1e-9 for x in chosen)


@pytest.mark.parametrize("at_least", [0.05, 0.3, 0.55])
def test_bounds_drop_only_what_cannot_reach_the_score(spark, at_least):
    sf = "/root/testdata/sf0.001"
    asked, known = more.said_requests(spark, sf, 3)
    features, held = retrieve.query_features(asked, more.SCORING), retrieve.memory_features(known)
    show = lambda df: sorted((r["request_id"], r["id"], r["score"]) for r in df.select("request_id", "id", "score").collect())
    whole = retrieve.score(features, held, more.as_of(), more.SCORING, prune=False)
    expected = show(whole.filter(F.col("score") >= at_least))
    assert show(retrieve.score(features, held, more.as_of(), more.SCORING, at_least=at_least)) == expected
    assert expected
    # Pairs that meet a memory's row, with bounds and without: both are written, so both can be counted.
    pick = lambda df: df.select("request_id", *retrieve.SCOPE, "in_keywords", "in_entities", "in_cues", "relationship_query", "scene_query")
    kept = held.select("id", *retrieve.SCOPE, "pinned", "importance", "updated_at", "layer", "ret_layer", "cues", "detail", F.array_distinct("metadata.keywords").alias("keywords"), F.array_distinct(F.transform("metadata.entities", F.lower)).alias("entities"))
    before, after = (retrieve._met(pick(features), kept, more.as_of(), more.SCORING, x).count() for x in (None, at_least))
    assert len(expected) <= after <= before
    assert at_least < 0.3 or after < before


def test_policies_without_bands(spark):
    p = replace(ScorePolicy(), band=0.0)
    everything = entries(1, 60, list("abcdefghijkl"))
    assert retrieve.select_entries(everything, 5, p, {"stable": 0.0})[0] == retrieve.select_entries(everything, 5, p)[0]
