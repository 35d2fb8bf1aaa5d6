"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def normal(rows):
    def cell(v):
        if v is None or v != v:
            return "NULL"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


OWN = entry.catalog.ORACLES | entry.folds.ORACLES | entry.more.ORACLES


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_equals_sql(name, spark, duck):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert normal(map(tuple, got.select(*columns).collect())) == normal(expected)


#: What must differ between rows, so that rules and their opposites are compared.
VARIED = {
    "said_features": ["question_like", "scene_query", "cues", "durable", "durable_statement", "relationship_question", "scene_question", "detail"],
    "said_types": ["blocked", "preference", "profile", "relationship", "event", "type", "layer", "importance"],
    "said_extracts": ["type", "layer", "content", "keywords", "entities"],
    "lemma_features": ["keywords", "entities"],
    "said_scores": ["keyword_overlap", "entity_overlap", "cue_overlap", "scene", "echo", "detail", "passed", "score"],
    "said_layered": ["ret_layer", "selected", "rank", "filtered_by_diversity", "reason"],
    "said_metrics": ["total_candidates", "selected_count", "filtered_by_diversity", "reason_filtered_near_duplicate", "selected_summary", "selected_stable", "selected_episodic"],
    "evaluate_expected": ["passed", "retrieved", "missing_top", "missing", "forbidden", "layers"],
    "evaluate_cases": ["passed", "missing_top"],
    "said_snapshot": ["importance", "keywords", "updated_at"],
    "said_decisions": ["decision", "reason", "branch", "matched_id"],
    "said_shadowed": ["related_id"],
    "said_consolidation": ["type", "related_id"],
    "card_ages": ["freshness", "activity", "touch_state", "recency"],
    "said_summaries": ["action", "summary_text", "keywords"],
    "resumed_summaries": ["action", "summary_text", "new_input_count", "summarized_count"],
    "summaries_from_state": ["action", "summary_text", "new_input_count", "summarized_count"],
    "decisions_from_stream": ["decision", "branch", "matched_id", "importance"],
    "said_soft_matches": ["existing_id", "n_entities", "n_keywords"],
    "said_passing": ["rank", "score"],
    "anchors_beside_blocks": ["n_anchors", "truncated"],
    "lore_allowed": ["lore_tags", "allowed"],
    "audit_notes": ["block_length", "notes"],
    "chat_labels": ["display_label", "has_friendly_label"],
}


@pytest.fixture(scope="module")
def larger():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir("/root/testdata/sf0.01"):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '/root/testdata/sf0.01/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(VARIED))
def test_branches_occur(name, larger):
    counts = ", ".join(f"count(DISTINCT coalesce({c}::VARCHAR, 'NULL')) AS {c}" for c in VARIED[name])
    found = larger.execute(f"SELECT {counts} FROM ({OWN[name]})")
    assert {d[0]: n for d, n in zip(found.description, found.fetchone(), strict=True) if n < 2} == {}


def values(con, name, column):
    return {r[0] for r in con.execute(f"SELECT DISTINCT {column} FROM ({OWN[name]})").fetchall()}


@pytest.mark.parametrize("name", ["resumed_summaries", "summaries_from_state"])
def test_all_actions_of_summaries_occur(name, larger):
    # Whoever has inputs enough later on only, has a summary of its own by then, so the resumed ones are never created.
    created = {"created"} if name == "summaries_from_state" else set()
    assert values(larger, name, "action") == created | {"updated", "skipped_not_enough_inputs", "skipped_not_enough_new_inputs"}
    assert larger.execute(f"SELECT count(*) FROM ({OWN[name]}) WHERE new_input_count BETWEEN 1 AND summarized_count - 1").fetchone()[0] > 0


def test_all_decisions_of_the_streaming_store_occur(larger):
    assert values(larger, "decisions_from_stream", "decision || ' ' || branch") == {"stored new", "updated exact", "updated soft", "skipped_exact_protected exact"}


def test_keys_come_again_after_eviction(larger):
    assert larger.execute(f"SELECT max(n) FROM (SELECT count(*) AS n FROM ({OWN['evicted_keys_from_batches']}) GROUP BY turn_key)").fetchone()[0] > 1


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_soft_matches_reach_all_older_memories(spark):
    """More memories a character than the limit of 200 that holds for a chat."""
    sf, con = "/root/testdata/sf0.1", duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    sql = entry.oracle_sql()["soft_matches"]
    found = con.execute(sql)
    got = entry.queries()["soft_matches"](spark, sf).select(*[d[0] for d in found.description])
    assert normal(map(tuple, got.collect())) == normal(found.fetchall())
