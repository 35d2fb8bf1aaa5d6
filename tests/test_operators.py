import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from memspark.functions import memory as m
from memspark.functions import text as t
from memspark.functions.policy import BudgetPolicy, ScorePolicy, SummaryPolicy
from memspark.operators import blocks, changes, duplicates, evaluate, extract, insight, retrieve, store, summary
from memspark.sources import memories as src

def now():
    return F.lit("2026-03-27 00:00:00").cast("timestamp")


BASE = dt.datetime(2026, 3, 20)
FIELDS = "id string, chat_id string, character_id string, type string, content string, source string, layer string, importance double, updated_at timestamp, access_count long, pinned boolean, archived boolean, last_accessed_at timestamp, summary boolean, review string"
LEMMAS = {"доверяет": "доверять", "доверие": "доверие", "кошек": "кошка", "кошки": "кошка", "любит": "любить", "анны": "анна", "анна": "анна", "борису": "борис", "борис": "борис", "встрече": "встреча", "решили": "решить", "аллергия": "аллергия", "орехи": "орех", "орехов": "орех"}


@pytest.fixture
def mem(spark):
    def make(*rows, lemmas=None):
        full = []
        for i, r in enumerate(rows):
            d = {"id": f"m{i}", "chat_id": "c", "character_id": "p", "type": "event", "content": "", "source": "auto", "layer": "episodic", "importance": 0.5, "updated_at": BASE, "access_count": 0, "pinned": False, "archived": False, "last_accessed_at": None, "summary": False, "review": None} | r
            full.append(tuple(d[c.split(" ")[0]] for c in FIELDS.split(", ")))
        df = spark.createDataFrame(full, FIELDS)
        meta = src.metadata(entities=t.entities(F.col("content"), lemmas=lemmas), keywords=t.keywords(F.col("content"), lemmas=lemmas), is_summary=F.col("summary"), summary_kind=F.when(F.col("summary"), F.lit("rolling_v1")), review_status=F.col("review"))
        return df.withColumns({"metadata": meta, "normalized_content": t.normalize_content(F.col("content")), "created_at": F.col("updated_at")}).select(*src.COLUMNS)

    return make


def one(spark, expr, *texts):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").orderBy("i").select(expr(F.col("x"))).collect()]


def test_text_functions(spark):
    assert one(spark, t.normalize_content, "Hello,  World! It's_ok", "Спор: «да»?") == ["hello world its_ok", "спор да"]
    assert one(spark, t.normalize_similarity, " A-b. ", "x") == ["a b ", "x"]
    assert one(spark, t.normalize_report, " A_b  c. ") == ["a b c "]
    assert one(spark, t.keywords, "The red RED fox and, the 42 foxes of my") == [["red", "fox", "foxes"]]
    assert one(spark, lambda c: t.entities(c), "with Anna and anna and Anna. Then Anna") == [["Anna"]]
    assert one(spark, t.is_question_like, "что дальше", " Really? ", "No.", "", None) == [True, True, False, False, False]
    assert one(spark, t.relationship_cues, "они поссорились", "снова ссорились и помирились", "Они снова доверяют") == [[], ["conflict", "repair"], ["trust"]]
    assert one(spark, t.is_durable_statement, "Она снова доверяет ему", "они начали спорить, но снова доверяет", "дождь") == [True, False, False]
    assert one(spark, lambda c: t.truncate_at_sentence(c, 20), "short", "One two three. four five six", "a" * 30) == ["short", "One two three.", "a" * 20 + "..."]
    assert one(spark, lambda c: t.truncate_at_blank(c, 10), "one two three four", "x" * 12, " a  b ") == ["one two...", "x" * 10 + "...", "a b"]
    assert one(spark, t.friendly_label, "my-cool_chat", "Room-7", "", "plain", "x" * 40) == ["My Cool Chat", "Room 7", "Unnamed chat", "plain", "x" * 33 + "..."]
    assert one(spark, lambda c: t.count_block_items(c), "h\n- a\n - b\nc", None) == [2, 0]


def test_buckets(spark):
    rows = [(0, None, 0), (7, None, 0), (8, 3, 1), (31, 20, 4), (31, 20, 5), (40, None, 0)]
    at = lambda d: None if d is None else dt.datetime(2026, 3, 27) - dt.timedelta(days=d)
    df = spark.createDataFrame([(i, at(u), at(a), n) for i, (u, a, n) in enumerate(rows)], "id int, updated_at timestamp, last_accessed_at timestamp, access_count long")
    got = [(r["freshness"], r["activity"], r["touch_state"]) for r in m.cards(df, now()).orderBy("id").collect()]
    assert got == [("fresh", "never_used", "recently_updated"), ("fresh", "never_used", "recently_updated"), ("warm", "active", "recently_accessed"), ("stale", "low_use", "quiet"), ("stale", "active", "quiet"), ("stale", "never_used", "stale_unused")]


def messages(spark, *texts, role="assistant"):
    return spark.createDataFrame([("r", "c", "p", i, role, x) for i, x in enumerate(texts)], "request_id string, chat_id string, character_id string, msg_idx int, role string, text string")


@pytest.mark.parametrize(
    "text,kind,layer",
    [
        ("I love strong black coffee", "profile", "stable"),
        ("Alice works as a night nurse", "profile", "stable"),
        ("Alice met Bob at the old harbour", "event", "episodic"),
        ("Bob is my brother and helper", "relationship", "stable"),
        ("Они снова доверяют друг другу", "relationship", "stable"),
        ("Вчера они пошли на рынок вместе", "event", "episodic"),
        ("The weather remains quite grey", None, None),
        ("ok", None, None),
    ],
)
def test_types_and_layers(spark, text, kind, layer):
    got = extract.classify(messages(spark, text)).first()
    assert (got["type"], got["layer"]) == (kind, layer)


def test_user_questions_are_no_memories(spark):
    text = "Они снова доверяют друг другу?"
    assert extract.classify(messages(spark, text, role="user")).first()["type"] is None
    assert extract.classify(messages(spark, text)).first()["type"] == "relationship"


def test_extract_takes_three_per_request(spark):
    got = extract.extract(messages(spark, *[f"Alice met friend number {i} today" for i in range(5)], "nothing here at all")).orderBy("msg_idx").collect()
    assert [r["msg_idx"] for r in got] == [0, 1, 2] and len({r["id"] for r in got}) == 3


def test_gate_reasons(mem):
    texts = {"": "empty_content", "?!": "content_too_short", "ok": "low_value_pattern", "short one": "content_too_short", "antidisestablishment words": "too_few_words", "red foxes hunting": "has_keywords", "we go to it by us": "rich_content", "so it is on": "content_too_short", "is as so on": "content_too_short", "is is as so o": "rich_content"}
    got = {r["content"]: r["gate_reason"] for r in extract.quality_gate(mem(*[{"content": x} for x in texts])).collect()}
    assert {k: got[k] for k in texts} == texts
    assert extract.quality_gate(mem({"source": "manual"})).first()["gate_reason"] == "non_auto_bypass"


def test_overlap_pairs_equal_all_pairs(spark):
    rng = random.Random(4)
    sets = [(f"d{i:03d}", "ab"[i % 2], rng.sample("abcdefghijklmnop", rng.randrange(0, 9))) for i in range(120)]
    df = spark.createDataFrame(sets, "id string, lang string, tok array<string>")
    got = {r["id"]: r["n_links"] for r in duplicates.overlap_report(df, ["lang"], F.col("tok"), 85).collect()}
    near = lambda a, b: a and b and 100 * len(set(a) & set(b)) >= 85 * min(len(a), len(b))
    assert got == {i: sum(bool(near(x, y)) for j, k, y in sets if j != i and k == s) for i, s, x in sets}


def test_soft_match_takes_the_newest_that_may_change(mem):
    same = "In the harbour Alice planned birthday party"
    old = mem({"content": same, "updated_at": BASE}, {"content": same, "updated_at": BASE + dt.timedelta(1)}, {"content": same, "updated_at": BASE + dt.timedelta(2), "pinned": True}, {"content": same, "type": "profile", "updated_at": BASE + dt.timedelta(3)})
    new = mem({"id": "x", "content": "Then Alice moved her birthday party"}, {"id": "y", "content": "then alice moved her birthday party"})
    assert [(r["candidate_id"], r["existing_id"]) for r in duplicates.soft_matches(new, old).collect()] == [("x", "m1")]


def test_store_batch(mem):
    old = mem({"content": "Alice likes tea very much"}, {"content": "Bob likes tea very much", "source": "manual"}, {"content": "In town Carol planned birthday party", "type": "event"})
    new = mem(
        {"id": "a", "content": "alice likes TEA very much!!"}, {"id": "b", "content": "Bob likes tea very much"}, {"id": "c", "content": "Then Carol moved her birthday party to the big garden behind the house"},
        {"id": "d", "content": "A wholly new thing happened here"}, {"id": "e", "content": "a wholly new thing happened here."}, {"id": "f", "content": "ok"},
    ).withColumns({"request_id": F.lit("r"), "seq": F.ascii("id")}).drop("normalized_content")
    snapshot, decided = store.store(old, new, now())
    got = {r["id"]: (r["decision"], r["reason"], r["matched_id"]) for r in decided.collect()}
    assert got == {
        "a": ("updated", "exact_match_auto_updated", "m0"), "b": ("skipped_exact_protected", "exact_match_not_auto_updatable", "m1"), "c": ("updated", "soft_match_auto_updated", "m2"),
        "d": ("stored", "new_memory_created", None), "e": ("updated", "exact_match_auto_updated", "d"), "f": ("skipped_low_value", "low_value_pattern", None),
    }
    rows = {r["id"]: r for r in snapshot.collect()}
    assert set(rows) == {"m0", "m1", "m2", "d"}
    assert rows["m0"]["importance"] == pytest.approx(0.55) and rows["m2"]["importance"] == pytest.approx(0.53) and rows["d"]["importance"] == pytest.approx(0.55)
    assert rows["m2"]["content"].startswith("Then Carol") and rows["m0"]["content"] == "Alice likes tea very much" and "garden" in rows["m2"]["metadata"]["keywords"]
    counters = store.store_counters(decided).first()
    assert (counters["stored"], counters["updated"], counters["skipped"]) == (1, 3, 2)
    metrics = {(r["dimension"], r["label"]): r["n"] for r in store.store_metrics(decided).collect()}
    assert metrics["decision", "updated"] == 3 and metrics["branch", "exact"] == 3 and metrics["reason", "low_value_pattern"] == 1


def ask(spark, text, top=5, recent=()):
    return spark.createDataFrame([("r", "c", "p", text, [Row(role="user", text=x) for x in recent], top, False)], "request_id string, chat_id string, character_id string, user_input string, recent_messages array<struct<role:string,text:string>>, `limit` int, include_archived boolean")


def greedy(entries, top, p):
    """The selection rule on (id, score, layer, tokens), all updated at one time."""
    prio = {"summary": 2, "stable": 1, "episodic": 0}

    def banded(es):
        es, out = sorted(es, key=lambda e: -e[1]), []
        while es:
            band = [e for e in es if es[0][1] - e[1] <= p.band]
            es = es[len(band) :]
            out += sorted(band, key=lambda e: (prio[e[2]], e[0]), reverse=True)
        return out

    chosen = []
    near = lambda e: any(len(e[3] & c[3]) / min(len(e[3]), len(c[3])) >= p.similar for c in chosen)
    if top >= 3:
        for layer in prio:
            hit = next((e for e in banded([e for e in entries if e[2] == layer]) if not near(e)), None)
            if hit:
                chosen.append(hit)
    for capped in (True, False):
        for e in banded(entries):
            if len(chosen) < top and e not in chosen and not (capped and sum(c[2] == e[2] for c in chosen) >= p.caps[e[2]]) and not near(e):
                chosen.append(e)
    return sorted(chosen, key=lambda e: (e[1], e[0]), reverse=True)


@pytest.mark.parametrize("top", [1, 3, 5])
def test_layered_selection_equals_the_rule(spark, top):
    rng, rows, p = random.Random(top), [], ScorePolicy()
    for r in range(25):
        for i in range(rng.randrange(1, 14)):
            words = rng.sample("abcdefghijkl", rng.randrange(1, 5))
            rows.append((f"r{r}", f"m{i:02d}", round(rng.uniform(0.1, 0.6), 3), rng.choice(["summary", "stable", "episodic"]), " ".join(words), words, BASE, top))
    df = spark.createDataFrame(rows, "request_id string, id string, score double, ret_layer string, norm string, tokens array<string>, updated_at timestamp, top int").withColumn("passed", F.col("score") >= p.threshold)
    for parts in (1, 7):
        got = {r["request_id"]: [s["id"] for s in r["selected"]] for r in retrieve.select_layered(df.repartition(parts), p).collect()}
        for r in got:
            entries = [(x[1], x[2], x[3], set(x[5])) for x in rows if x[0] == r and x[2] >= p.threshold]
            assert got[r] == [e[0] for e in greedy(entries, top, p)]


def test_scores(spark, mem):
    memories = mem({"content": "with Alice jazz concert", "importance": 1.0, "layer": "stable", "type": "profile", "pinned": True}, {"content": "rain falls"}, {"content": "jazz elsewhere", "importance": 0.0})
    got = {r["id"]: r for r in retrieve.retrieve(ask(spark, "does Alice like jazz"), memories, now(), prune=False).collect()}
    assert got["m1"]["score"] == 0 and got["m1"]["recency"] == 0 and got["m1"]["reason"] == "below_threshold"
    kw, rec = 1 / 4, 1 / 8
    kws = ["does", "alice", "like", "jazz"]
    kw = 2 / len(kws)
    content = 0.65 * kw + 0.35
    expected = 0.5 * kw + 0.25 + 0.10 + (1.0 if content >= 0.6 else 0.6) * (0.12 + 0.03 * rec + 0.05)
    assert got["m0"]["score"] == pytest.approx(expected) and got["m0"]["rank"] == 1
    pruned = {r["id"]: r["score"] for r in retrieve.retrieve(ask(spark, "does Alice like jazz"), memories, now()).collect()}
    assert pruned == {i: r["score"] for i, r in got.items() if r["score"] > 0}


def test_labelled_cases(spark, mem):
    rows = {
        "preference": ("Что любит Анна?", [{"id": "cats", "content": "Известно, что Анна любит кошек", "layer": "stable", "type": "profile"}, {"id": "noise", "content": "Поезд ушёл рано утром"}], ["cats"], [], ["noise"]),
        "allergy": ("Есть ли аллергия на орехи?", [{"id": "old", "content": "У него аллергия, орехи опасны", "layer": "stable", "type": "profile", "importance": 0.95, "updated_at": dt.datetime(2026, 1, 1)}, {"id": "fresh", "content": "Сегодня шумный рынок"}], ["old"], [], ["fresh"]),
        "brother": ("Who is the brother of Alice", [{"id": "bro", "content": "The brother of Alice is Tom", "layer": "stable", "type": "relationship"}, {"id": "trip", "content": "A trip over mountains"}], ["bro"], ["bro"], ["trip"]),
        "wrong": ("Tell about jazz concert", [{"id": "jazz", "content": "jazz concert was loud"}], ["other"], [], []),
    }
    cases = spark.createDataFrame([(n, q, [], 2, top, has, bad, {}) for n, (q, _, top, has, bad) in rows.items()], evaluate.CASES)
    memories = None
    for n, (_, ms, *_) in rows.items():
        own = mem(*ms, lemmas=LEMMAS).withColumn("name", F.lit(n))
        memories = own if memories is None else memories.unionByName(own)
    results = evaluate.evaluate(cases, memories, now(), lemmas=LEMMAS)
    got = {r["name"]: r for r in results.collect()}
    assert {n: r["passed"] for n, r in got.items()} == {"preference": True, "allergy": True, "brother": True, "wrong": False} and got["wrong"]["missing_top_ids"] == ["other"]
    assert tuple(evaluate.summary(results).first()) == (4, 3, 1)
    assert {r["name"]: r["status"] for r in evaluate.report(evaluate.matching_cases(results, "WRO")).collect()} == {"wrong": "FAIL"}


def trimmed(items, p):
    """The budget rule as a loop over (rank, layer, line)."""
    seen, kept, why = {}, [], []
    for it in items:
        seen[it[1]] = seen.get(it[1], 0) + 1
        (kept if seen[it[1]] <= p.caps[it[1]] else why).append(it)
    why = [f"layer_cap:{it[1]}" for it in why]
    size = lambda: len("\n".join(["[Relevant Memory]", *[x[2] for x in kept]])) if kept else 0
    while kept and (len(kept) > p.items or size() > p.chars):
        name = "item_cap" if len(kept) > p.items else "char_budget"
        last = next(x for layer in ("episodic", "stable", "summary") for x in reversed(kept) if x[1] == layer)
        kept.remove(last)
        why.append(f"{name}:{last[1]}")
    return kept, why


def test_budget_equals_the_loop(spark):
    rng, p = random.Random(8), BudgetPolicy(items=3, chars=150)
    rows = [(f"r{r}", i + 1, f"i{i}", "word " * rng.randrange(1, 18), bool(rng.randrange(2)), rng.choice(m.LAYERS)) for r in range(60) for i in range(rng.randrange(1, 8))]
    df = spark.createDataFrame(rows, "request_id string, rank int, id string, content string, pinned boolean, ret_layer string")
    lines = {(r["request_id"], r["rank"]): r["line"] for r in blocks.budget_items(df, p).collect()}
    for r in blocks.budget_blocks(df, p).collect():
        items = [(x[1], x[5], lines[x[0], x[1]]) for x in rows if x[0] == r["request_id"]]
        kept, why = trimmed(items, p)
        assert r["block"] == ("\n".join(["[Relevant Memory]", *[x[2] for x in kept]]) if kept else "") and r["trim_reasons"] == why and r["actual_chars"] <= p.chars


def test_blocks_drop_repeats(spark):
    rows = [("r", 1, "Tea is good", True, "stable"), ("r", 2, "tea IS good", False, "stable"), ("r", 3, " ", False, "episodic"), ("r", 4, "rain", False, "summary")]
    got = blocks.format_blocks(spark.createDataFrame(rows, "request_id string, rank int, content string, pinned boolean, ret_layer string")).first()
    assert got["block"] == "[Relevant Memory]\n- [PINNED] [STABLE] Tea is good\n- [SUMMARY] rain"


def test_lore_anchors(spark):
    raw = [
        ("r", 0, "1", "plain", "no anchor", None), ("r", 1, "2", "note", "[memory-anchor]\nThe bridge is  closed", None), ("r", 2, "3", "@memory-anchor: The bridge is closed", "x", None), ("r", 3, "4", "", "Known fact", "Memory-Anchor, a"), ("r", 4, "5", None, "third", "memory-anchor"),
        ("s", 0, "6", None, "long " * 80, "memory-anchor"),
    ]
    entries = src.lore_entries(spark.createDataFrame(raw, "request_id string, pos int, uid string, comment string, content string, tags string"))
    known = spark.createDataFrame([("r", "- known FACT stands here")], "request_id string, block string")
    got = {r["request_id"]: r for r in blocks.anchor_blocks(entries, known, max_items=2).collect()}
    assert got["r"]["anchor_block"] == "[Lore Anchor]\n- The bridge is closed\n- third"
    assert got["s"]["truncated"] and len(got["s"]["anchor_block"]) <= 220 and got["s"]["anchor_block"].endswith("…")


def test_rolling_summary(mem):
    day = lambda n: BASE + dt.timedelta(n)
    rows = [{"id": f"e{i}", "content": x, "updated_at": day(i)} for i, x in enumerate(["Анна хочет уехать.", "Они поссорились вчера", "Борис решил остаться", "Дождь шёл весь день"])]
    memories = mem(*rows, {"id": "z", "chat_id": "other", "content": "alone here"})
    results = summary.rolling_summary(memories, now())
    got = {r["chat_id"]: r for r in results.collect()}
    assert got["c"]["action"] == "created" and got["c"]["source_ids"] == ["e0", "e1", "e2", "e3"] and got["other"]["action"] == "skipped_not_enough_inputs"
    assert got["c"]["summary_text"] == (
        "Краткая сводка последних эпизодов (4): Недавние события: Дождь шёл весь день; Борис решил остаться; Они поссорились вчера. "
        "Изменения в отношениях: Они поссорились вчера. Текущие цели и состояние: Борис решил остаться; Анна хочет уехать."
    )
    after = summary.apply_summaries(memories, results, now())
    assert after.count() == 6
    again = {r["chat_id"]: r for r in summary.rolling_summary(after, now()).collect()}
    assert again["c"]["action"] == "skipped_not_enough_new_inputs" and again["c"]["new_input_count"] == 0
    more = after.unionByName(mem(*[{"id": f"n{i}", "content": f"новое дело {i}", "updated_at": day(10 + i)} for i in range(3)]))
    last = summary.rolling_summary(more, now(), SummaryPolicy()).filter("chat_id = 'c'").first()
    assert last["action"] == "updated" and last["new_input_count"] == 3 and last["metadata"]["summarized_memory_count"] == 7


def test_changes_and_toggles(spark, mem):
    memories = mem({"content": "one thing"}, {"content": "two things", "pinned": True}, {"content": "three"})
    feed = [("m0", 1, "update", 0.9, None), ("m0", 2, "update", None, " New Text! "), ("m0", 3, "update", 0.2, None), ("m1", 4, "toggle_pinned", None, None), ("m1", 5, "toggle_archived", None, None), ("m1", 6, "toggle_archived", None, None), ("m2", 7, "delete", None, None), ("gone", 8, "update", 0.1, None)]
    df = spark.createDataFrame(feed, "id string, seq long, action string, importance double, content string").withColumn("ts", now())
    got = {r["id"]: r for r in changes.apply_changes(memories, df).collect()}
    assert set(got) == {"m0", "m1"} and got["m0"]["importance"] == 0.2 and got["m0"]["content"] == "New Text!" and got["m0"]["normalized_content"] == "new text"
    assert not got["m1"]["pinned"] and not got["m1"]["archived"]


def test_reviews_keep_history(spark, mem):
    reviews = [("m0", 1, "mark_reviewed_keep", "", "first"), ("m0", 2, "odd", "rel", None), ("m1", 3, "mark_consolidated_archive", None, None)]
    df = spark.createDataFrame(reviews, "id string, seq long, action string, related_memory_id string, note string").withColumn("ts", now())
    got = {r["id"]: r for r in changes.apply_reviews(mem({"content": "a"}, {"content": "b"}, {"content": "c"}), df).collect()}
    meta = got["m0"]["metadata"]
    assert (meta["review_status"], meta["related_memory_id"], meta["consolidation_note"]) == ("reviewed_keep", "rel", "first") and [h["action"] for h in meta["consolidation_history"]] == ["mark_reviewed_keep", "odd"]
    assert got["m1"]["archived"] and got["m1"]["metadata"]["review_status"] == "consolidated_archive" and got["m2"]["metadata"]["consolidation_history"] == []


def test_consolidation(mem):
    memories = mem(
        {"content": "Alice plants red roses daily", "updated_at": BASE}, {"content": "alice plants red roses, daily!", "updated_at": BASE - dt.timedelta(1)}, {"content": "Alice plants red roses daily", "pinned": True},
        {"content": "storm broke window", "updated_at": dt.datetime(2026, 1, 1)}, {"content": "Alice plants red roses daily", "chat_id": "x"}, {"content": "alice plants red roses daily", "review": "reviewed_keep", "updated_at": BASE + dt.timedelta(1)},
    )
    got = {(r["id"], r["type"], r["related_id"]) for r in insight.consolidation_candidates(memories, now()).collect()}
    assert got == {("m0", "near_duplicate", "m1"), ("m1", "near_duplicate", "m0"), ("m3", "stale_low_value_episode", None)}
    counts = insight.consolidation_summary(insight.consolidation_candidates(memories, now())).first()
    assert (counts["total_candidates"], counts["near_duplicate"], counts["stale_low_value_episode"]) == (3, 2, 1)
    page = insight.browse(memories, now(), consolidation="near_duplicate", sort="stalest_first")
    assert [r["id"] for r in page.collect()] == ["m1", "m0"]


@pytest.mark.parametrize("seed", range(3))
def test_candidates_without_pairs_are_those_of_the_pairs(mem, seed):
    rng = random.Random(seed)
    words = "alice plants red roses daily in spring near old harbour walls".split()
    texts = [" ".join(rng.sample(words, rng.randrange(1, 9))) for _ in range(25)] + ["...", "...", "!", " ... "]
    memories = mem(*[{"content": rng.choice(texts), "chat_id": rng.choice("xy"), "pinned": rng.random() < 0.1, "review": rng.choice([None, None, "reviewed_keep"]), "updated_at": BASE - dt.timedelta(minutes=i)} for i in range(70)])
    pairs, ids = (insight.consolidation_candidates(memories, now(), pairs=p).filter("type = 'near_duplicate'").collect() for p in (True, False))
    assert len(pairs) > 2 * len(ids) > 0 and {(r["id"], r["related_id"]) for r in ids} <= {(r["id"], r["related_id"]) for r in pairs}
    assert sorted(r["id"] for r in ids) == sorted({r["id"] for r in pairs})


def test_sources(spark, mem, tmp_path):
    memories = mem({"content": "Keep this"}, {"content": "bad", "importance": 3.0})
    flat = src.encode_flat(memories)
    assert sorted(map(str, src.decode_flat(flat).collect())) == sorted(map(str, memories.collect()))
    valid, bad = src.split_valid(memories)
    assert valid.count() == 1 and bad.first()["violations"] == ["importance"]
    src.append_memories(valid, str(tmp_path / "m"))
    src.append_memories(valid.withColumn("id", F.lit("again")), str(tmp_path / "m"))
    assert src.read_memories(spark, str(tmp_path / "m")).count() == 2
    assert [r["line"] for r in src.message_lines(spark.createDataFrame([(" a \n\n b",)], "text string")).collect()] == ["a", "b"]
    assert one(spark, src.parse_list, " a, ,b ", None) == [["a", "b"], []]
    groups = insight.chat_groups(memories, now())
    assert insight.select_group(groups, "c", "p").first()["total_count"] == 2 and insight.select_group(groups, "x", "y").count() == 1 and insight.select_group(groups, None, None, "all").count() == 0


def test_entities_are_chosen_in_one_pass(spark):
    """A text of 40,000 names; each of them used to read the whole text again."""
    names = " ".join(f"Name{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} NAME" for i in range(20_000))
    assert one(spark, lambda c: t.entities(c, 3), f"with Anna, Anna and {names}") == [["Anna", "Nameaa", "Nameba"]]


def test_patterns_are_tried_only_on_texts_that_hold_what_they_require(spark):
    patterns = [r"\bкак .* относ\w*", r"\bчто у (?:них|неё) сейчас\b", r"^\s*они\b", r"ab?c", r"(?i)loud", r"one|two", r"x{2}y"]
    assert [t.required(p) for p in patterns] == [["как ", " относ"], ["что у "], [], ["a"], [], [], []]
    texts = ["и как он относится", "как относится", "что у неё сейчас", "что у него сейчас", " они", "но они", "ac", "bc", "LOUD", "two", "xxy", "xy", "", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    for chosen in [patterns, *([p] for p in patterns)]:
        plain = F.col("x").rlike("(?U)" + "|".join(f"(?:{p})" for p in chosen))
        assert rows.filter(~t.matches(F.col("x"), chosen).eqNullSafe(plain)).count() == 0
