"""DuckDB SQL for the queries that go through rows one after another: layered retrieval, merging, summaries, audits, anchors, evaluation.

Recursive tables follow the rules row by row, so they share nothing with the folds and windows of the operators.
"""

from __future__ import annotations

from dataclasses import replace

from ..functions import policy
from ..functions.policy import ScorePolicy
from ..sources.memories import AS_OF
from . import oracles as o

SCORING = ScorePolicy(keywords=64, threshold=0.05)


def cues(col: str, groups: dict[str, list[str]]) -> str:
    named = ", ".join(f"CASE WHEN {o.found(f'lower({col})', p)} THEN {o.quoted(n)} END" for n, p in groups.items())
    return f"list_filter([{named}], lambda x: x IS NOT NULL)"


def requests(recent: int) -> str:
    """asked: each conversation's last user turn; recents: the features of the turns before it."""
    said = f"SELECT a.chat_id, {o.keywords('t.text', 64)} AS kw, {o.entities('t.text')} AS en, {cues('t.text', policy.RELATIONSHIP_CUES)} AS cu FROM last a JOIN turns t ON a.chat_id = t.chat_id AND t.msg_idx < a.q_turn AND t.msg_idx >= a.q_turn - {recent}"
    return f"""{o.TURNS}, last AS (SELECT chat_id, max(msg_idx) AS q_turn FROM turns WHERE role = 'user' GROUP BY chat_id),
recents AS (SELECT chat_id, flatten(list(kw)) AS kw, flatten(list(en)) AS en, flatten(list(cu)) AS cu FROM ({said}) GROUP BY chat_id),
heard AS (SELECT l.chat_id, l.q_turn, t.text AS q, {o.keywords('t.text', 64)} AS kw, {o.entities('t.text')} AS en, {cues('t.text', policy.RELATIONSHIP_CUES)} AS cu, {o.found('lower(t.text)', policy.SCENE_QUERY)} AS scene, {o.similarity('t.text')} AS qn
  FROM last l JOIN turns t ON t.chat_id = l.chat_id AND t.msg_idx = l.q_turn),
asked AS (SELECT h.chat_id, h.q_turn, scene, qn, len(h.cu) > 0 AS related, list_distinct(list_concat(h.kw, coalesce(r.kw, []))) AS kw, list_distinct([lower(x) for x in list_concat(h.en, coalesce(r.en, []))]) AS en,
  CASE WHEN len(h.cu) > 0 THEN list_distinct(list_concat(h.cu, coalesce(r.cu, []))) ELSE h.cu END AS cu, list_distinct({o.words('qn')}) AS qt FROM heard h LEFT JOIN recents r USING (chat_id))"""


def share(a: str, b: str) -> str:
    return f"CASE WHEN len({b}) > 0 THEN len(list_intersect({a}, {b})) / len({b})::DOUBLE ELSE 0 END"


def scored(recent: int, archived: bool = True, p: ScorePolicy = SCORING, request_id: str = "'q-' || m.chat_id") -> str:
    """All of a request's memories that share something with it, with the parts of their scores."""
    by_layer = lambda v: f"CASE m.ret_layer WHEN 'summary' THEN {v['summary']} WHEN 'stable' THEN {v['stable']} ELSE {v['episodic']} END::DOUBLE"
    return f"""{requests(recent)}, {o.memories(64)},
feats AS (SELECT *, {o.similarity('content')} AS norm, {cues('content', policy.RELATIONSHIP_CUES)} AS mcu, {o.detail('content')} AS d FROM memories),
tokened AS (SELECT *, list_distinct({o.words('norm')}) AS tokens FROM feats),
pairs AS (SELECT {request_id} AS request_id, m.*, a.related, a.scene, a.qn, {share('m.keywords', 'a.kw')} AS ko, {share('list_distinct([lower(x) for x in m.entities])', 'a.en')} AS eo,
  CASE WHEN a.related THEN {share('m.mcu', 'a.cu')} ELSE 0 END AS co, 1.0::DOUBLE / (1 + {o.days('m.updated_at')}) AS rec,
  m.norm <> '' AND a.qn <> '' AND (contains(a.qn, m.norm) OR CASE WHEN least(len(m.tokens), len(a.qt)) > 0 THEN len(list_intersect(m.tokens, a.qt)) / least(len(m.tokens), len(a.qt))::DOUBLE >= {p.echo} ELSE false END) AS echo
  FROM asked a JOIN tokened m ON a.chat_id = m.chat_id AND m.turn < a.q_turn{'' if archived else ' AND NOT m.archived'}),
summed AS (SELECT *, {p.keyword}::DOUBLE * ko + {p.entity}::DOUBLE * eo + {p.cue}::DOUBLE * co + CASE WHEN ko > 0 AND eo > 0 THEN {p.both} ELSE 0 END::DOUBLE
  + CASE WHEN related AND co > 0 THEN {by_layer(p.support)} ELSE 0 END::DOUBLE + CASE WHEN layer = 'episodic' AND scene AND d >= {p.detail} THEN {p.specificity} ELSE 0 END::DOUBLE
  + CASE WHEN 0.65::DOUBLE * ko + 0.35::DOUBLE * eo >= 0.60::DOUBLE THEN 1.0 WHEN 0.65::DOUBLE * ko + 0.35::DOUBLE * eo >= 0.30::DOUBLE THEN 0.6 ELSE 0.25 END::DOUBLE
    * (importance * {p.importance}::DOUBLE + rec * {p.recency}::DOUBLE + CASE WHEN pinned THEN {p.pinned} ELSE 0 END::DOUBLE)
  - CASE WHEN layer = 'episodic' AND ends_with(rtrim(content), '?') AND echo AND d < {p.detail} THEN {p.low_value} ELSE 0 END::DOUBLE AS raw FROM pairs m WHERE ko > 0 OR eo > 0 OR co > 0),
scored AS (SELECT *, least(greatest(raw, 0), 1)::DOUBLE AS score FROM summed)"""


def layered(recent: int, archived: bool = True, top: int = 5, p: ScorePolicy = SCORING, request_id: str = "'q-' || m.chat_id") -> str:
    """scored, and `reasoned`: each scored memory with its rank, what was dropped for likeness, and the reason."""
    return f"{scored(recent, archived, p, request_id)}, {selection(top, p)}"


def selection(top: int, p: ScorePolicy, source: str = "scored") -> str:
    """`reasoned` over the scored memories of `source`."""
    caps = " ".join(f"WHEN {o.quoted(k)} THEN {v}" for k, v in p.caps.items())
    return f"""passing AS (SELECT request_id, id, score, CASE ret_layer WHEN 'summary' THEN 2 WHEN 'stable' THEN 1 ELSE 0 END AS prio, updated_at, ret_layer AS lay, norm, tokens FROM {source} WHERE score >= {p.threshold}),
lists AS (SELECT *, 'all' AS sub FROM passing UNION ALL SELECT *, lay FROM passing),
numbered AS (SELECT *, row_number() OVER (PARTITION BY request_id, sub ORDER BY score DESC, id) AS n FROM lists),
bands AS (SELECT request_id, sub, n, score AS best, 0 AS band FROM numbered WHERE n = 1
  UNION ALL SELECT x.request_id, x.sub, x.n, CASE WHEN b.best - x.score > {p.band} THEN x.score ELSE b.best END, b.band + (b.best - x.score > {p.band})::INTEGER FROM bands b JOIN numbered x ON x.request_id = b.request_id AND x.sub = b.sub AND x.n = b.n + 1),
placed AS (SELECT x.*, row_number() OVER (PARTITION BY request_id, sub ORDER BY band, prio DESC, updated_at DESC, id DESC) AS place FROM numbered x JOIN bands b USING (request_id, sub, n)),
phases AS (SELECT *, CASE sub WHEN 'summary' THEN 0 WHEN 'stable' THEN 1 ELSE 2 END AS phase FROM placed WHERE sub <> 'all' AND {top} >= 3
  UNION ALL SELECT *, 3 FROM placed WHERE sub = 'all' UNION ALL SELECT *, 4 FROM placed WHERE sub = 'all'),
tries AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY phase, place) AS step FROM phases),
walk AS (SELECT request_id, 0::BIGINT AS step, []::VARCHAR[] AS ids, []::VARCHAR[] AS lays, []::VARCHAR[] AS norms, []::VARCHAR[][] AS toks, []::INTEGER[] AS seeded, []::VARCHAR[] AS dropped FROM (SELECT DISTINCT request_id FROM tries)
  UNION ALL SELECT request_id, step, CASE WHEN v = 2 THEN list_append(ids, id) ELSE ids END, CASE WHEN v = 2 THEN list_append(lays, lay) ELSE lays END, CASE WHEN v = 2 THEN list_append(norms, norm) ELSE norms END,
    CASE WHEN v = 2 THEN list_append(toks, tokens) ELSE toks END, CASE WHEN v = 2 THEN list_append(seeded, phase) ELSE seeded END, CASE WHEN v = 1 THEN list_append(dropped, id) ELSE dropped END
  FROM (SELECT w.* EXCLUDE (step), t.step, t.id, t.lay, t.norm, t.tokens, t.phase, CASE WHEN len(w.ids) >= {top} OR list_contains(w.ids, t.id) OR (t.phase < 3 AND list_contains(w.seeded, t.phase))
      OR (t.phase = 3 AND len(list_filter(w.lays, lambda x: x = t.lay)) >= CASE t.lay {caps} END) THEN 0
    WHEN t.norm = '' OR list_contains(w.norms, t.norm) OR len(list_filter(w.toks, lambda x: len(x) > 0 AND len(t.tokens) > 0 AND len(list_intersect(x, t.tokens)) / least(len(x), len(t.tokens))::DOUBLE >= {p.similar})) > 0 THEN 1 ELSE 2 END AS v
    FROM walk w JOIN tries t ON t.request_id = w.request_id AND t.step = w.step + 1)),
chosen AS (SELECT request_id, arg_max(ids, step) AS ids, arg_max(dropped, step) AS dropped FROM walk GROUP BY request_id),
got AS (SELECT s.*, c.ids IS NOT NULL AND list_contains(c.ids, s.id) AS selected, CASE WHEN list_contains(c.ids, s.id) THEN row_number() OVER (PARTITION BY s.request_id, coalesce(list_contains(c.ids, s.id), false) ORDER BY score DESC, updated_at DESC, s.id DESC)::INTEGER END AS rank,
  coalesce(list_contains(c.dropped, s.id), false) AND NOT coalesce(list_contains(c.ids, s.id), false) AS dropped FROM {source} s LEFT JOIN chosen c USING (request_id)),
reasoned AS (SELECT *, CASE WHEN score < {p.threshold} THEN 'below_threshold' WHEN selected THEN 'selected_top' WHEN dropped THEN 'filtered_near_duplicate' ELSE 'not_in_top_limit' END AS reason FROM got)"""


LAYERED = "SELECT request_id, id, ret_layer, round(score, 6) AS score, selected, rank, dropped AS filtered_by_diversity, reason FROM reasoned"
_by_layer = ", ".join(f"count(*) FILTER (ret_layer = '{x}') AS {x}_candidates, count(*) FILTER (ret_layer = '{x}' AND selected) AS selected_{x}" for x in ("summary", "stable", "episodic"))
_by_reason = ", ".join(f"count(*) FILTER (reason = '{x}') AS reason_{x}" for x in ("below_threshold", "filtered_near_duplicate", "not_in_top_limit", "selected_top"))
METRICS = f"""SELECT request_id, count(*) AS total_candidates, count(*) FILTER (selected) AS selected_count, round(max(score) FILTER (selected), 6) AS top_score, round(avg(score) FILTER (selected), 6) AS avg_selected_score,
  count(*) FILTER (dropped) AS filtered_by_diversity, {_by_reason}, {_by_layer} FROM reasoned GROUP BY request_id"""


def evaluated(top: str, contains: str, forbidden: str, layer_counts: dict[str, int], limit: int, p: ScorePolicy) -> str:
    """cases (chat_id, lists of ids as SQL over `known`, the ids by turn, and q_turn) against what is retrieved."""
    wrong = ", ".join(f"CASE WHEN n_{x} <> {n} THEN '{x}: ' || n_{x} || ' for {n}' END" for x, n in layer_counts.items()) or "NULL::VARCHAR"
    return f"""{layered(0, False, limit, p, 'm.chat_id')}, known AS (SELECT chat_id, list(id ORDER BY turn) FILTER (turn < q_turn) AS ids FROM memories JOIN last USING (chat_id) GROUP BY chat_id),
cases AS (SELECT l.chat_id AS name, {top} AS top_ids, {contains} AS contains_ids, {forbidden} AS forbidden_ids FROM last l JOIN known k USING (chat_id) WHERE ids IS NOT NULL),
found AS (SELECT request_id AS name, list(id ORDER BY rank) AS ids, {', '.join(f"count(*) FILTER (ret_layer = '{x}')::INTEGER AS n_{x}" for x in ('summary', 'stable', 'episodic'))} FROM reasoned WHERE selected GROUP BY request_id),
judged AS (SELECT name, coalesce(ids, []::VARCHAR[]) AS ids, top_ids, contains_ids, forbidden_ids, {', '.join(f'coalesce(n_{x}, 0) AS n_{x}' for x in ('summary', 'stable', 'episodic'))} FROM cases LEFT JOIN found USING (name)),
results AS (SELECT name, ids, list_filter(top_ids, lambda x, i: ids[i] IS DISTINCT FROM x) AS missing_top, list_filter(contains_ids, lambda x: NOT list_contains(ids, x)) AS missing, list_filter(forbidden_ids, lambda x: list_contains(ids, x)) AS present,
  list_filter([{wrong}], lambda x: x IS NOT NULL) AS layers FROM judged), verdicts AS (SELECT *, len(missing_top) + len(missing) + len(present) + len(layers) = 0 AS passed FROM results)"""


def snapshot(store: str) -> str:
    """The store after a batch, over the tables of oracles.STORE."""
    return f"""{store}, taken AS (SELECT d.decision, d.branch, d.matched_id, c.*, m.importance FROM decided d JOIN cand c USING (id) JOIN memories m ON m.id = replace(c.id, '-again', '')),
variants AS (SELECT matched_id, content, keywords, min(seq) AS seq, count(*) FILTER (branch = 'exact') AS n_exact, count(*) FILTER (branch <> 'exact') AS n_soft FROM taken WHERE decision = 'updated' GROUP BY matched_id, content, entities, keywords),
folded AS (SELECT matched_id, list(content ORDER BY seq, content) AS cs, flatten(list(keywords ORDER BY seq, content)) AS ks, sum(n_exact) AS n_exact, sum(n_soft) AS n_soft FROM variants GROUP BY matched_id),
every AS (SELECT id, chat_id, type, importance, content, keywords, updated_at FROM old UNION ALL SELECT id, chat_id, type, importance, trim(content), keywords, TIMESTAMP '{AS_OF}' FROM taken WHERE decision = 'stored'),
both_sides AS (SELECT e.*, f.* EXCLUDE (matched_id), f.matched_id IS NOT NULL AS hit, list_concat(keywords, coalesce(ks, []::VARCHAR[])) AS all_keywords FROM every e LEFT JOIN folded f ON e.id = f.matched_id),
kept AS (SELECT *, CASE WHEN hit THEN list_reduce(cs, lambda a, v: CASE WHEN length(v) > length(a) + 10 THEN v ELSE a END, content) ELSE content END AS new_content, list_filter(all_keywords, lambda x, i: list_position(all_keywords, x) = i) AS new_keywords FROM both_sides)
SELECT id, chat_id, type, round(CASE WHEN hit THEN least(importance + n_exact * 0.05::DOUBLE + n_soft * 0.03::DOUBLE, 1) ELSE importance END, 6)::DOUBLE AS importance, sha256(new_content) AS content,
  array_to_string(new_keywords, ',') AS keywords, CASE WHEN hit THEN TIMESTAMP '{AS_OF}' ELSE updated_at END AS updated_at FROM kept"""


def segment(c: str) -> str:
    cut = o.truncated(c, 120).replace("|| '...'", "")
    return rf"regexp_replace({cut}, '\.+$', '')"


SUMMARIES = rf"""segs AS (SELECT *, trim(regexp_replace(lower(content), '\s+', ' ', 'g')) AS key, {segment('content')} AS seg, {o.any_of('lower(content)', policy.SUMMARY_RELATIONSHIP)} AS rel, {o.any_of('lower(content)', policy.SUMMARY_GOALS)} AS goal FROM win),
firsts AS (SELECT *, row_number() OVER (PARTITION BY chat_id, character_id, key ORDER BY nth) AS c FROM segs),
parts AS (SELECT chat_id, character_id, list(seg ORDER BY nth) FILTER (c = 1)[1:3] AS ev, list(seg ORDER BY nth) FILTER (c = 1 AND rel)[1:1] AS re, list(seg ORDER BY nth) FILTER (c = 1 AND goal)[1:2] AS go FROM firsts GROUP BY ALL),
acted AS (SELECT r.*, p.ev, p.re, p.go, CASE WHEN len(ids) < 3 THEN 'skipped_not_enough_inputs' WHEN summary_id IS NULL THEN 'created' ELSE 'updated' END AS action FROM rolled r LEFT JOIN parts p USING (chat_id, character_id)),
texted AS (SELECT *, CASE WHEN action IN ('created', 'updated') THEN 'Краткая сводка последних эпизодов (' || len(ids) || '):' || coalesce(' Недавние события: ' || array_to_string(ev, '; ') || '.', '')
  || CASE WHEN len(re) > 0 THEN ' Изменения в отношениях: ' || array_to_string(re, '; ') || '.' ELSE '' END || CASE WHEN len(go) > 0 THEN ' Текущие цели и состояние: ' || array_to_string(go, '; ') || '.' ELSE '' END ELSE coalesce(summary_text, '') END AS text FROM acted),
worded AS (SELECT *, list_concat({o.keywords('text')}, flatten(kws)) AS ks FROM texted)
SELECT chat_id, character_id, action, CASE WHEN action = 'created' THEN sha256(chat_id || '#' || character_id || '#rolling_v1') ELSE summary_id END AS summary_memory_id, text AS summary_text, array_to_string(ids, ',') AS source_ids,
  len(ids)::INTEGER AS summarized_count, len(ids)::INTEGER AS new_input_count, CASE WHEN action IN ('created', 'updated') THEN array_to_string(list_slice(list_filter(ks, lambda x, i: list_position(ks, x) = i), 1, 12), ',') END AS keywords FROM worded"""

MARKER, EXPLICIT = r"(?im)^[ \t\x0B\f\r]*(?:\[memory-anchor\]|@memory-anchor(?:[ \t]*:[ \t]*.+)?)[ \t\x0B\f\r]*$", r"(?im)^\s*@memory-anchor\s*:\s*(.+)\s*$"


def anchors(entries: str, max_items: int, max_chars: int, blocks: str | None = None) -> str:
    """entries: SQL with request_id, pos, tagged, comment, content; blocks: SQL with request_id, block."""
    flat = lambda c: rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"
    named = lambda c: f"nullif({flat(f'regexp_extract({c}, {o.quoted(EXPLICIT)}, 1)')}, '')"
    plain = lambda c: f"nullif({flat(f'regexp_replace({c}, {o.quoted(MARKER)}, {o.quoted(str())}, {o.quoted(chr(103))})')}, '')"
    marked = lambda c: f"regexp_matches({c}, {o.quoted(MARKER)})"
    room = max_chars - 16
    known = f"LEFT JOIN ({blocks}) k USING (request_id) WHERE NOT coalesce(block <> '' AND contains(lower({flat('block')}), norm), false)" if blocks else ""
    return rf"""e AS (SELECT request_id, pos, tagged, coalesce(comment, '') AS comment, coalesce(content, '') AS content FROM ({entries})),
a AS (SELECT request_id, pos, coalesce({named('comment')}, {named('content')}, {plain('content')}, {plain('comment')}) AS txt FROM e WHERE tagged OR {marked('comment')} OR {marked('content')}),
n AS (SELECT *, lower({flat('txt')}) AS norm FROM a WHERE txt IS NOT NULL), f AS (SELECT n.*, row_number() OVER (PARTITION BY request_id, norm ORDER BY pos) AS copy FROM n {known}),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY pos) AS nth FROM f WHERE copy = 1), c AS (SELECT *, 13 + sum(length(txt) + 3) OVER (PARTITION BY request_id ORDER BY pos) AS chars FROM r WHERE nth <= {max_items}),
s AS (SELECT *, CASE WHEN chars <= {max_chars} THEN txt ELSE trim(substring(txt, 1, {room - 1})) || '…' END AS shown FROM c WHERE chars <= {max_chars} OR nth = 1)
SELECT request_id, '[Lore Anchor]' || string_agg(chr(10) || '- ' || shown, '' ORDER BY nth) AS anchor_block, count(*)::INTEGER AS n_anchors, bool_or(chars > {max_chars}) AS truncated FROM s GROUP BY request_id"""


TITLE = r"regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
PAGE_ENTRIES = f"SELECT 'r' || (page_id % 50) AS request_id, page_id AS pos, page_id % 3 = 0 AS tagged, CASE WHEN page_id % 4 = 0 THEN '@memory-anchor: ' || {TITLE} END AS comment, {TITLE} AS content FROM pages"

NOTES = """SELECT m.request_id, m.chat_id || ':' || epoch_ms(TIMESTAMP '{as_of}') AS interaction_id, 'chatId' AS chat_scope_source,
  len(list_filter(string_split(block, chr(10)), lambda x: starts_with(ltrim(x), '- ')))::INTEGER AS block_items, (SELECT CASE WHEN length(f) <= 240 THEN f ELSE substring(f, 1, 240) || '...' END FROM (SELECT trim(regexp_replace(block, '\\s+', ' ', 'g')) AS f)) AS preview,
  array_to_string(list_filter(['store_not_called', CASE WHEN block = '' THEN 'empty_memory_block' END, CASE WHEN retrieved_items > 0 AND actual_chars <= 100 THEN 'retrieved_items_but_prompt_not_applied' END,
    CASE WHEN trimmed_items > 0 THEN 'memory_block_trimmed_by_budget' END], lambda x: x IS NOT NULL), ',') AS notes
  FROM (SELECT DISTINCT 'r' || conv_id AS request_id, 'chat-' || conv_id AS chat_id FROM conversations) m JOIN budget ON budget.request_id = m.chat_id""".replace("{as_of}", AS_OF)

# The best passing memory of each request, archived ones included, is expected first by a retrieval that leaves those out.
_BANDLESS = replace(SCORING, band=0.0)
CASES = f"""{scored(0, True, _BANDLESS, "m.chat_id")}, visible AS (SELECT * FROM scored WHERE NOT archived), {selection(5, _BANDLESS, 'visible')},
best AS (SELECT request_id AS name, id AS best FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, updated_at DESC, id DESC) AS nth FROM scored WHERE score >= {SCORING.threshold}) WHERE nth = 1),
found AS (SELECT request_id AS name, list(id ORDER BY rank) AS ids FROM reasoned WHERE selected GROUP BY request_id)
SELECT name, coalesce(ids[1] = best, false) AS passed, CASE WHEN ids[1] IS DISTINCT FROM best THEN best ELSE '' END AS missing_top, CASE WHEN coalesce(list_contains(ids, best), false) THEN '' ELSE best END AS missing FROM best LEFT JOIN found USING (name)"""

ORACLES: dict[str, str] = {
    "evaluate_cases": f"WITH RECURSIVE {CASES}",
    "retrieve_layered": f"WITH RECURSIVE {layered(3)} {LAYERED}",
    "retrieve_metrics": f"WITH RECURSIVE {layered(3)} {METRICS}",
    "store_batch": f"WITH {snapshot(o.STORE)}",
    "rolling_summaries": f"WITH {o.ROLLING}, {SUMMARIES}",
    "anchor_blocks": f"WITH {anchors(PAGE_ENTRIES, 2, 120)}",
    "audit_records": f"WITH {o.budget(4, 520)} {NOTES}",
}
