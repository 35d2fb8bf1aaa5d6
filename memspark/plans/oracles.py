r"""DuckDB SQL for the registered queries, over the same tables.

Its regular expressions know no \b and no letters beyond ASCII in \w, so patterns are rewritten with explicit classes.
"""

from __future__ import annotations

from ..functions import policy
from ..sources.memories import AS_OF, BASE_TIME

WORD = r"[\p{L}\p{N}_]"
EDGE = r"[^\p{L}\p{N}_]"


def portable(pattern: str) -> str:
    """A pattern for re2: word edges as classes, word characters of all scripts."""
    out = pattern.replace(r"\w", WORD)
    if out.startswith(r"\b"):
        out = rf"(^|{EDGE})" + out[2:]
    if out.endswith(r"\b"):
        out = out[:-2] + rf"($|{EDGE})"
    return out.replace(r"|\b", rf"|(^|{EDGE})").replace(r"\b|", rf"($|{EDGE})|").replace(r")\b", rf")($|{EDGE})")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def found(col: str, patterns: list[str]) -> str:
    return f"regexp_matches({col}, {quoted('|'.join(f'(?:{portable(p)})' for p in patterns))})"


def any_of(col: str, markers: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {quoted(x)})" for x in markers) + ")" if markers else "false"


def listed(xs: list[str]) -> str:
    return "[" + ", ".join(map(quoted, xs)) + "]"


def content_key(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"


def similarity(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower({c}), '^\s+|\s+$', '', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')"


def report(c: str) -> str:
    return rf"regexp_replace(trim(regexp_replace(lower({c}), '\s+', ' ', 'g')), '[^\p{{L}}\p{{N}}\s]', ' ', 'g')"


def words(c: str) -> str:
    return rf"[w for w in regexp_split_to_array({c}, '\s+') if w <> '']"


def first_seen(x: str) -> str:
    return f"(SELECT list_filter(l, lambda x, i: list_position(l, x) = i) FROM (SELECT {x} AS l))"


def keywords(c: str, cap: int = 8) -> str:
    cleaned = rf"regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')"
    return f"list_slice({first_seen(f'[w for w in {words(cleaned)} if length(w) >= 3 AND NOT list_contains({listed(policy.STOPWORDS)}, w)]')}, 1, {cap})"


def entities(c: str) -> str:
    marked = rf"regexp_split_to_array(regexp_replace({c}, '([.!?]\s)([A-ZА-Я])', '\1_\2', 'g'), '[^\p{{L}}\p{{N}}_]+')"
    kept = f"[w for w in {marked} if regexp_matches(w, '^[A-ZА-Я][a-zа-яё]+$') AND NOT list_contains({listed(policy.PRONOUNS)}, lower(w))]"
    by_lower = f"(SELECT list_filter(l, lambda x, i: list_position([lower(y) for y in l], lower(x)) = i) FROM (SELECT {kept} AS l))"
    return f"list_slice({by_lower}, 1, 10)"


def joined(x: str) -> str:
    return f"array_to_string({x}, ',')"


def days(ts: str) -> str:
    return f"CASE WHEN {ts} IS NOT NULL THEN greatest(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us({ts})) / 86400000000), 0)::INTEGER END"


def truncated(c: str, limit: int) -> str:
    flat = rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"
    return f"""(SELECT CASE WHEN length(f) <= {limit} THEN f WHEN p > 0 AND length(h) - p >= {limit // 2} THEN rtrim(substring(h, 1, length(h) - p)) || '...' ELSE h || '...' END
      FROM (SELECT f, h, strpos(reverse(h), ' ') AS p FROM (SELECT f, rtrim(substring(f, 1, {limit})) AS h FROM (SELECT {flat} AS f))))"""


def detail(c: str) -> str:
    markers = " + ".join(f"{found('lower(' + c + ')', [p])}::INTEGER" for p in policy.SCENE_DETAIL)
    raw = f"(least({markers}, 4) * 0.18::DOUBLE + least(len({keywords(c)}), 6) * 0.05::DOUBLE + least(len({entities(c)}), 3) * 0.08::DOUBLE)"
    return f"CASE WHEN {c} = '' THEN 0.0 ELSE least(CASE WHEN ends_with(rtrim({c}), '?') THEN {raw} * 0.6::DOUBLE ELSE {raw} END, 1.0) END"


DOCS = "docs AS (SELECT doc_id, coalesce(text, '') AS text, lang FROM documents)"
TURNS = "turns AS (SELECT 'r' || conv_id AS request_id, 'chat-' || conv_id AS chat_id, 'char-' || (conv_id % 7) AS character_id, turn::INTEGER AS msg_idx, role, coalesce(text, '') AS text FROM conversations)"


def memories(cap: int = 8) -> str:
    return f"""k AS (SELECT *, conv_id * 7 + turn AS k, coalesce(text, '') AS t FROM conversations),
memories AS (SELECT conv_id || '-' || turn AS id, 'chat-' || conv_id AS chat_id, 'char-' || (conv_id % 7) AS character_id, conv_id, turn,
  ['profile', 'relationship', 'event', 'event', 'summary'][k % 5 + 1] AS type, trim(t) AS content, {content_key('t')} AS normalized_content,
  CASE WHEN k % 4 = 0 THEN 'manual' ELSE 'auto' END AS source, CASE WHEN k % 3 = 0 THEN 'stable' ELSE 'episodic' END AS layer,
  (turn % 10) / 10.0::DOUBLE AS importance, TIMESTAMP '{BASE_TIME}' + to_days(turn::INTEGER) + to_hours(conv_id) AS updated_at,
  k % 11 = 0 AS pinned, k % 13 = 0 AS archived, {keywords('t', cap)} AS keywords, {entities('t')} AS entities, k % 5 = 4 AS is_summary,
  CASE WHEN k % 5 = 4 THEN 'summary' WHEN k % 3 = 0 THEN 'stable' ELSE 'episodic' END AS ret_layer FROM k)"""


MEM = memories()
LOG = "log AS (SELECT user_id || '-' || (event_id % 8) AS id, ts + INTERVAL 790 DAY AS ts FROM events WHERE event_type IN ('view', 'click'))"
USED = f"""{MEM}, {LOG}, uses AS (SELECT id, count(*) AS n, max(ts) AS last FROM log GROUP BY id),
used AS (SELECT m.*, coalesce(n, 0)::BIGINT AS access_count, last AS last_accessed_at, {days('updated_at')} AS updated_days, {days('last')} AS accessed_days FROM memories m LEFT JOIN uses USING (id)),
cards AS (SELECT *, CASE WHEN updated_days <= 7 THEN 'fresh' WHEN updated_days <= 30 THEN 'warm' ELSE 'stale' END AS freshness,
  CASE WHEN access_count <= 0 OR last_accessed_at IS NULL THEN 'never_used' WHEN access_count >= 5 OR accessed_days <= 14 THEN 'active' ELSE 'low_use' END AS activity,
  CASE WHEN accessed_days <= 14 THEN 'recently_accessed' WHEN updated_days <= 14 THEN 'recently_updated' WHEN access_count <= 0 AND updated_days > 30 THEN 'stale_unused' ELSE 'quiet' END AS touch_state,
  row_number() OVER (PARTITION BY chat_id, character_id ORDER BY updated_at DESC, id DESC) AS pos FROM used)"""

ORACLES: dict[str, str] = {
    "normalize_text": f"WITH {DOCS} SELECT doc_id, sha256({content_key('text')}) AS content_key, sha256({similarity('text')}) AS similarity_key, sha256({report('text')}) AS report_key FROM docs",
    "extract_keywords": f"WITH {DOCS} SELECT doc_id, {joined(keywords('text'))} AS keywords FROM docs",
    "extract_entities": f"WITH {DOCS} SELECT doc_id, {joined(entities('text'))} AS entities FROM docs",
    "token_features": f"""WITH {TURNS} SELECT request_id, msg_idx,
  ends_with(trim(text), '?') OR {found("lower(trim(text))", policy.QUESTION_PREFIXES)} AS question_like, {found('lower(text)', policy.SCENE_QUERY)} AS scene_query,
  {joined('list_filter([' + ', '.join(f"CASE WHEN {found('lower(text)', p)} THEN {quoted(n)} END" for n, p in policy.RELATIONSHIP_CUES.items()) + '], lambda x: x IS NOT NULL)')} AS cues,
  {joined('list_filter([' + ', '.join(f"CASE WHEN {found('lower(text)', p)} THEN {quoted(n)} END" for n, p in policy.DURABLE_STATES.items()) + '], lambda x: x IS NOT NULL)')} AS durable,
  round({detail('text')}, 6) AS detail, {truncated('text', 120)} AS short,
  (SELECT CASE WHEN length(f) <= 240 THEN f ELSE substring(f, 1, 240) || '...' END FROM (SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f)) AS preview FROM turns""",
    "quality_gate": f"""WITH {MEM}, n AS (SELECT *, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS c FROM memories), q AS (SELECT *, {similarity('c')} AS norm FROM n),
r AS (SELECT id, CASE WHEN source <> 'auto' THEN 'non_auto_bypass' WHEN c = '' THEN 'empty_content' WHEN norm = '' THEN 'empty_after_normalization'
  WHEN list_contains({listed(policy.LOW_VALUE)}, norm) THEN 'low_value_pattern' WHEN length(c) < 12 THEN 'content_too_short' WHEN len({words('norm')}) < 3 THEN 'too_few_words'
  WHEN len(keywords) >= 2 THEN 'has_keywords' WHEN len(entities) >= 1 THEN 'has_entities' WHEN len({words('norm')}) >= 5 THEN 'rich_content' ELSE 'insufficient_retrieval_signal' END AS gate_reason FROM q)
SELECT id, gate_reason, gate_reason IN ('non_auto_bypass', 'has_keywords', 'has_entities', 'rich_content') AS gate_ok FROM r""",
    "list_filtered_page": f"""WITH {MEM}, f AS (SELECT * FROM memories WHERE layer = 'episodic' AND NOT archived AND source = 'auto')
SELECT id, updated_at, (SELECT count(*) FROM f) AS total FROM f ORDER BY updated_at DESC, id DESC LIMIT 40 OFFSET 10""",
    "search_memories": f"""WITH {MEM} SELECT id, content FROM memories WHERE contains(lower(concat_ws(' ', id, content, normalized_content, type, source, layer, array_to_string(entities, ' '), array_to_string(keywords, ' '))), 'the th')""",
    "validate_memories": f"""WITH {MEM}, c AS (SELECT *, importance * 1.2::DOUBLE AS i FROM memories)
SELECT id, array_to_string(list_filter([CASE WHEN trim(content) = '' THEN 'content' END, CASE WHEN pinned THEN 'layer' END, CASE WHEN i > 1 THEN 'importance' END], lambda x: x IS NOT NULL), ',') AS violations,
  least(greatest(i, 0), 1) AS clamped FROM c""",
    "resolve_scopes": """WITH c AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 3 = 0 THEN conv_id::VARCHAR END AS chat, CASE WHEN conv_id % 2 = 0 THEN 'g' || conv_id END AS grp, CASE WHEN conv_id % 5 > 0 THEN 'x' || (conv_id % 4) END AS ch FROM conversations),
r AS (SELECT *, coalesce(chat, grp, 'default') AS chat_id FROM c)
SELECT conv_id, chat_id, coalesce(ch, chat_id) AS character_id, CASE WHEN chat IS NOT NULL THEN 'chatId' WHEN grp IS NOT NULL THEN 'groupId_fallback' ELSE 'default_fallback' END AS chat_scope_source,
  CASE WHEN ch IS NOT NULL THEN 'characterId' ELSE 'chatId_fallback' END AS character_scope_source, chat_id || '::' || coalesce(ch, chat_id) AS scope_key FROM r""",
    "message_lines": f"""WITH {DOCS}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM docs)
SELECT doc_id, count(*) AS n_lines, sum(length(trim(line)))::BIGINT AS n_chars, max(no)::INTEGER AS last_line FROM l WHERE trim(line) <> '' GROUP BY doc_id""",
    "usage_counts": f"WITH {LOG} SELECT id, count(*) AS uses, max(ts) AS last_use FROM log GROUP BY id",
    "freshness_activity": f"WITH {USED} SELECT id, access_count, last_accessed_at, updated_days, accessed_days, freshness, activity, touch_state, round(1.0::DOUBLE / (1 + updated_days), 6) AS recency FROM cards",
    "chat_groups": f"""WITH {MEM} SELECT chat_id, character_id, count(*) AS total_count, count(*) FILTER (ret_layer = 'summary') AS summary_count, count(*) FILTER (ret_layer = 'stable') AS stable_count,
  count(*) FILTER (ret_layer = 'episodic') AS episodic_count, max(updated_at) AS last_updated, {days('max(updated_at)')} AS last_updated_days FROM memories GROUP BY chat_id, character_id""",
    "latest_episodic_window": f"""WITH {MEM}, r AS (SELECT *, row_number() OVER (PARTITION BY chat_id, character_id ORDER BY updated_at DESC, id DESC)::INTEGER AS nth FROM memories WHERE layer = 'episodic' AND NOT archived)
SELECT chat_id, id, nth FROM r WHERE nth <= 3 AND NOT is_summary""",
    "recent_context_frame": f"""WITH {TURNS} SELECT chat_id, msg_idx, string_agg(text, '|') OVER (PARTITION BY chat_id ORDER BY msg_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent,
  last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY chat_id ORDER BY msg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_user FROM turns""",
    "exact_duplicates": f"WITH {DOCS}, n AS (SELECT doc_id, {content_key('text')} AS c FROM docs) SELECT doc_id, min(doc_id) OVER (PARTITION BY c) AS first_id, count(*) OVER (PARTITION BY c) AS n_copies FROM n",
    "soft_matches": f"""WITH {MEM}, old AS (SELECT * FROM memories WHERE turn < 2),
p AS (SELECT c.id AS candidate_id, o.id AS existing_id, o.updated_at, len(list_intersect(list_distinct([lower(x) for x in c.entities]), list_distinct([lower(x) for x in o.entities]))) AS n_entities,
  len(list_intersect(c.keywords, o.keywords)) AS n_keywords FROM memories c JOIN old o ON c.character_id = o.character_id AND c.type = o.type AND c.turn >= 2 AND o.source = 'auto' AND NOT o.pinned AND NOT o.archived),
r AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY updated_at DESC, existing_id DESC) AS nth FROM p WHERE n_entities >= 1 AND n_keywords >= 2)
SELECT candidate_id, existing_id, n_entities, n_keywords FROM r WHERE nth = 1""",
    "near_duplicates": f"""WITH {DOCS}, s AS (SELECT doc_id, lang, list_distinct({words(report('text'))}) AS t FROM docs), n AS (SELECT *, len(t) AS n, list_sort(t) AS key FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM n a JOIN n b ON a.lang = b.lang AND a.doc_id <> b.doc_id AND a.n > 0 AND b.n > 0 AND 100 * len(list_intersect(a.t, b.t)) >= 85 * least(a.n, b.n)),
l AS (SELECT a, count(*) AS c FROM pairs GROUP BY a)
SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY lang, key) AS class_id, coalesce(c, 0)::BIGINT AS n_links FROM n LEFT JOIN l ON a = doc_id""",
    "shadowed_by_stable": f"""WITH {USED}, g AS (SELECT *, list_distinct([lower(x) for x in list_concat(entities, keywords)]) AS sig FROM cards),
p AS (SELECT a.id, b.id AS related_id, b.pos FROM g a JOIN g b ON a.chat_id = b.chat_id AND a.character_id = b.character_id AND a.layer = 'episodic' AND a.activity <> 'active' AND NOT a.pinned AND b.layer = 'stable' AND len(list_intersect(a.sig, b.sig)) >= 2)
SELECT id, arg_min(related_id, pos) AS related_id FROM p GROUP BY id""",
    "browse_page": f"""WITH {USED} SELECT id, updated_days, touch_state FROM cards WHERE freshness = 'stale' AND activity = 'never_used'
ORDER BY updated_at, coalesce(last_accessed_at, TIMESTAMP '{AS_OF}'), id DESC LIMIT 25 OFFSET 5""",
}

CONSOLIDATION = f"""{USED}, t AS (SELECT *, {report('content')} AS norm, list_distinct({words(report('content'))}) AS tok FROM cards WHERE NOT pinned),
near AS (SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.chat_id = b.chat_id AND a.character_id = b.character_id AND a.pos < b.pos
  AND (a.norm = b.norm OR (len(a.tok) > 0 AND len(b.tok) > 0 AND 100 * len(list_intersect(a.tok, b.tok)) >= 85 * least(len(a.tok), len(b.tok))))),
g AS (SELECT *, list_distinct([lower(x) for x in list_concat(entities, keywords)]) AS sig FROM cards),
sh AS (SELECT a.id, arg_min(b.id, b.pos) AS related_id FROM g a JOIN g b ON a.chat_id = b.chat_id AND a.character_id = b.character_id AND a.layer = 'episodic' AND a.activity <> 'active' AND NOT a.pinned AND b.layer = 'stable'
  AND len(list_intersect(a.sig, b.sig)) >= 2 GROUP BY a.id),
found AS (SELECT a AS id, 'near_duplicate' AS type, 'Near-duplicate content cluster.' AS reason, b AS related_id FROM near UNION ALL SELECT b, 'near_duplicate', 'Near-duplicate content cluster.', a FROM near
  UNION ALL SELECT id, 'stale_low_value_episode', 'Stale episodic memory with low retrieval activity.', NULL FROM cards WHERE NOT pinned AND layer = 'episodic' AND freshness = 'stale' AND activity IN ('never_used', 'low_use')
  UNION ALL SELECT id, 'shadowed_by_stable', 'Similar topic already represented by a stable memory.', related_id FROM sh)"""
ORACLES["consolidation_candidates"] = f"WITH {CONSOLIDATION} SELECT * FROM found"
ORACLES["consolidation_summary"] = f"""WITH {CONSOLIDATION} SELECT count(DISTINCT id) AS total_candidates, count(DISTINCT id) FILTER (type = 'near_duplicate') AS near_duplicate,
  count(DISTINCT id) FILTER (type = 'stale_low_value_episode') AS stale_low_value_episode, count(DISTINCT id) FILTER (type = 'shadowed_by_stable') AS shadowed_by_stable FROM found"""

# Classification under the queries' own markers (see catalog.LEXICON); the durable statements stay those of the policy.
EVENTLIKE = any_of("l", ["ight", "lich ", "erth", "ent la"])
PREFERS, PROFILES, RELATES = any_of("l", ["the th", "que la"]), any_of("l", ["ation "]), any_of("l", ["ing the", "ment "])
DURABLE = f"({' OR '.join(found('l', p) for p in policy.DURABLE_STATES.values())}) AND NOT {found('l', policy.EPISODE_BLOCKERS)}"
TYPED = f"""{TURNS}, lowered AS (SELECT *, lower(text) AS l FROM turns), asked AS (SELECT *, ends_with(trim(l), '?') OR {found('trim(l)', policy.QUESTION_PREFIXES)} AS q FROM lowered),
typed AS (SELECT *, CASE WHEN length(trim(text)) < 10 OR (role = 'user' AND q AND {RELATES}) THEN NULL WHEN {DURABLE} THEN 'relationship' WHEN {EVENTLIKE} THEN 'event' WHEN {RELATES} THEN 'relationship'
  WHEN {PREFERS} OR {PROFILES} THEN 'profile' END AS type FROM asked),
classified AS (SELECT *, CASE WHEN type IS NULL THEN NULL WHEN type = 'event' THEN 'episodic' WHEN type = 'relationship' AND {DURABLE} THEN 'stable' WHEN {EVENTLIKE} THEN 'episodic' WHEN {PREFERS} OR {PROFILES} THEN 'stable'
  WHEN type = 'relationship' AND {any_of('l', ['thon', 'erth'])} THEN 'episodic' ELSE 'stable' END AS layer, CASE type WHEN 'profile' THEN 0.7 WHEN 'relationship' THEN 0.8 WHEN 'event' THEN 0.6 END::DOUBLE AS importance FROM typed)"""
ORACLES["classify_messages"] = f"WITH {TYPED} SELECT request_id, msg_idx, type, layer, importance FROM classified"
CUT = """CASE WHEN length(text) <= 500 THEN text WHEN strpos(reverse(left(text, 500)), '.') BETWEEN 1 AND 249 THEN left(text, 501 - strpos(reverse(left(text, 500)), '.')) ELSE left(text, 500) || '...' END"""
ORACLES["extract_memories"] = f"""WITH {TYPED}, r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY msg_idx) AS nth FROM classified WHERE type IS NOT NULL)
SELECT request_id, msg_idx, sha256(request_id || '#' || msg_idx) AS id, type, layer, importance, {CUT} AS content, {joined(keywords('text'))} AS keywords FROM r WHERE nth <= 3"""

# Retrieval: the last user turn asks, the turns before it are the memories. The texts hold no relationship cues.
SCORED = f"""{memories(64)}, last AS (SELECT chat_id, conv_id, max(turn) AS q_turn FROM (SELECT 'chat-' || conv_id AS chat_id, conv_id, turn FROM conversations WHERE role = 'user') GROUP BY ALL),
asked AS (SELECT 'q-' || l.chat_id AS request_id, l.chat_id, l.q_turn, {keywords("coalesce(c.text, '')", 64)} AS kw, [lower(x) for x in {entities("coalesce(c.text, '')")}] AS en FROM last l JOIN conversations c ON c.conv_id = l.conv_id AND c.turn = l.q_turn),
parts AS (SELECT a.request_id, m.*, CASE WHEN len(kw) > 0 THEN len(list_intersect(m.keywords, kw)) / len(kw)::DOUBLE ELSE 0 END AS ko,
  CASE WHEN len(en) > 0 THEN len(list_intersect([lower(x) for x in m.entities], en)) / len(en)::DOUBLE ELSE 0 END AS eo, 1.0::DOUBLE / (1 + {days('m.updated_at')}) AS rec, {detail('m.content')} AS d
  FROM asked a JOIN memories m ON a.chat_id = m.chat_id AND m.turn < a.q_turn),
scored AS (SELECT *, least(greatest(0.50::DOUBLE * ko + 0.25::DOUBLE * eo + CASE WHEN ko > 0 AND eo > 0 THEN 0.10::DOUBLE ELSE 0 END
  + CASE WHEN 0.65::DOUBLE * ko + 0.35::DOUBLE * eo >= 0.60::DOUBLE THEN 1.0 WHEN 0.65::DOUBLE * ko + 0.35::DOUBLE * eo >= 0.30::DOUBLE THEN 0.6 ELSE 0.25 END::DOUBLE
    * (importance * 0.12::DOUBLE + rec * 0.03::DOUBLE + CASE WHEN pinned THEN 0.05 ELSE 0 END::DOUBLE), 0), 1) AS score FROM parts WHERE ko > 0 OR eo > 0)"""
ORACLES["score_candidates"] = f"WITH {SCORED} SELECT request_id, id, round(ko, 6) AS keyword_overlap, round(eo, 6) AS entity_overlap, round(rec, 6) AS recency, round(score, 6) AS score FROM scored"
ORACLES["retrieve_plain_topk"] = f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, updated_at DESC, id DESC)::INTEGER AS rank FROM scored)
SELECT request_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= 1"""

ITEMS = f"{MEM}, items AS (SELECT *, chat_id AS request_id, row_number() OVER (PARTITION BY chat_id ORDER BY updated_at DESC, id DESC)::INTEGER AS rank FROM memories)"
LABEL = "CASE WHEN pinned THEN '[PINNED] ' ELSE '' END || '[' || upper(ret_layer) || ']'"
ORACLES["format_blocks"] = f"""WITH {ITEMS}, n AS (SELECT *, {similarity("regexp_replace(content, '^\\s+|\\s+$', '', 'g')")} AS norm FROM items), f AS (SELECT *, norm <> '' AND row_number() OVER (PARTITION BY request_id, norm ORDER BY rank) = 1 AS use FROM n),
g AS (SELECT *, sum(use::INTEGER) OVER (PARTITION BY request_id ORDER BY rank) AS nth FROM f)
SELECT request_id, '[Relevant Memory]' || coalesce(string_agg(chr(10) || '- ' || {LABEL} || ' ' || {truncated('content', 120)}, '' ORDER BY rank) FILTER (use AND nth <= 4), '') AS block,
  count(*) FILTER (use AND nth <= 4)::INTEGER AS n_lines FROM g GROUP BY request_id"""

def budget(items: int, chars: int) -> str:
    """budget: what stays of each chat's items and why the rest goes."""
    return f"""{ITEMS}, l AS (SELECT *, '- ' || {LABEL} || ' ' || {truncated('content', 110)} AS line, row_number() OVER (PARTITION BY request_id, ret_layer ORDER BY rank) > CASE ret_layer WHEN 'stable' THEN 2 ELSE 1 END AS capped FROM items),
o AS (SELECT *, row_number() OVER w AS nth, 17 + sum(length(line) + 1) OVER w AS chars FROM l WINDOW w AS (PARTITION BY request_id, capped ORDER BY CASE ret_layer WHEN 'summary' THEN 0 WHEN 'stable' THEN 1 ELSE 2 END, rank)),
reasons AS (SELECT *, CASE WHEN capped THEN 'layer_cap:' WHEN nth > {items} THEN 'item_cap:' WHEN chars > {chars} THEN 'char_budget:' END || ret_layer AS reason FROM o),
budget AS (SELECT request_id, CASE WHEN count(*) FILTER (reason IS NULL) > 0 THEN '[Relevant Memory]' || string_agg(chr(10) || line, '' ORDER BY rank) FILTER (reason IS NULL) ELSE '' END AS block,
  CASE WHEN count(*) FILTER (reason IS NULL) > 0 THEN 17 + sum(length(line) + 1) FILTER (reason IS NULL) ELSE 0 END::INTEGER AS actual_chars, count(*)::INTEGER AS retrieved_items, count(*) FILTER (reason IS NULL)::INTEGER AS injected_items,
  count(reason)::INTEGER AS trimmed_items, coalesce(string_agg(reason, ',' ORDER BY NOT capped, CASE WHEN capped THEN rank ELSE -nth END) FILTER (reason IS NOT NULL), '') AS trim_reasons,
  count(*) FILTER (reason IS NULL AND ret_layer = 'summary')::INTEGER AS injected_summary, count(*) FILTER (reason IS NOT NULL AND ret_layer = 'episodic')::INTEGER AS trimmed_episodic FROM reasons GROUP BY request_id)"""


ORACLES["budget_blocks"] = f"WITH {budget(3, 300)} SELECT * FROM budget"

ROLLING = f"""{MEM}, win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, character_id ORDER BY updated_at DESC, id DESC) AS nth FROM memories WHERE layer = 'episodic' AND NOT archived) WHERE nth <= 8 AND NOT is_summary),
inputs AS (SELECT chat_id, character_id, list(id ORDER BY nth DESC) AS ids, list(content ORDER BY nth) AS contents, list(keywords ORDER BY nth DESC) AS kws FROM win GROUP BY ALL),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, character_id ORDER BY updated_at DESC, id DESC) AS nth FROM memories WHERE NOT archived) WHERE nth <= 50 AND (type = 'summary' OR is_summary)),
old AS (SELECT chat_id, character_id, arg_min(id, nth) AS summary_id, arg_min(content, nth) AS summary_text FROM newest GROUP BY ALL),
rolled AS (SELECT chat_id, character_id, coalesce(ids, []::VARCHAR[]) AS ids, contents, kws, summary_id, summary_text FROM inputs FULL JOIN old USING (chat_id, character_id))"""
ORACLES["rolling_summary_inputs"] = f"WITH {ROLLING} SELECT chat_id, array_to_string(ids, ',') AS source_ids, len(ids)::INTEGER AS summarized_count, len(ids)::INTEGER AS new_input_count, summary_id FROM rolled"

FEED = """feed AS (SELECT user_id || '-' || (event_id % 8) AS id, event_id AS seq, ts + INTERVAL 790 DAY AS ts,
  CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN 'delete' WHEN event_type = 'error' THEN 'update' WHEN event_type = 'signup' THEN 'toggle_pinned' WHEN event_type = 'click' THEN 'toggle_archived' ELSE 'update' END AS action,
  CASE WHEN event_type = 'purchase' THEN round(value % 1, 6) END AS importance, CASE WHEN event_type = 'view' THEN 'Changed: ' || event_id || ' times!' END AS content FROM events)"""
ORACLES["apply_changes"] = f"""WITH {MEM}, {FEED}, f AS (SELECT id, arg_max(importance, seq) FILTER (importance IS NOT NULL) AS imp, arg_max(content, seq) FILTER (content IS NOT NULL) AS con,
  max(ts) FILTER (importance IS NOT NULL OR content IS NOT NULL OR action LIKE 'toggle%') AS ts, bool_or(action = 'delete') AS del, count(*) FILTER (action = 'toggle_pinned') % 2 = 1 AS fp, count(*) FILTER (action = 'toggle_archived') % 2 = 1 AS fa FROM feed GROUP BY id)
SELECT id, coalesce(imp, importance) AS importance, sha256(coalesce(con, m.content)) AS content, sha256(CASE WHEN con IS NULL THEN normalized_content ELSE {content_key('con')} END) AS normalized,
  pinned <> coalesce(fp, false) AS pinned, archived <> coalesce(fa, false) AS archived, coalesce(f.ts, updated_at) AS updated_at FROM memories m LEFT JOIN f USING (id) WHERE NOT coalesce(del, false)"""
ORACLES["apply_reviews"] = f"""WITH {MEM}, r AS (SELECT user_id || '-' || (event_id % 8) AS id, event_id AS seq, ts + INTERVAL 790 DAY AS ts, event_type AS e,
  CASE event_type WHEN 'view' THEN 'reviewed_keep' WHEN 'purchase' THEN 'consolidated_archive' END AS s, CASE WHEN event_id % 3 = 0 THEN 'rel' || event_id END AS rel, CASE WHEN event_id % 4 = 0 THEN 'note ' || event_id END AS note
  FROM events WHERE event_type IN ('view', 'purchase', 'signup')),
f AS (SELECT id, arg_max(s, seq) FILTER (s IS NOT NULL) AS s, arg_max(rel, seq) FILTER (rel IS NOT NULL) AS rel, arg_max(note, seq) FILTER (note IS NOT NULL) AS note, count(*) AS n, bool_or(e = 'purchase') AS arc, max(ts) AS ts FROM r GROUP BY id)
SELECT id, archived OR coalesce(arc, false) AS archived, s AS review_status, rel AS related_id, note, coalesce(n, 0)::INTEGER AS n_history, coalesce(ts, updated_at) AS updated_at FROM memories LEFT JOIN f USING (id)"""

# A chat's first three turns are the store; later turns and repeats of the first two are candidates.
STORE = f"""{MEM}, old AS (SELECT * FROM memories WHERE turn < 3),
cand AS (SELECT id, chat_id, character_id, type, content, turn AS seq, keywords, entities FROM memories WHERE turn >= 3
  UNION ALL SELECT id || '-again', chat_id, character_id, type, content || ' !!!', turn, keywords, entities FROM memories WHERE turn < 2),
cleaned AS (SELECT *, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS c, {content_key('content')} AS norm FROM cand), simple AS (SELECT *, {similarity('c')} AS sim FROM cleaned),
gated AS (SELECT *, CASE WHEN c = '' THEN 'empty_content' WHEN sim = '' THEN 'empty_after_normalization' WHEN list_contains({listed(policy.LOW_VALUE)}, sim) THEN 'low_value_pattern' WHEN length(c) < 12 THEN 'content_too_short'
  WHEN len({words('sim')}) < 3 THEN 'too_few_words' WHEN len(keywords) >= 2 THEN 'ok' WHEN len(entities) >= 1 THEN 'ok' WHEN len({words('sim')}) >= 5 THEN 'ok' ELSE 'insufficient_retrieval_signal' END AS gate FROM simple),
known AS (SELECT chat_id, character_id, norm, id, source = 'auto' AND NOT pinned AND NOT archived AS open FROM (SELECT *, normalized_content AS norm, row_number() OVER (PARTITION BY chat_id, character_id, normalized_content ORDER BY updated_at, id) AS nth FROM old) WHERE nth = 1),
exact AS (SELECT g.*, k.id AS known_id, k.open FROM gated g LEFT JOIN known k ON gate = 'ok' AND g.chat_id = k.chat_id AND g.character_id = k.character_id AND g.norm = k.norm),
led AS (SELECT *, CASE WHEN gate = 'ok' AND known_id IS NULL THEN first_value(id) OVER (PARTITION BY chat_id, character_id, norm, gate = 'ok' AND known_id IS NULL ORDER BY seq, id) END AS leader FROM exact),
near AS (SELECT l.id, o.id AS soft_id, row_number() OVER (PARTITION BY l.id ORDER BY o.updated_at DESC, o.id DESC) AS nth FROM led l JOIN old o ON l.leader = l.id AND l.chat_id = o.chat_id AND l.character_id = o.character_id AND l.type = o.type AND o.source = 'auto' AND NOT o.pinned AND NOT o.archived
  AND len(list_intersect(list_distinct([lower(x) for x in l.entities]), list_distinct([lower(x) for x in o.entities]))) >= 1 AND len(list_intersect(l.keywords, o.keywords)) >= 2),
branched AS (SELECT l.*, soft_id, CASE WHEN gate <> 'ok' THEN 'quality_gate' WHEN known_id IS NOT NULL OR leader <> l.id THEN 'exact' WHEN soft_id IS NOT NULL THEN 'soft' ELSE 'new' END AS branch FROM led l LEFT JOIN (SELECT * FROM near WHERE nth = 1) s USING (id)),
decided AS (SELECT id, chat_id, CASE WHEN branch = 'quality_gate' THEN 'skipped_low_value' WHEN known_id IS NOT NULL AND NOT open THEN 'skipped_exact_protected' WHEN branch = 'new' THEN 'stored' ELSE 'updated' END AS decision,
  CASE WHEN branch = 'quality_gate' THEN gate WHEN known_id IS NOT NULL AND NOT open THEN 'exact_match_not_auto_updatable' WHEN branch = 'new' THEN 'new_memory_created' WHEN branch = 'soft' THEN 'soft_match_auto_updated' ELSE 'exact_match_auto_updated' END AS reason,
  branch, coalesce(known_id, soft_id, CASE WHEN leader <> id THEN leader END) AS matched_id FROM branched)"""
ORACLES["store_decisions"] = f"WITH {STORE} SELECT id, decision, reason, branch, matched_id FROM decided"
ORACLES["store_counters"] = f"""WITH {STORE} SELECT 's-' || chat_id AS request_id, count(*) FILTER (decision = 'stored') AS stored, count(*) FILTER (decision = 'updated') AS updated, count(*) FILTER (decision LIKE 'skipped%') AS skipped FROM decided GROUP BY chat_id"""
ORACLES["store_metrics"] = f"""WITH {STORE} SELECT 'decision' AS dimension, decision AS label, count(*) AS n FROM decided GROUP BY ALL UNION ALL SELECT 'reason', reason, count(*) FROM decided GROUP BY ALL UNION ALL SELECT 'branch', branch, count(*) FROM decided GROUP BY ALL"""
