"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, covertree, fingerprints, licenses, minhash, mixing, pii, ranking, sharding, topk, toxicity, trie
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(table(spark, sf_dir, "conversations"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"), pii.session_key(spark))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(table(spark, sf_dir, "documents"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_fingerprints,
        op3_chat_formatting,
        op4_minhash_dedup,
        op5_topk,
        op6_pii,
        op7_mixing,
        op8_sharding,
        op9_bpe,
        op10_license_scan,
        op11_embedding_dedup,
        op12_ranked_search,
        op13_prefix_trie,
    )
}

OP3_SQL = r"""
WITH turns AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-7::BIGINT, 1::BIGINT, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + len(regexp_extract_all(text, '</?s>|<</?SYS>>|\[/?INST\]|\[/?TURN'))
    + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 14 + 2 * octet_length(encode(role)) END AS n
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] for i in range(1, len(w) - 2)]) END AS s FROM words
), terms AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
  common AS (SELECT a.doc_id AS a, b.doc_id AS b FROM terms a JOIN terms b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
  links AS (SELECT a, b FROM common UNION ALL SELECT b, a FROM common),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept
FROM sets JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) ON doc_id = a
"""

OP5_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([q.e[i] * c.e[i] for i in range(1, len(q.e) + 1)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
  n AS (SELECT a, count(*) AS n FROM links GROUP BY a), c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

OP12_SQL = r"""
WITH lowered AS (SELECT 0 AS kind, doc_id AS id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 1, item_id, row_number() OVER (), text FROM benchmark),
t AS (SELECT kind, id, r, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM lowered),
f AS (SELECT kind, id, r, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT r, sum(tf)::BIGINT AS n FROM f WHERE kind = 0 GROUP BY r),
s AS (SELECT count(*) AS n, sum(n)::BIGINT AS l FROM n),
w AS (SELECT term, floor(1000 * ln((2 * any_value(s.n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s WHERE kind = 0 GROUP BY term),
m AS (SELECT r, 100 - 75 + (75 * n.n * s.n) // s.l AS m FROM n, s),
scored AS (
  SELECT q.id AS item_id, q.r AS item, d.id AS doc_id, d.r AS doc, sum(q.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 8 * m)))::BIGINT AS score
  FROM f q JOIN f d ON q.kind = 1 AND d.kind = 0 AND q.term = d.term JOIN w ON w.term = q.term JOIN m ON m.r = d.r GROUP BY ALL
), ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, doc)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, coalesce(role, '') AS r, coalesce(text, '') AS x
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (SELECT conv_id, list(length(r) || ':' || r || x ORDER BY p) AS s, list(octet_length(encode(x)) ORDER BY p) AS b FROM t GROUP BY conv_id),
steps AS (SELECT conv_id, [4294967295] || flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1] for c in string_split(conv_id::VARCHAR, '')]) AS steps FROM own),
h AS (SELECT conv_id, xor(list_reduce(steps, lambda a, x: xor(xor(a, greatest(x, 0)) >> 1, 3988292384 * (xor(a, greatest(x, 0)) & 1))), 4294967295) % 9 AS h FROM steps),
c AS (
  SELECT own.conv_id, coalesce(d.s[1:h], []) || own.s[h + 1:] AS s, coalesce(d.b[1:h], []) || own.b[h + 1:] AS b
  FROM own JOIN h USING (conv_id) LEFT JOIN own d ON d.conv_id = own.conv_id - own.conv_id % 5
), p AS (SELECT conv_id, d, s[1:d] AS k, coalesce(b[d], 0) AS b, len(s) AS n FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM c)),
nodes AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(b) AS b, max(n) = d AS leaf,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM p GROUP BY k, d
), kids AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
sub AS (SELECT v.k, sum((u.n_convs - 1) * u.b)::BIGINT AS saved_tokens, count(*) FILTER (u.leaf) AS n_leaves FROM nodes v JOIN nodes u ON u.d >= v.d AND u.k[1:v.d] = v.k GROUP BY v.k)
SELECT v.conv_id, v.d::BIGINT AS depth, up.conv_id AS parent_conv_id, v.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens, v.ends_sha256
FROM nodes v JOIN sub USING (k) LEFT JOIN kids USING (k) LEFT JOIN nodes up ON v.d > 0 AND up.d = v.d - 1 AND up.k = v.k[1:v.d - 1]
"""


def _starts(phrase: str) -> str:
    words = phrase.split()
    same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
    return f"[i - 1 for i in range(1, len(w) - {len(words)} + 2) if {same}]"


def license_sql() -> str:
    phrases = list(dict.fromkeys([*licenses.BASE, *(p for ps in licenses.TEMPLATES.values() for p in ps)]))
    at = {p: f"s{i}" for i, p in enumerate(phrases)}
    has = lambda p: f"len({at[p]}) > 0"
    base = f"list_concat({', '.join(at[p] for p in licenses.BASE)})"
    base_labels = [f"CASE WHEN {has(p)} THEN '{v}' END" for p, v in licenses.BASE.items()]
    own_labels = [f"CASE WHEN {' AND '.join(map(has, ps))} THEN '{v}' END" for v, ps in licenses.TEMPLATES.items()]
    joined = lambda xs: f"array_to_string(list_sort(list_distinct([x for x in [{', '.join(xs)}] if x IS NOT NULL])), ',')"
    words = sorted({w for p in phrases for w in p.split()})
    idf = "list_sum([m[x] for x in [{}]])"
    weight = {p: f"({idf.format(', '.join(repr(w) for w in p.split()))} + 1e-9)" for p in phrases}
    shares = [" + ".join(f"CASE WHEN {has(p)} THEN {weight[p]} ELSE 0 END" for p in ps) for ps in licenses.TEMPLATES.values()]
    shares = [f"({s}) / ({' + '.join(weight[p] for p in ps)})" for s, ps in zip(shares, licenses.TEMPLATES.values(), strict=True)]
    shares += [f"CASE WHEN {has(p)} THEN 1.0 ELSE 0.0 END" for p in licenses.BASE]
    # Notices: starts at which every key phrase stands at its place.
    notices, keyed = {}, {k: f"k{i}" for i, k in enumerate(dict.fromkeys(k for _, ks in licenses.TEXTS.values() for k in ks))}
    for name, (text, keys) in licenses.TEXTS.items():
        moved = [f"[x - {licenses.place_of(k, text)[0]} for x in {keyed[k]}]" for k in keys]
        common = moved[0]
        for m in moved[1:]:
            common = f"list_intersect({common}, {m})"
        notices[name] = f"len({common}) > 0"
    own_labels += [f"CASE WHEN {c} THEN '{name}' END" for name, c in notices.items()]
    shares += [f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END" for c in notices.values()]
    return rf"""
WITH d AS (SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] AS w FROM documents),
v AS (SELECT unnest([{', '.join(repr(w) for w in words)}]) AS x),
f AS (SELECT x, ln((1 + (SELECT count(*) FROM d)) / (1 + count(y))::DOUBLE) AS i FROM v LEFT JOIN (SELECT unnest(list_distinct(w)) AS y FROM d) ON x = y GROUP BY x),
m AS (SELECT map_from_entries(list((x, i))) AS m FROM f),
s AS (SELECT doc_id, w, {', '.join(f'{_starts(p)} AS {a}' for p, a in [*at.items(), *keyed.items()])} FROM d)
SELECT doc_id, len(w)::BIGINT AS n_words, len({base})::BIGINT AS n_base, list_min({base})::BIGINT AS first_word, list_max({base})::BIGINT AS last_word,
  {joined(base_labels)} AS base_labels, {joined(base_labels + own_labels)} AS labels, round(least(greatest({', '.join(shares)}), 1.0), 6)::DOUBLE AS score FROM s, m
"""


ORACLES: dict[str, str] = {"op3_chat_formatting": OP3_SQL, "op4_minhash_dedup": OP4_SQL, "op5_topk": OP5_SQL, "op10_license_scan": license_sql(), "op11_embedding_dedup": OP11_SQL, "op12_ranked_search": OP12_SQL, "op13_prefix_trie": OP13_SQL}
