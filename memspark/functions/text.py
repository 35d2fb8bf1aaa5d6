"""Text functions as column expressions, for Latin and Cyrillic text alike."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import policy

PUNCTUATION = r"[^\p{L}\p{N}_\s]"


def clean_spaces(col: Column) -> Column:
    """No-break and other Unicode blanks become plain ones; done once, where texts are read."""
    return F.regexp_replace(col, r"[   -     　\u0085]", " ")


def collapse(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def normalize_content(col: Column) -> Column:
    """Lower case, punctuation deleted, blanks collapsed: the key of exact duplicates."""
    return collapse(F.regexp_replace(F.lower(col), PUNCTUATION, ""))


def normalize_similarity(col: Column) -> Column:
    """Lower case, stripped, punctuation to blanks, blanks collapsed; a blank may stay at either end."""
    stripped = F.regexp_replace(F.lower(col), r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(stripped, PUNCTUATION, " "), r"\s+", " ")


def normalize_report(col: Column) -> Column:
    """As reports compare texts: blanks collapsed first, then all but letters and digits to blanks."""
    return F.regexp_replace(collapse(F.lower(col)), r"[^\p{L}\p{N}\s]", " ")


def words(col: Column) -> Column:
    return F.filter(F.split(col, r"\s+"), lambda w: w != "")


def token_set(normalized: Column) -> Column:
    return F.array_distinct(words(normalized))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared share of the smaller of two token sets; 0 if either is empty."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(F.lit(0.0))


_ANY = r"\\b|\\w[*+]|\.[*+]|\^|\$"
_HEAD = re.compile(rf"(?:{_ANY}|[\w ](?![?*+{{]))*")


def required(pattern: str) -> list[str]:
    """Strings that stand in whatever the pattern matches, as far as its beginning tells; none for patterns that aren't understood."""
    if "(?i" in pattern or re.search(r"\\[(\[|QE)\]]", pattern) or "|" in re.sub(r"\([^()]*\)|\[[^\]]*\]", "", pattern):
        return []
    return [x for x in re.split(_ANY, _HEAD.match(pattern)[0]) if x]


def matches(col: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found, letters of all scripts being word characters. A pattern is tried only on texts that hold what it requires."""
    known = [(p, required(p)) for p in patterns]
    plain = "|".join(f"(?:{p})" for p, held in known if not held)
    tests = [reduce(lambda a, b: a & b, [*(col.contains(x) for x in held), col.rlike(f"(?U){p}")]) for p, held in known if held] + ([col.rlike(f"(?U){plain}")] if plain else [])
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def contains_any(col: Column, markers: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [col.contains(m) for m in markers]) if markers else F.lit(False)


def _lemma(word: Column, lemmas: dict[str, str] | Column | None) -> Column:
    """lemmas: a few forms, or a map column with those of the row (see operators/lemmas.py), which a table of any size gives."""
    if lemmas is None:
        return word
    if isinstance(lemmas, Column):
        return F.coalesce(lemmas[word], word)
    if not lemmas:
        return word
    table = F.create_map(*[F.lit(x) for pair in lemmas.items() for x in pair])
    return F.coalesce(table[word], word)


def keywords(col: Column, limit: int = 8, lemmas: dict[str, str] | Column | None = None) -> Column:
    """First distinct words of three letters or more that are no stop words, in order of occurrence."""
    found = F.regexp_extract_all(F.lower(col), F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0))
    found = F.filter(found, lambda w: ~w.isin(policy.STOPWORDS))
    found = F.filter(F.transform(found, lambda w: _lemma(w, lemmas)), lambda w: F.char_length(w) >= 2)
    return F.slice(F.array_distinct(found), 1, limit)


def entities(col: Column, limit: int = 10, lemmas: dict[str, str] | Column | None = None) -> Column:
    """First distinct capitalised words that don't start a sentence and are no pronouns; equal up to case counts once."""
    marked = F.regexp_replace(col, r"([.!?]\s)([A-ZА-Я])", "$1_$2")
    found = F.regexp_extract_all(marked, F.lit(r"(?<![\p{L}\p{N}_])[A-ZА-Я][a-zа-яё]+(?![\p{L}\p{N}_])"), F.lit(0))
    found = F.filter(found, lambda w: ~F.lower(w).isin(policy.PRONOUNS))
    if lemmas is not None:
        found = F.transform(found, lambda w: F.when(F.lower(w).rlike("[а-яё]"), F.initcap(_lemma(F.lower(w), lemmas))).otherwise(w))
    lower = F.transform(found, F.lower)
    kept = F.filter(F.arrays_zip(found.alias("w"), lower.alias("l")), lambda x: F.char_length(x["w"]) > 1)
    # Bound to a variable, as what stands outside a lambda is computed anew for each element within.
    first = lambda k: F.transform(F.slice(F.array_distinct(k["l"]), 1, limit), lambda x: F.element_at(k["w"], F.array_position(k["l"], x).cast("int")))
    return F.transform(F.array(kept), first)[0]


def cues(col: Column, groups: dict[str, list[str]]) -> Column:
    """Names of the groups with a pattern in the lower-cased text, in the groups' order."""
    return cues_in(F.lower(F.coalesce(col, F.lit(""))), groups)


def cues_in(low: Column, groups: dict[str, list[str]]) -> Column:
    """cues() of a text that is in lower case already; within lambdas, where what repeats is computed each time, it should be a column."""
    return F.array_compact(F.array(*[F.when(matches(low, p), F.lit(name)) for name, p in groups.items()]))


def relationship_cues(col: Column) -> Column:
    return cues(col, policy.RELATIONSHIP_CUES)


def durable_cues(col: Column) -> Column:
    return cues(col, policy.DURABLE_STATES)


def is_durable_statement(col: Column) -> Column:
    low = F.lower(F.coalesce(col, F.lit("")))
    return reduce(lambda a, b: a | b, [matches(low, p) for p in policy.DURABLE_STATES.values()]) & ~matches(low, policy.EPISODE_BLOCKERS)


def is_question_like(col: Column) -> Column:
    low = F.lower(F.regexp_replace(F.coalesce(col, F.lit("")), r"^\s+|\s+$", ""))
    return low.endswith("?") | matches(low, policy.QUESTION_PREFIXES)


def is_scene_query(col: Column) -> Column:
    return matches(F.lower(F.coalesce(col, F.lit(""))), policy.SCENE_QUERY)


def is_relationship_question(col: Column) -> Column:
    return is_question_like(col) & ((F.size(durable_cues(col)) > 0) | (F.size(relationship_cues(col)) > 0))


def is_scene_question(col: Column) -> Column:
    return is_question_like(col) & is_scene_query(col)


def scene_detail(col: Column, n_keywords: Column, n_entities: Column) -> Column:
    """How concretely a text tells an outcome, 0 to 1. The counts are those of its keywords and entities under their caps."""
    low = F.lower(F.coalesce(col, F.lit("")))
    markers = reduce(lambda a, b: a + b, [matches(low, [p]).cast("int") for p in policy.SCENE_DETAIL])
    raw = F.least(markers, F.lit(4)) * 0.18 + F.least(n_keywords, F.lit(6)) * 0.05 + F.least(n_entities, F.lit(3)) * 0.08
    asked = F.rtrim(low).endswith("?")
    return F.when(low == "", F.lit(0.0)).otherwise(F.least(F.when(asked, raw * 0.6).otherwise(raw), F.lit(1.0)))


def _last(col: Column, sub: str) -> Column:
    """The position (from 1) of the last occurrence of a one-character string; 0 without one."""
    back = F.locate(sub, F.reverse(col))
    return F.when(back > 0, F.char_length(col) - back + 1).otherwise(F.lit(0))


def truncate_at_sentence(col: Column, limit: int = 500) -> Column:
    """Cut at the last full stop past the middle, else with dots."""
    head = F.substring(col, 1, limit)
    stop = _last(head, ".")
    cut = F.when(stop - 1 > limit // 2, F.substring(head, F.lit(1), stop)).otherwise(F.concat(head, F.lit("...")))
    return F.when(F.char_length(col) <= limit, col).otherwise(cut)


def truncate_at_blank(col: Column, limit: int, dots: str = "...", strip_stops: bool = False) -> Column:
    """Blanks collapsed, cut at the last blank from the middle on."""
    flat = collapse(F.coalesce(col, F.lit("")))
    head = F.rtrim(F.substring(flat, 1, limit))
    blank = _last(head, " ")
    cut = F.when(blank - 1 >= limit // 2, F.substring(head, F.lit(1), blank - 1)).otherwise(head)
    out = F.when(F.char_length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(cut), F.lit(dots)))
    return F.regexp_replace(out, r"\.+$", "") if strip_stops else out


def preview(col: Column, limit: int = 240) -> Column:
    flat = collapse(F.coalesce(col, F.lit("")))
    return F.when(F.char_length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit), F.lit("...")))


def count_block_items(block: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(block, F.lit("")), "\n"), lambda line: F.ltrim(line).startswith("- ")))


def friendly_label(col: Column) -> Column:
    """A scope id for display: separators to blanks, title case if it had no capitals, at most 36 characters."""
    compact = collapse(F.coalesce(col, F.lit("")))
    plain = collapse(F.regexp_replace(compact, r"[-_/]+", " "))
    titled = F.when((plain != compact) & ~plain.rlike(r"\p{Lu}"), F.initcap(plain)).otherwise(plain)
    short = lambda c: F.when(F.char_length(c) <= 36, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, 33)), F.lit("...")))
    return F.when(compact == "", F.lit("Unnamed chat")).otherwise(short(titled))


def looks_like_preference(col: Column, p: policy.ExtractPolicy) -> Column:
    low = F.lower(col)
    return contains_any(low, p.preference) | matches(low, p.preference_patterns) | matches(col, p.preference_patterns_cased)


def looks_like_profile(col: Column, p: policy.ExtractPolicy) -> Column:
    low = F.lower(col)
    return contains_any(low, p.profile) | matches(low, p.profile_patterns)


def looks_like_relationship(col: Column, p: policy.ExtractPolicy) -> Column:
    return contains_any(F.lower(col), p.relationship)


def has_temporal_context(col: Column, p: policy.ExtractPolicy) -> Column:
    return contains_any(F.lower(col), p.temporal)


def looks_like_event(col: Column, p: policy.ExtractPolicy) -> Column:
    low = F.lower(col)
    return contains_any(low, p.event) | contains_any(low, p.temporal) | contains_any(low, p.plans)


def detect_type(col: Column, p: policy.ExtractPolicy) -> Column:
    """relationship, event or profile; null for what is no memory."""
    return (
        F.when(is_durable_statement(col) | (~looks_like_event(col, p) & looks_like_relationship(col, p)), F.lit("relationship"))
        .when(looks_like_event(col, p), F.lit("event"))
        .when(looks_like_preference(col, p) | looks_like_profile(col, p), F.lit("profile"))
    )


def detect_layer(memory_type: Column, col: Column, p: policy.ExtractPolicy) -> Column:
    episodic, stable = F.lit("episodic"), F.lit("stable")
    related = memory_type == "relationship"
    return (
        F.when(memory_type == "event", episodic)
        .when(related & is_durable_statement(col), stable)
        .when(looks_like_event(col, p), episodic)
        .when(looks_like_preference(col, p) | looks_like_profile(col, p), stable)
        .when(related & (contains_any(F.lower(col), p.conflict) | has_temporal_context(col, p)), episodic)
        .otherwise(stable)
    )


def default_importance(memory_type: Column, p: policy.ExtractPolicy) -> Column:
    out = F.lit(0.6)
    for name, value in p.importance.items():
        out = F.when(memory_type == name, F.lit(value)).otherwise(out)
    return out
