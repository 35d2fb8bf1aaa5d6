"""Duplicate and overlap joins between memories or documents. Terms are joined, never all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as t
from ..functions.memory import can_auto_update
from ..functions.policy import MergePolicy
from ..sources.durable import durable
from .overlap import NEVER, by_key, in_cells, linked_pairs, linked_sets, ranked_sets

#: Rows of a scope that are compared in pairs: at most half as many pairs as this for each row. Larger scopes are met by their tokens or terms.
FEW = 64


def first_by_content(memories: DataFrame, keys: list[str]) -> DataFrame:
    """For each key the oldest memory, ties to the smaller id."""
    kept = [c for c in memories.columns if c not in keys]
    oldest = memories.groupBy(*keys).agg(F.min_by(F.struct(*kept), F.struct("created_at", "id")).alias("m"))
    return oldest.select(*keys, "m.*")


def exact_matches(candidates: DataFrame, memories: DataFrame) -> DataFrame:
    """candidates (with normalized_content) and existing_id, the oldest memory of the scope with the same content; null for new ones."""
    keys = ["chat_id", "character_id", "normalized_content"]
    known = memories.groupBy(*keys).agg(F.min_by("id", F.struct("created_at", "id")).alias("existing_id"))
    return candidates.join(known, keys, "left")


def soft_matches(candidates: DataFrame, memories: DataFrame, p: MergePolicy | None = None) -> DataFrame:
    """candidate_id, existing_id: each candidate's newest updatable memory of the same scope and type that shares entities and keywords.

    Only the scope's p.newest most recently updated memories are looked at, whether archived or not (None: all).
    """
    p = p or MergePolicy()
    keys = ["chat_id", "character_id", "type"]
    if p.newest is not None:
        newest = W.partitionBy("chat_id", "character_id").orderBy(F.desc("updated_at"), F.desc("id"))
        memories = memories.withColumn("nth", F.row_number().over(newest)).filter(F.col("nth") <= p.newest)
    lower = F.array_distinct(F.transform("metadata.entities", F.lower))
    sides = [lower.alias("entities"), F.array_distinct("metadata.keywords").alias("keywords")]
    asks = candidates.select(F.col("id").alias("candidate_id"), *keys, *sides).filter((F.size("entities") >= p.min_entities) & (F.size("keywords") >= p.min_keywords))
    known = memories.filter(can_auto_update()).select(F.col("id").alias("existing_id"), "updated_at", *keys, *sides)
    posted, least = ("keywords", p.min_keywords) if p.min_keywords else ("entities", max(1, p.min_entities))
    term = [*keys, "term"]
    known = durable(known.select("existing_id", "updated_at", *keys, F.col("entities").alias("known_entities"), F.col("keywords").alias("known_keywords"), F.explode(posted).alias("term")))
    # Who shares n terms still shares one when a candidate's n - 1 most frequent ones are left out.
    common = durable(known.groupBy(*term).agg(F.count("*").alias("df")))
    asks = by_key(durable(asks.withColumn("term", F.explode(posted))), common, term, "df")
    most = F.row_number().over(W.partitionBy("candidate_id").orderBy(F.desc("df"), "term"))
    asks = durable(asks.withColumn("nth", most).filter(F.col("nth") >= least).drop("df", "nth"))
    n_entities, n_keywords = (F.size(F.array_intersect(c, f"known_{c}")) for c in ("entities", "keywords"))
    found = None
    for slice_ in _slices(known, p.slices):
        part = known.filter(slice_)
        met = in_cells(asks, part, term, "candidate_id", "existing_id").withColumn("n_entities", n_entities).withColumn("n_keywords", n_keywords)
        enough = met.filter((F.col("n_entities") >= p.min_entities) & (F.col("n_keywords") >= p.min_keywords))
        # The newest hit of the slice is kept before rows move; who has one leaves before the next older slice.
        hit = durable(enough.groupBy("candidate_id").agg(F.max(F.struct("updated_at", "existing_id", "n_entities", "n_keywords")).alias("hit")))
        found = hit if found is None else found.unionByName(hit)
        asks = asks.join(hit.select("candidate_id"), "candidate_id", "left_anti")
    hit = lambda c, kind: F.col(f"hit.{c}").cast(kind).alias(c)
    return found.select("candidate_id", hit("existing_id", dict(memories.dtypes)["id"]), hit("updated_at", "timestamp"), hit("n_entities", "long"), hit("n_keywords", "long"))


def _slices(known: DataFrame, n: int) -> list[Column]:
    """Conditions on updated_at that cut known into n slices, the newest first: it is the smallest, each older one about four times as large. Null times are oldest."""
    shares = [1 - 4.0**-k for k in range(1, n)]
    if not shares:
        return [F.lit(True)]
    micros = F.unix_micros("updated_at")
    cuts = sorted(set(known.agg(F.percentile_approx(micros, F.array(*map(F.lit, shares)), 1000).alias("c")).first()["c"] or []), reverse=True)
    within = [micros > c for c in cuts]
    return [new if older is None else new & ~older for new, older in zip(within, [None, *within[:-1]], strict=True)] + [micros.isNull() | ~within[-1] if cuts else F.lit(True)]


def overlap_pairs(rows: DataFrame, scope: list[str], tokens: Column, percent: int = 85) -> DataFrame:
    """a, b, n_shared, n_a, n_b of rows (id) in one scope whose token sets' overlap coefficient reaches percent / 100; a is the smaller set, ties by id.

    Equal sets are folded into one class before the join and only classes are paired, so copies don't multiply. Pairs are found in a grid of
    token blocks (see overlap.py). Returned are pairs of class representatives (smallest ids); overlap_classes() gives the members.
    """
    return _paired(_classes(rows, scope, tokens), scope, percent)


def _sets(classes: DataFrame, scope: list[str], percent: int, gathered: DataFrame | None = None) -> DataFrame:
    """The classes' sets, ranked. gathered: scope, rep and what linked sets gather (m, last, first)."""
    # Written, as the sets are read several times and the classes' joins move them.
    sets = durable(classes.filter("n > 0 and id = rep").select(*scope, "id", "tokens", "n").distinct())
    if gathered is not None:
        return ranked_sets(sets.join(gathered.withColumnRenamed("rep", "id"), [*scope, "id"]), scope, percent)
    zero = F.lit(0).cast("long")
    return ranked_sets(sets.withColumns({"m": zero, "last": zero, "first": zero}), scope, percent)


def _paired(classes: DataFrame, scope: list[str], percent: int) -> DataFrame:
    ranked = _sets(classes, scope, percent)
    of = lambda k, x: ranked.select(*(scope if x == "a" else ()), F.col("k").alias(k), F.col("id").alias(x), F.col("n").alias(f"n_{x}"))
    pairs = linked_pairs(ranked).join(of("k", "a"), "k").join(of("other", "b"), "other")
    swap = (F.col("n_a") == F.col("n_b")) & (F.col("a") > F.col("b"))
    first, second = F.when(swap, F.col("b")).otherwise(F.col("a")), F.when(swap, F.col("a")).otherwise(F.col("b"))
    return pairs.select(*scope, first.alias("a"), second.alias("b"), "n_shared", "n_a", "n_b")


def _classes(rows: DataFrame, scope: list[str], tokens: Column) -> DataFrame:
    """rows' sets (scope, id, tokens, n) with rep, the smallest id of those with the same set. Sets are written once and told apart by 128 bits, so that they needn't move to find their class."""
    sets = rows.select(*scope, "id", F.array_sort(tokens).alias("tokens"))
    sets = durable(sets.withColumns({"n": F.size("tokens"), "h1": F.xxhash64(F.lit(1), "tokens"), "h2": F.xxhash64(F.lit(2), "tokens")}))
    reps = sets.groupBy(*scope, "n", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("members"))
    return by_key(sets, durable(reps), [*scope, "n", "h1", "h2"], "members").select(*scope, "id", "tokens", "n", "rep")


def overlap_classes(rows: DataFrame, scope: list[str], tokens: Column) -> DataFrame:
    """id, rep, n_tokens: the smallest id with the same token set in the scope."""
    return _classes(rows, scope, tokens).select(*scope, "id", "rep", F.col("n").alias("n_tokens"))


def overlap_report(rows: DataFrame, scope: list[str], tokens: Column, percent: int = 85) -> DataFrame:
    """id, class_id, n_links: each row's class of equal token sets and the number of other rows it is linked to by equality or overlap. No pair becomes a row."""
    classes = _classes(rows, scope, tokens)
    members = classes.select(*scope, "id", "rep", F.col("n").alias("n_tokens"))
    sizes = durable(members.groupBy(*scope, "rep").agg(F.count("*").alias("members")))
    zero = F.lit(0).cast("long").alias
    ranked = _sets(classes, scope, percent, sizes.select(*scope, "rep", F.col("members").alias("m"), zero("last"), zero("first")))
    linked = linked_sets(ranked).join(ranked.select(*scope, "k", F.col("id").alias("rep")), "k").select(*scope, "rep", F.col("m").alias("outside"))
    told = sizes.join(linked, [*scope, "rep"], "left")
    full = by_key(members, told, [*scope, "rep"], "members")
    own = F.when(F.col("n_tokens") > 0, F.col("members") - 1).otherwise(F.lit(0))
    return full.select(*scope, "id", F.col("rep").alias("class_id"), (own + F.coalesce("outside", F.lit(0))).alias("n_links"))


def _by_crowd(rows: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of scopes with at most FEW rows, dealt by scope, and the other rows (None without any)."""
    sizes = durable(rows.groupBy(*scope).agg(F.count("*").alias("crowd")))
    few = by_key(rows, sizes, scope, "crowd").filter(F.col("crowd") <= FEW).drop("crowd")
    crowded = sizes.filter(F.col("crowd") > FEW)
    return few, None if crowded.isEmpty() else by_key(rows, crowded, scope, "crowd").drop("crowd")


def _usable(memories: DataFrame, scope: list[str]) -> DataFrame:
    """Memories that aren't pinned, with their place, text (norm, made here if they don't bring it) and whether they are open, as not reviewed_keep."""
    norm = F.col("norm") if "norm" in memories.columns else t.normalize_report(F.col("content"))
    open_ = F.coalesce("metadata.review_status", F.lit("")) != "reviewed_keep"
    return memories.filter(~F.col("pinned")).select(*scope, "id", F.col("pos").cast("long").alias("pos"), open_.alias("open"), norm.alias("norm"))


def _few_pairs(usable: DataFrame, scope: list[str], percent: int) -> DataFrame:
    """scope, a, b, pa, pb: near_duplicate_pairs() of scopes with few rows, each pair compared as it is, with the places of both."""
    side = lambda x: usable.select(*scope, F.col("id").alias(x), F.col("pos").alias(f"p{x}"), F.col("open").alias(f"o{x}"), F.col("norm").alias(f"n{x}"), t.token_set(F.col("norm")).alias(f"t{x}"))
    smaller = F.least(F.size("ta"), F.size("tb"))
    first = (F.col("pa") < F.col("pb")) | ((F.col("pa") == F.col("pb")) & (F.col("a") < F.col("b")))
    like = (F.col("na") == F.col("nb")) | ((smaller > 0) & (100 * F.size(F.array_intersect("ta", "tb")) >= percent * smaller))
    return side("a").filter("oa").join(side("b"), scope).filter(first & like).select(*scope, "a", "b", "pa", "pb")


def near_duplicate_pairs(memories: DataFrame, percent: int = 85, scope: list[str] | None = None) -> DataFrame:
    """a, b of memories (with pos, their list order) whose report-normalised contents are equal or overlap; a comes first.

    Neither is pinned, and the first of the two isn't reviewed_keep. Within a report of one chat all pairs are wanted, so classes are expanded here.
    """
    scope = ["chat_id", "character_id"] if scope is None else scope
    few, usable = _by_crowd(_usable(memories, scope), scope)
    near = _few_pairs(few, scope, percent).select(*scope, "a", "b")
    if usable is None:
        return near
    sets = _classes(usable, scope, t.token_set(F.col("norm")))
    classes = sets.select(*scope, "id", "rep", F.col("n").alias("n_tokens"))
    pairs = _paired(sets, scope, percent)
    same = classes.filter("n_tokens > 0").select(*scope, F.col("rep").alias("ra"), F.col("rep").alias("rb")).distinct()
    cls = pairs.select(*scope, F.col("a").alias("ra"), F.col("b").alias("rb")).unionByName(same)
    of = lambda x: classes.select(*scope, F.col("rep").alias(f"r{x}"), F.col("id").alias(x))
    expanded = cls.join(of("a"), [*scope, "ra"]).join(of("b"), [*scope, "rb"]).filter("ra <> rb or a < b").select(*scope, "a", "b")
    # Texts without letters or digits have no tokens; equal ones still are duplicates.
    blank = usable.join(classes.filter("n_tokens = 0").select("id"), "id", "left_semi").select(*scope, "id", "norm")
    blanks = blank.select(*scope, F.col("id").alias("a"), "norm").join(blank.select(*scope, F.col("id").alias("b"), "norm"), [*scope, "norm"]).filter("a < b").select(*scope, "a", "b")
    everything = expanded.unionByName(blanks)
    of = lambda x: usable.select(F.col("id").alias(x), F.col("pos").alias(f"p{x}"), F.col("open").alias(f"o{x}"))
    placed = everything.join(of("a"), "a").join(of("b"), "b")
    swap = F.col("pa") > F.col("pb")
    first, second = F.when(swap, F.col("b")).otherwise(F.col("a")), F.when(swap, F.col("a")).otherwise(F.col("b"))
    return near.unionByName(placed.filter(F.when(swap, F.col("ob")).otherwise(F.col("oa"))).select(*scope, first.alias("a"), second.alias("b")))


def near_duplicate_candidates(memories: DataFrame, percent: int = 85, scope: list[str] | None = None) -> DataFrame:
    """id, related_id: each memory that near_duplicate_pairs() would pair, once, with one of its partners; pairs are never rows.

    Of two partners the one that comes first in the list (pos) must not be reviewed_keep. So a memory needs a later partner and not to be
    reviewed itself, or an earlier partner that isn't; the last place and the first open place of its class and of linked classes tell.
    """
    scope = ["chat_id", "character_id"] if scope is None else scope
    few, usable = _by_crowd(_usable(memories, scope), scope)
    seen = lambda x, y, later: F.struct(F.col(x).alias("id"), F.struct(F.col(f"p{y}").alias("pos"), F.col(y).alias("id")).alias("other"), F.lit(later).alias("later"))
    met = _few_pairs(few, scope, percent).select(*scope, F.explode(F.array(seen("a", "b", True), seen("b", "a", False))).alias("x")).select(*scope, "x.*")
    partners = met.groupBy(*scope, "id").agg(F.min(F.when(~F.col("later"), F.col("other"))).alias("first"), F.max(F.when(F.col("later"), F.col("other"))).alias("last"))
    near = partners.select("id", F.coalesce("first.id", "last.id").alias("related_id"))
    if usable is None:
        return near
    sets = _classes(usable, scope, t.token_set(F.col("norm")))
    classes = sets.select(*scope, "id", "rep", F.col("n").alias("n_tokens"))
    place = usable.select("id", "pos", "norm", "open")
    # Texts without letters or digits have no tokens: their class is the text itself.
    kind = F.when(F.col("n_tokens") > 0, F.concat(F.lit("t"), F.col("rep").cast("string"))).otherwise(F.concat(F.lit("n"), "norm"))
    rows = durable(classes.join(place, "id").select(*scope, "id", "rep", "n_tokens", kind.alias("class"), "pos", "open"))
    ends = rows.groupBy(*scope, "class").agg(F.max("pos").alias("last"), F.min(F.when(F.col("open"), F.col("pos"))).alias("first"), F.count("*").alias("members"), F.max("n_tokens").alias("n_tokens"), F.min("rep").alias("rep"))
    ends = durable(ends)
    ranked = _sets(sets, scope, percent, ends.filter("n_tokens > 0").select(*scope, "rep", F.lit(0).cast("long").alias("m"), "last", F.coalesce("first", F.lit(NEVER)).alias("first")))
    linked = linked_sets(ranked).join(ranked.select(*scope, "k", F.concat(F.lit("t"), F.col("id").cast("string")).alias("class")), "k").select(*scope, "class", F.col("last").alias("other_last"), F.col("first").alias("other_first"))
    told = ends.select(*scope, "class", "last", "first", "members").join(linked, [*scope, "class"], "left")
    full = by_key(rows, told, [*scope, "class"], "members")
    last, first = F.greatest("last", "other_last"), F.least("first", "other_first")
    related = F.when(first < F.col("pos"), first).when(F.col("open") & (last > F.col("pos")), last)
    named = rows.select(*scope, F.col("pos").alias("related_pos"), F.col("id").alias("related_id"))
    return near.unionByName(full.select(*scope, "id", related.alias("related_pos")).filter("related_pos is not null").join(named, [*scope, "related_pos"]).select("id", "related_id"))


def shadowed_by_stable(cards: DataFrame, min_shared: int = 2, scope: list[str] | None = None, hot: float = 0.01) -> DataFrame:
    """id, related_id: episodic memories that aren't active and share min_shared signals with a stable one; the first by list order (pos).

    Scopes with few rows are compared in pairs. In others, terms that more than the share `hot` of a side's rows hold are in no join of single terms. Rows whose shared signals are all hot share min_shared hot terms:
    these meet as combinations, of which the stable side keeps only the first memory each. Other rows share a term that isn't hot.
    """
    scope = ["chat_id", "character_id"] if scope is None else scope
    signals = F.array_distinct(F.transform(F.concat("metadata.entities", "metadata.keywords"), F.lower))
    quiet = (F.col("layer") == "episodic") & (F.col("activity") != "active") & ~F.col("pinned") & (F.coalesce("metadata.review_status", F.lit("")) != "reviewed_keep")
    role = F.when(quiet, F.lit("quiet")).when(F.col("layer") == "stable", F.lit("stable"))
    rows = durable(cards.select(*scope, "id", F.col("pos").cast("long").alias("pos"), role.alias("role"), signals.alias("signals")).filter((F.size("signals") >= min_shared) & F.col("role").isNotNull()))
    few, rows = _by_crowd(rows, scope)
    side = lambda x, *names: few.filter(F.col("role") == x).select(*scope, *names)
    pairs = side("quiet", "id", "signals").join(side("stable", "pos", F.col("id").alias("related_id"), F.col("signals").alias("theirs")), scope)
    by_pair = pairs.filter(F.size(F.array_intersect("signals", "theirs")) >= min_shared).groupBy("id").agg(F.min(F.struct("pos", "related_id")).alias("first"))
    if rows is None:
        return by_pair.select("id", F.col("first.related_id").alias("related_id"))
    total, key = rows.groupBy("role").agg(F.count("*").alias("rows")), [*scope, "term"]
    terms = rows.select(*scope, "role", F.explode("signals").alias("term")).groupBy(*key, "role").agg(F.count("*").alias("df"))
    often = terms.join(F.broadcast(total), "role").filter(F.col("df") > F.greatest(F.col("rows") * hot, F.lit(1.0))).select(*key).distinct()
    # Terms that this few rows are needed to hold number less than 1 / hot for each signal of a row and side.
    often = durable(often.withColumn("often", F.lit(True)))
    tagged = rows.select("*", F.explode("signals").alias("term")).join(F.broadcast(often), key, "left")
    mine, stable = (tagged.filter(F.col("role") == x) for x in ("quiet", "stable"))
    single = mine.filter("often is null").select(*key, "id", "signals").join(stable.filter("often is null").select(*key, "pos", F.col("id").alias("related_id"), F.col("signals").alias("theirs")), key)
    by_term = single.filter(F.size(F.array_intersect("signals", "theirs")) >= min_shared).groupBy("id").agg(F.min(F.struct("pos", "related_id")).alias("first"))

    def combined(side: DataFrame, *kept: str) -> DataFrame:
        held = side.filter("often").groupBy(*scope, *kept).agg(F.sort_array(F.collect_set("term")).alias("hot")).filter(F.size("hot") >= min_shared)
        sets = F.transform("hot", lambda x: F.array(x))
        for _ in range(min_shared - 1):
            sets = F.flatten(F.transform(sets, lambda c: F.transform(F.filter("hot", lambda x: x > F.element_at(c, -1)), lambda x: F.concat(c, F.array(x)))))
        return held.select(*scope, *kept, F.explode(sets).alias("set"))

    firsts = combined(stable.withColumnRenamed("id", "related_id"), "related_id", "pos").groupBy(*scope, "set").agg(F.min(F.struct("pos", "related_id")).alias("first"), F.count("*").alias("n"))
    asked = combined(mine, "id")
    by_set = asked.join(firsts.drop("n"), [*scope, "set"]).groupBy("id").agg(F.min("first").alias("first"))
    return by_pair.unionByName(by_term).unionByName(by_set).groupBy("id").agg(F.min("first").alias("first")).select("id", F.col("first.related_id").alias("related_id"))
