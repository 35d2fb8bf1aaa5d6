"""License scan by a positional index of rare words. Only DataFrame operations.

A template is a text with mandatory key phrases, which stand at fixed places of it. The licence words of each file are found first; a
template whose mandatory words are not all among them can't be there. Of the others the file's two highest-IDF words, by document
frequency over the whole corpus, are looked up: each occurrence in the file and each posting of the word in the template proposes a
start. Starts that both words propose are left, and there all key phrases are read at their relative places.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_BREAK, ascii_lower

#: Fixed by contract: phrase and label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further templates: label, phrases that must all occur, anywhere.
TEMPLATES = {
    "mit": ("mit license",),
    "mit-text": ("permission is hereby granted free of charge", "the software is provided as is"),
    "apache-2.0": ("apache license version 2 0",),
    "bsd-text": ("redistribution and use in source and binary forms",),
    "cc-by-nc": ("cc by nc",),
    "cc-by-sa": ("cc by sa",),
    "gpl-3.0": ("general public license version 3",),
    "gpl-2.0": ("general public license version 2",),
    "lgpl": ("lesser general public license",),
    "mpl-2.0": ("mozilla public license version 2 0",),
    "isc": ("permission to use copy modify and or distribute this software for any purpose",),
    "public-domain": ("dedicated to the public domain",),
}
#: Notices as their licences give them, in lower-case words, and the key phrases that must stand in them at their places.
TEXTS = {
    "mit-notice": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "without restriction including without limitation the rights", "publish distribute sublicense and or sell copies"),
    ),
    "bsd-notice": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "provided that the following conditions are met"),
    ),
    "apache-2.0-notice": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ("licensed under the apache license version 2 0", "may not use this file except in compliance with the license"),
    ),
    "gpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        ("you can redistribute it and or modify it under the terms of the gnu general public license", "published by the free software foundation"),
    ),
    "isc-notice": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify and or distribute this software", "provided that the above copyright notice and this permission notice appear in all copies"),
    ),
    "mpl-2.0-notice": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        ("subject to the terms of the mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file"),
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
        ("free and unencumbered software released into the public domain", "free to copy modify publish use compile sell or distribute"),
    ),
    "zlib-notice": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        ("without any express or implied warranty in no event will the authors be held liable", "damages arising from the use of this software"),
    ),
}


@dataclass(frozen=True)
class Template:
    """name, words, and the places of the key phrases as (first word, number of words)."""

    name: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, int], ...]

    @property
    def mandatory(self) -> frozenset[str]:
        return frozenset(w for a, n in self.keys for w in self.words[a : a + n])

    def postings(self, word: str) -> list[int]:
        """Where the word stands in the key phrases."""
        return [a + i for a, n in self.keys for i in range(n) if self.words[a + i] == word]


def place_of(phrase: str, text: str) -> tuple[int, int]:
    words, whole = phrase.split(), text.split()
    return next(i for i in range(len(whole)) if whole[i : i + len(words)] == words), len(words)


def index(phrases: list[str], texts: dict[str, tuple[str, tuple[str, ...]]]) -> list[Template]:
    """Phrases as templates that are all key, and texts with their key phrases."""
    out = [Template(p, tuple(p.split()), ((0, len(p.split())),)) for p in phrases]
    return out + [Template(name, tuple(text.split()), tuple(place_of(k, text) for k in keys)) for name, (text, keys) in texts.items()]


def corpus_idf(docs: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Inverse document frequency of the templates' words over all documents; as many rows as the vocabulary reach the driver."""
    listed = F.array(*map(F.lit, vocabulary))
    rows = docs.select(F.explode(F.array_intersect("words", listed)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    total = docs.count()
    found = {r["word"]: r["n"] for r in rows.collect()}
    return {w: math.log((1 + total) / (1 + found.get(w, 0))) for w in vocabulary}


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), ALNUM_BREAK), lambda w: w != "")


def _words(xs) -> Column:
    return F.array(*map(F.lit, xs))


def template_starts(template: Template, idf: dict[str, float], hits: Column, words: Column) -> Column:
    """Where the template's key phrases all stand, in order; below 0 where the file begins within the template. hits: (at, word) of the words that were looked up."""
    starts = None

    def proposed(word: str) -> Column:
        posted = F.transform(F.filter(hits, lambda h: h["word"] == word), lambda h: h["at"])
        return F.flatten(F.transform(posted, lambda at: F.transform(F.array(*map(F.lit, template.postings(word))), lambda k: at - k)))

    for w in rarest(template, idf):
        starts = proposed(w) if starts is None else F.array_intersect(starts, proposed(w))

    def whole(s: Column) -> Column:
        out = F.lit(True)
        for a, n in template.keys:
            out = out & (s + a >= 0) & (F.slice(words, F.greatest(s + a, F.lit(0)) + 1, F.lit(n)) == _words(template.words[a : a + n]))
        return out

    return F.array_sort(F.array_distinct(F.filter(starts, whole)))


def rarest(template: Template, idf: dict[str, float], n: int = 2) -> list[str]:
    """The mandatory words with the highest IDF. A file that holds all of them has no rarer ones of this template, so they are the file's."""
    return sorted(template.mandatory, key=lambda w: (-idf[w], w))[:n]


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, texts: dict[str, tuple[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """doc_id, n_words, places array<struct<phrase, start>>, base_labels, own_labels, score for every row.

    Null texts are empty: no words, no labels, score 0. Repeated rows are scanned each for itself; an empty
    table gives an empty result; other columns are ignored. Score: the largest IDF share of a template's phrases that stand in the text;
    1 for a notice with all its key phrases at their places.
    """
    templates, texts = TEMPLATES if templates is None else templates, TEXTS if texts is None else texts
    phrases = [*BASE, *dict.fromkeys(p for ps in templates.values() for p in ps if p not in BASE)]
    indexed = index(phrases, texts)
    vocabulary = sorted(set().union(*(t.mandatory for t in indexed)))
    idf = corpus_idf(docs.select(words_of(F.col("text")).alias("words")), vocabulary)
    rows = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    rows = rows.withColumn("n_words", F.size("words").cast("long")).withColumn("known", F.array_intersect("words", _words(vocabulary)))
    # Which templates a file may hold, and the words to look up for these.
    may = {t.name: F.size(F.array_intersect(_words(sorted(t.mandatory)), F.col("known"))) == len(t.mandatory) for t in indexed}
    none = F.array().cast("array<string>")
    wanted = F.array_distinct(F.concat(*[F.when(may[t.name], _words(rarest(t, idf))).otherwise(none) for t in indexed]))
    rows = rows.withColumn("wanted", F.when(F.size("known") > 0, wanted).otherwise(none))
    at = F.transform("words", lambda w, i: F.when(F.array_contains("wanted", w), F.struct(i.alias("at"), w.alias("word"))))
    rows = rows.withColumn("hits", F.when(F.size("wanted") > 0, F.filter(at, lambda h: h.isNotNull())))
    empty_starts = F.array().cast("array<bigint>")
    starts = {t.name: F.when(may[t.name], F.transform(template_starts(t, idf, F.col("hits"), F.col("words")), lambda s: s.cast("long"))).otherwise(empty_starts) for t in indexed}
    found = F.array(*[F.struct(F.lit(p).alias("phrase"), x.alias("starts")) for p, x in starts.items()])
    empty = F.array().cast("array<struct<phrase:string,starts:array<bigint>>>")
    rows = rows.select("doc_id", "n_words", F.when(F.col("hits").isNull(), empty).otherwise(F.filter(found, lambda x: F.size(x["starts"]) > 0)).alias("places"))
    has = lambda p: F.exists("places", lambda x: x["phrase"] == p)
    base = F.array_compact(F.array(*[F.when(has(p), F.lit(label)) for p, label in BASE.items()]))
    own, shares = [F.when(has(name), F.lit(name)) for name in texts], [F.when(has(name), F.lit(1.0)).otherwise(F.lit(0.0)) for name in texts]
    for label, ps in templates.items():
        all_there = has(ps[0])
        for p in ps[1:]:
            all_there = all_there & has(p)
        own.append(F.when(all_there, F.lit(label)))
        weight = {p: sum(idf[w] for w in p.split()) + 1e-9 for p in ps}
        shares.append(sum((F.when(has(p), F.lit(weight[p] / sum(weight.values()))).otherwise(F.lit(0.0)) for p in ps), F.lit(0.0)))
    shares += [F.when(has(p), F.lit(1.0)).otherwise(F.lit(0.0)) for p in BASE]
    return rows.select("doc_id", "n_words", "places", base.alias("base_labels"), F.array_compact(F.array(*own)).alias("own_labels"), F.least(F.greatest(*shares), F.lit(1.0)).alias("score"))


def license_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per document."""
    got = scan(docs)
    base = F.flatten(F.transform(F.filter("places", lambda x: x["phrase"].isin(list(BASE))), lambda x: x["starts"]))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return got.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base").alias("first_word"), F.array_max("base").alias("last_word"),
        joined(F.col("base_labels")).alias("base_labels"), joined(F.concat("base_labels", "own_labels")).alias("labels"), F.round("score", 6).alias("score"),
    )
