"""Lemmas from a table, for texts whose words have many forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.durable import durable
from .overlap import by_key


def with_forms(rows: DataFrame, texts: list[str], lemmas: DataFrame) -> DataFrame:
    """rows with forms, a map from each word of the texts that has a lemma to it, to be given to keywords() and entities().

    lemmas: a table (word, lemma) of any size; of several lemmas of a word the smallest counts. Distinct words meet the table once, then go back to their rows;
    words that very many rows hold do so by broadcast. So the plan doesn't grow with the table and no word is searched in it.
    """
    numbered = durable(rows.withColumn("_row", F.monotonically_increasing_id()))
    found = [t.words(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), t.PUNCTUATION, " ")) for c in texts]
    words = durable(numbered.select("_row", F.explode(F.array_distinct(F.concat(*found))).alias("word")))
    one = lemmas.groupBy("word").agg(F.min("lemma").alias("lemma")).filter("lemma is not null")
    used = durable(words.groupBy("word").agg(F.count("*").alias("n")).join(one, "word"))
    forms = by_key(words, used, ["word"], "n").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("word", "lemma"))).alias("forms"))
    return numbered.join(forms, "_row", "left").drop("_row")
