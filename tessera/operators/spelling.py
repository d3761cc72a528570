"""Spelling within one edit, by an index of deletions.

Two words one edit apart share a key among themselves and what is left of them without one letter. The
index has a row for each word of a vocabulary and each of its keys; unknown words bring their own keys, and an equi-join
gives all candidates, which are then verified. So work grows with the words, not with pairs of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.shared import materialize

# What makes a word, the least length of one that is corrected, and letters with marks beside those without.
WORD, LEAST = r"[\p{L}\p{N}_]+", 5
MARKED, BARE = "áéíóúüñàèìòùâêîôûäëïöçãõ", "aeiouunaeiouaeiouaeiocao"


def plain(word: Column) -> Column:
    return F.translate(word, MARKED, BARE)


def words(text: Column) -> Column:
    """The words of a text that may be corrected: long enough and without capitals, which may be names."""
    return F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: (F.length(w) >= LEAST) & (w == F.lower(w)) & w.rlike(r"\p{Ll}"))


def keys(word: Column) -> Column:
    """The word itself and the word without each of its letters."""
    without = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), without))


def vocabulary(texts: DataFrame, text_column: str = "text", least: int = 2) -> DataFrame:
    """word and n of the words that stand so often in all texts."""
    each = texts.select(F.explode(words(F.col(text_column))).alias("word"))
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def index(known: DataFrame, path: str | None = None) -> DataFrame:
    """key, word and n, written in the order of the keys, so that a look-up reads only the row groups that its keys can be in."""
    rows = known.select(F.explode(keys(F.col("word"))).alias("key"), "word", "n")
    return materialize(rows.repartitionByRange("key").sortWithinPartitions("key"), "spelling", path)


def corrections(unknown: DataFrame, indexed: DataFrame) -> DataFrame:
    """word and best for the distinct words of unknown that are in no entry and one edit from some: the most frequent, then the first.

    A change of marks alone is none, nor is one that brings a u with two dots which was not there.
    """
    asked = unknown.select("word").distinct()
    strange = asked.join(indexed.where("key = word").select("word"), "word", "left_anti")
    met = strange.select(F.col("word").alias("given"), F.explode(keys(F.col("word"))).alias("key")).join(indexed, "key")
    near = met.where((F.levenshtein("given", "word") == 1) & (plain(F.col("given")) != plain(F.col("word"))) & (F.col("given").contains("ü") | ~F.col("word").contains("ü")))
    best = near.groupBy("given").agg(F.min(F.struct((-F.col("n")).alias("n"), "word")).alias("best"))
    return best.select(F.col("given").alias("word"), F.col("best.word").alias("best"))


def corrected(texts: DataFrame, indexed: DataFrame, key: list[str], text_column: str = "text") -> DataFrame:
    """The key, the corrected text and how many words were changed, for each row of texts; key names a row.

    The texts stay whole: only distinct words are joined, and each row's few corrections come back to it.
    """
    rows = materialize(texts.select(*key, F.col(text_column).alias("text")), "spelt")
    each = rows.select(*key, F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    found = materialize(corrections(each, indexed), "corrections")
    named = [F.col(k).alias(f"_{k}") for k in key]
    by_row = each.join(found, "word").groupBy(*named).agg(F.map_from_entries(F.collect_list(F.struct("word", "best"))).alias("changes"))
    tokens = F.regexp_extract_all("text", F.lit(rf"{WORD}|[^\p{{L}}\p{{N}}_]+"), F.lit(0))
    met = rows.join(by_row, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key], "left")
    spelt = F.when(F.col("changes").isNull(), F.col("text")).otherwise(F.array_join(F.transform(tokens, lambda t: F.coalesce(F.col("changes")[t], t)), ""))
    changed = F.coalesce(F.size(F.filter(tokens, lambda t: F.col("changes")[t].isNotNull())), F.lit(0)).cast("long")
    return met.select(*key, spelt.alias("text"), F.when(F.col("changes").isNull(), F.lit(0).cast("long")).otherwise(changed).alias("changed"))
