"""Terms and groups: languages by function words, topics' terms, antecedents, greedy grouping."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import FUNCTION_WORDS, key_terms

__all__ = ["antecedents", "greedy_groups", "key_terms", "languages"]


def languages(rows: DataFrame, key: str, column: str, default: str = "es") -> DataFrame:
    """key and detected: each word counts for its languages in equal parts; a strict winner with two words or more. Nothing is shuffled."""
    return rows.select(key, language(F.col(column), default).alias("detected"))


def language(text: Column, default: str) -> Column:
    own = {lang: words.split() for lang, words in FUNCTION_WORDS.items()}
    shared = Counter(w for words in own.values() for w in words)
    words = F.transform(F.split(F.lower(text), r"\s+"), lambda x: F.btrim(x, F.lit("¿?¡!.,;:«»\"'()")))
    known = F.filter(words, lambda w: w.isin(sorted(shared)))

    def score(found: Column, n: int, lang: str) -> Column:
        hits = F.filter(found, lambda w: w.isin(own[lang]))
        # Words of one language weigh 1, those of k languages 1/k each.
        among = lambda k: F.size(F.filter(hits, lambda w: w.isin([x for x in own[lang] if shared[x] == k])))
        parts = [among(k) / k for k in sorted({shared[x] for x in own[lang]})]
        return F.struct(F.round(reduce(Column.__add__, parts), 6).alias("s"), F.lit(-n).alias("n"), F.lit(lang).alias("lang"), F.size(hits).alias("hits"))

    def judged(found: Column) -> Column:
        scores = F.filter(F.array(*(score(found, n, lang) for n, lang in enumerate(own))), lambda x: x["hits"] > 0)
        return F.get(F.transform(F.array(scores), winner), F.lit(0))

    def winner(scores: Column) -> Column:
        best = F.array_max(scores)
        alone = F.size(F.filter(scores, lambda x: x["s"] == best["s"])) == 1
        return F.when((F.size(scores) > 0) & alone & (best["hits"] >= 2), best["lang"]).otherwise(default)

    # Bound within an array, so that the words are looked up once.
    return F.coalesce(F.get(F.transform(F.array(known), judged), F.lit(0)), F.lit(default))


def antecedents(words: DataFrame, group: str, turn: str, word: str) -> DataFrame:
    """For each turn the earlier one with the most weight of shared words; a word weighs 1 / its turns."""
    rare = words.withColumn("v", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(group, word)))
    earlier = rare.select(group, word, F.col(turn).alias("antecedent"))
    met = rare.join(earlier, [group, word]).where(F.col("antecedent") < F.col(turn)).groupBy(group, turn, "antecedent").agg(F.round(F.sum("v"), 6).alias("score"))
    best = F.min(F.struct((-F.col("score")).alias("s"), "antecedent")).alias("b")
    return met.groupBy(group, turn).agg(best).select(group, turn, F.col("b.antecedent").alias("antecedent"), (-F.col("b.s")).alias("score"))


def remembered(words: DataFrame, group: str, turn: str, word: str, alike: float, sure: float = 0.5, verbatim: int = 20, compacted: int = 200) -> DataFrame:
    """group, turn, antecedent and how: the turn that a later one goes back to.

    By rare words if one earlier turn has `sure` weight of them; else by meaning, the most alike of the remembered turns
    before the last one if it is over `alike` (of equal ones the earliest); else the last one. Remembered are as many
    turns as are kept verbatim and compacted, so that each turn meets a bounded number of others: both sides are cut into
    stretches of that length, and a turn meets its own and the one before. words: a row for each word of a turn.
    """
    span = verbatim + compacted
    rare = antecedents(words, group, turn, word).where(F.col("score") >= sure).select(group, turn, F.col("antecedent").alias("exact"))
    # A turn's vector: its words hashed to 256 places.
    places = words.select(group, turn, F.substring(F.md5(word), 1, 2).alias("place")).groupBy(group, turn, "place").agg(F.count(F.lit(1)).alias("c"))
    norms = places.groupBy(group, turn).agg(F.sum(F.col("c") * F.col("c")).alias("norm"))
    vectors = places.join(norms, [group, turn])
    now = vectors.withColumn("stretch", F.floor(F.col(turn) / span))
    then = vectors.select(group, F.explode(F.array(F.floor(F.col(turn) / span), F.floor(F.col(turn) / span) + 1)).alias("stretch"), F.col(turn).alias("antecedent"), "place", F.col("c").alias("d"), F.col("norm").alias("other"))
    met = now.join(then, [group, "stretch", "place"]).where((F.col("antecedent") < F.col(turn) - 1) & (F.col("antecedent") >= F.col(turn) - span))
    scores = met.groupBy(group, turn, "antecedent").agg(F.round(F.sum(F.col("c") * F.col("d")) / F.sqrt(F.max(F.col("norm") * F.col("other"))), 6).alias("score"))
    near = scores.where(F.col("score") > alike).groupBy(group, turn).agg(F.min(F.struct((-F.col("score")).alias("s"), "antecedent")).alias("b")).select(group, turn, F.col("b.antecedent").alias("near"))
    turns = words.select(group, turn).distinct().join(rare, [group, turn], "left").join(near, [group, turn], "left")
    how = F.when(F.col("exact").isNotNull(), "words").when(F.col("near").isNotNull(), "meaning").otherwise("last")
    return turns.select(group, turn, F.coalesce("exact", "near", F.col(turn) - 1).alias("antecedent"), how.alias("how")).where(F.col("antecedent") >= 0)


def greedy_groups(rows: DataFrame, key: str, order: str, terms: str) -> DataFrame:
    """key, part, size and terms: each row joins the first group with a common term; groups never merge.

    The rule depends on the order of a key's rows (eight of a question's passages), so it runs in Python.
    """

    def run(own: pd.DataFrame) -> pd.DataFrame:
        groups: list[tuple[set[str], dict[str, int], list[int]]] = []
        for _, row in own.sort_values(order).iterrows():
            mine = [t.lower() for t in row[terms]]
            found = next((g for g in groups if g[0] & set(mine)), None)
            if found is None:
                groups.append(found := (set(), {}, []))
            found[0].update(mine)
            found[2].append(int(row[order]))
            for t in mine:
                found[1][t] = found[1].get(t, 0) + 1
        large = [g for g in groups if len(g[2]) >= 2]
        large = sorted(large, key=lambda g: -len(g[2]))[:3] if len(large) >= 2 else []
        top = [",".join(sorted(g[1], key=lambda t: (-g[1][t], t))[:3]) for g in large]
        return pd.DataFrame({key: own[key].iloc[:1].repeat(len(large)).to_list(), "part": range(len(large)), "size": [len(g[2]) for g in large], "terms": pd.Series(top, dtype=object)})

    return rows.groupBy(key).applyInPandas(run, f"{key} long, part long, size long, terms string")
