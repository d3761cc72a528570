"""Answers and their evidence: whose passages are shown, who corroborates, which sentences nothing supports."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text

#: Support from which on a passage carries a sentence; characters of a piece of an observation and how many pieces are read.
CARRIES, PIECE, PIECES = 0.6, 400, 40
UNVERIFIED, UNSOURCED, UNSUPPORTED = "«[sin verificar]»", "Aviso: respondí sin consultar ninguna fuente.", "Aviso: gran parte de esta respuesta no está sustentada por lo observado."


def top_each(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group; Spark keeps no more of a group in any task."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)


def without_domains(rows: DataFrame, by: str, excluded: list[str], domain: str = "domain") -> DataFrame:
    """rows of other domains; all rows of a group that has no others."""
    others = rows.groupBy(by).agg(F.max(~F.col(domain).isin(excluded)).alias("_any"))
    return rows.join(others, by).where(~F.col("_any") | ~F.col(domain).isin(excluded)).drop("_any")


def corroborating(rows: DataFrame, by: str, order: list[Column], supports: Column, most: int = 2, checked: int = 15) -> DataFrame:
    """by, domain, rank: of the `checked` rows after a group's first, other domains whose first row supports it."""
    ranked = top_each(rows.withColumn("_supports", supports), [by], order, checked + 1)
    first = ranked.groupBy(by, "domain").agg(F.min("rank").alias("rank"), F.min_by("_supports", "rank").alias("_supports"))
    held = first.where((F.col("rank") > 1) & F.col("_supports"))
    return top_each(held.withColumnRenamed("rank", "_rank"), [by], [F.col("_rank")], most).select(by, "domain", "rank")


def answer_sentences(rows: DataFrame, key: str, order: str, heads: int = 3, size: int = 220) -> DataFrame:
    """key, order, s of texts (key, order, text): sentences that can answer; where a key has none, the heads of its first texts."""
    said = rows.select(key, order, F.explode(text.answering(F.col("text"))).alias("s"))
    rest = rows.where("trim(text) <> ''").join(said.select(key).distinct(), key, "left_anti")
    first = top_each(rest, [key], [F.col(order)], heads).select(key, order, text.strip(F.substring("text", 1, size)).alias("s"))
    return said.unionByName(first)


def overlap(sentence: Column, passage: Column) -> Column:
    """A stand-in for a model's entailment: the share of a sentence's words that the passage has."""
    return text.let(text.content_words(sentence), lambda words: text.relevance(words, passage) / F.greatest(F.size(words), F.lit(1)))


def review(answers: DataFrame, observations: DataFrame, key: str, entailment: Callable[[Column, Column], Column] = overlap) -> DataFrame:
    """key, text with unsupported sentences marked, and n_marked.

    answers: key, text. observations: key, pos, text. A sentence stands if an observation has it word for word or if
    one of the first PIECES pieces of the observations entails it.
    """
    parts = answers.select(key, F.posexplode(text.sentences(F.col("text"), ".!?»")).alias("n", "s"))
    sized = F.length("s").between(25, 300)
    parts = parts.withColumn("sized", sized).withColumn("factual", sized & ~F.col("s").endswith("?") & ~F.col("s").startswith("```"))
    claims = parts.where("factual").select(key, "n", "s", text.plain_key("s").alias("plain"))
    # Verbatim: whole observations; entailment: pieces by their place among all pieces of the key.
    whole = observations.select(key, text.plain_key("text").alias("seen"))
    verbatim = claims.join(whole, key).where(F.contains("seen", F.col("plain"))).select(key, "n").distinct().withColumn("carried", F.lit(True))
    count = F.ceil(F.length("text") / PIECE)
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    places = observations.select(key, "pos", count.alias("count")).withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).where(F.col("before") < PIECES)
    pieces = observations.join(places, [key, "pos"]).where("count > 0").select(key, "text", F.explode(F.sequence(F.lit(0), F.least(F.col("count"), PIECES - F.col("before")) - 1)).alias("k"))
    pieces = pieces.select(key, F.substr("text", (F.col("k") * PIECE + 1).cast("int"), F.lit(PIECE)).alias("piece"))
    entailed = claims.join(pieces, key).groupBy(key, "n").agg(F.max(entailment(F.col("s"), F.col("piece"))).alias("score")).where(F.col("score") >= CARRIES).select(key, "n", F.lit(True).alias("carried"))
    carried = verbatim.unionByName(entailed).distinct()
    marked = parts.join(carried, [key, "n"], "left").withColumn("marked", F.col("factual") & F.col("carried").isNull())
    said = F.when(F.col("marked"), F.concat("s", F.lit(f" {UNVERIFIED}"))).otherwise(F.col("s"))
    joined = marked.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", said.alias("t")))), lambda x: x["t"]), " ").alias("t"), F.count_if("marked").alias("n_marked"), F.count_if("sized").alias("n_sized"))  # one answer's sentences
    seen = observations.select(key).distinct().withColumn("seen", F.lit(True))
    notice = F.when(F.col("seen").isNull() & (F.col("n_marked") > 0), UNSOURCED).when(F.col("seen") & (F.col("n_marked") > F.col("n_sized") / 2), UNSUPPORTED)
    return joined.join(seen, key, "left").select(key, F.concat_ws("\n", notice, "t").alias("text"), "n_marked")


def stated(text_column: Column) -> Column:
    """The sentences of an answer that state something."""
    return F.filter(text.sentences(text_column, ".!?»"), lambda s: F.length(s).between(25, 300) & ~s.endswith("?"))


def citation_scores(answers: DataFrame, cites: DataFrame, passages: DataFrame, key: str, entailment: Callable[[Column, Column], Column] = overlap, carries: float = CARRIES) -> DataFrame:
    """recall, primary_precision, secondary_precision and f1, in one row.

    answers: key, text; cites: key, domain, place (1: the source, more: also covered by); passages: key, domain, ev_text.
    An answer without citations does not count. recall: sentences that some cited domain carries; precisions: cited domains that
    carry some sentence; f1: of recall and the first precision.
    """
    from tessera.operators.scores import share

    said = answers.select(key, F.posexplode(stated(F.col("text"))).alias("n", "s"))
    met = said.join(cites, key).join(passages, [key, "domain"])
    support = met.groupBy(key, "domain", "place", "n").agg(F.max(entailment(F.col("s"), F.col("ev_text"))).alias("v"))
    recall = support.groupBy(key, "n").agg(F.max("v").alias("v")).agg(F.avg((F.col("v") >= carries).cast("int")).alias("recall"))
    used = support.groupBy(key, "domain", "place").agg(F.max("v").alias("v"))
    held = (F.coalesce("v", F.lit(0.0)) >= carries).cast("int")
    part = lambda which: share(F.sum(F.when(which, held)), F.sum(which.cast("int")))
    precision = cites.join(used, [key, "domain", "place"], "left").agg(part(F.col("place") == 1).alias("p"), part(F.col("place") > 1).alias("q"))
    r, p = F.coalesce("recall", F.lit(0.0)), F.coalesce("p", F.lit(0.0))
    return recall.join(precision).select(F.round(r, 6).alias("recall"), F.round(p, 6).alias("primary_precision"), F.round(F.coalesce("q", F.lit(0.0)), 6).alias("secondary_precision"), F.round(share(2 * r * p, r + p), 6).alias("f1"))  # one row each


def rendered(role: str, content: str) -> str:
    return f"<|im_start|>{role}\n{content}<|im_end|>\n"


def fold(turns: list[tuple[str, str]], budget: int, kept: int = 4, head: int = 120) -> list[tuple[str, str]]:
    """turns within the budget: from the oldest on, each is cut to a line, then left out; the last `kept` stay."""
    size = sum(len(rendered(*t)) for t in turns)
    rest = list(turns)
    first: tuple[str, str] | None = None  # the oldest turn, once it is cut
    while size > budget and len(rest) + (first is not None) > kept:
        if first is not None:
            size, first = size - len(rendered(*first)), None
            continue
        role, content = rest.pop(0)
        size -= len(rendered(role, content))
        line = f"[compactado {role}] {content[:head]}".replace("\n", " ")
        if len(line) < len(content) and not content.startswith("[compactado "):
            first = ("user", line)
            size += len(rendered(*first))
    return ([first] if first else []) + rest


def folded(rows: DataFrame, key: str, order: str, role: str, content: str, budget: int) -> DataFrame:
    """key, n_turns, size: each conversation folded to the budget. One step depends on the last, so it runs in Python."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(order)
        left = fold([(r or "", c or "") for r, c in zip(own[role], own[content], strict=True)], budget)
        return pd.DataFrame({key: own[key].iloc[:1].to_list(), "n_turns": [len(left)], "size": [sum(len(rendered(*t)) for t in left)]})

    return rows.select(key, order, role, content).groupBy(key).applyInPandas(run, f"{key} long, n_turns long, size long")
