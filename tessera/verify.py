"""Claims to verdicts, end to end: facts, evidence, judgements, decisions; and the cascade that looks again at weak facts.

Evidence comes from a retriever, judgements from a judge; both are functions on DataFrames. Facts are keyed by
(claim_id, n). A place in the evidence is (level, angle, pos): ties go to what was found first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import judges, quantities, replies, text
from tessera.operators import verdict
from tessera.shared import materialize

#: Takes rows claim_id, n, angle, query; gives claim_id, n, angle, pos, text, domain, source for them.
Retriever = Callable[[DataFrame], DataFrame]
FACT = ["claim_id", "n"]
#: Least confidence of a fact that is left alone; how many angles a level takes.
CONFIDENT, ANGLES = verdict.CONFIDENT, {1: 3, 2: 6}


@dataclass(frozen=True)
class Report:
    facts: DataFrame
    pairs: DataFrame
    fact_verdicts: DataFrame
    claim_verdicts: DataFrame
    level: int = 0


def facts_of(claims: DataFrame) -> DataFrame:
    """claim_id, n, fact of claims (claim_id, text)."""
    return claims.select("claim_id", F.posexplode(text.facts(F.col("text"))).alias("n", "fact"))


def from_store(passages: DataFrame, most: int = 25, least: int = 20, head: int = 120) -> Retriever:
    """A retriever over each claim's own passages (claim_id, pos, text, domain): those with most of the query's words.

    One passage of each head counts. A claim's passages meet its queries by an equal key; heads are reduced before the ranking.
    """
    rows = passages.where(F.length("text") >= least).select("claim_id", "pos", "text", "domain")
    query = [*FACT, "angle"]

    def retrieve(asked: DataFrame) -> DataFrame:
        met = asked.select(*query, text.content_words(F.col("query")).alias("words")).join(rows, "claim_id")
        worse = (-text.relevance(F.col("words"), F.col("text"))).alias("worse")
        first = F.min(F.struct(worse, F.col("pos"), F.col("domain"), F.col("text"))).alias("e")
        once = met.groupBy(*query, F.substring("text", 1, head).alias("head")).agg(first).select(*query, "e.*")
        ranked = once.withColumn("_rank", F.row_number().over(Window.partitionBy(*query).orderBy("worse", "pos"))).where(F.col("_rank") <= most)
        return ranked.select(*query, "pos", "text", "domain", F.lit("knowledge-store").alias("source"))

    return retrieve


def gathered(facts: DataFrame, found: DataFrame, gate: bool = True) -> DataFrame:
    """found with its facts: probative passages (all without the gate), the first of each domain and head of 120 characters."""
    met = found.join(facts, FACT)
    met = met.where(text.probative(F.col("fact"), F.col("text"))) if gate else met
    head = F.substring("text", 1, 120).alias("head")
    first = F.min_by(F.struct("angle", "pos", "text", "source"), F.struct("angle", "pos")).alias("e")
    return met.groupBy(*FACT, "domain", head).agg(first).select(*FACT, "domain", "head", "e.*")


def judged(facts: DataFrame, evidence: DataFrame, judge: judges.Judge, level: int) -> DataFrame:
    """Pairs of evidence (with hypothesis and inverted) and facts: adjusted, and turned back where the negation was judged."""
    rows = judge(evidence.withColumnRenamed("text", "premise"))
    label = quantities.downgraded(F.col("label"), F.col("hypothesis"), F.col("premise"))
    rows = rows.withColumn("label", F.when(F.col("inverted"), verdict.flipped(label)).otherwise(label)).join(facts, FACT)
    place = F.struct(F.lit(level).alias("level"), F.col("angle"), F.col("pos").cast("long").alias("pos"))
    return rows.select(*FACT, place.alias("pos"), "label", F.col("prob").cast("double").alias("prob"), "domain", "source", F.col("premise").alias("ev_text"), F.col("fact").alias("fact_text"), "head", F.col("angle").alias("vote"))


def concluded(facts: DataFrame, pairs: DataFrame, level: int) -> Report:
    keys = tuple(FACT)
    spoken = verdict.voices(verdict.weighted(pairs), keys)
    fact_verdicts = verdict.decide(facts, spoken, keys).withColumn("confidence", F.round("confidence", 3))
    return Report(facts, pairs, fact_verdicts, verdict.roll_up(fact_verdicts), level)


def verify(claims: DataFrame, retrieve: Retriever, judge: judges.Judge = judges.rule, gate: bool = True) -> Report:
    """Verdicts on claims (claim_id, text); a claim whose facts have no evidence is insufficient."""
    facts = materialize(facts_of(claims), "facts")
    asked = facts.select(*FACT, F.lit(0).alias("angle"), F.col("fact").alias("query"))
    evidence = gathered(facts, retrieve(asked), gate).join(facts, FACT).withColumnRenamed("fact", "hypothesis").withColumn("inverted", F.lit(False))
    return concluded(facts, materialize(judged(facts, evidence, judge, 0), "pairs"), 0)


def weak(report: Report) -> DataFrame:
    """Keys of the facts that a further level looks at: of claims to escalate, those that are not confidently supported."""
    spoken = verdict.voices(verdict.weighted(report.pairs), tuple(FACT))
    escalated = verdict.signals(report.fact_verdicts, spoken, FACT, ["claim_id"]).where("escalate").select("claim_id")
    return report.fact_verdicts.where((F.col("verdict") != verdict.SUPPORTED) | (F.col("confidence") < CONFIDENT)).join(escalated, "claim_id", "left_semi").select(*FACT)


def investigate(claims: DataFrame, retrieve: Retriever, judge: judges.Judge = judges.rule, wordings: DataFrame | None = None, level: int | None = None) -> Report:
    """verify(), then up to two levels of angles: the negation of a fact, and wordings of it (claim_id, n, others).

    level None: only weak facts, as long as there are any; otherwise all facts up to that level. A query is made once.
    """
    report = verify(claims, retrieve, judge)
    used = report.facts.select(*FACT, F.lower(F.trim("fact")).alias("key"))
    others = report.facts.select(*FACT).withColumn("others", F.lit([]).cast("array<string>")) if wordings is None else wordings.select(*FACT, "others")
    for step in range(1, min(2 if level is None else level, 2) + 1):
        chosen = report.facts if level is not None else report.facts.join(weak(report), FACT, "left_semi")
        angle = F.posexplode(replies.angles(F.col("fact"), F.coalesce("others", F.lit([]).cast("array<string>")), ANGLES[step])).alias("angle", "a")
        asked = chosen.join(others, FACT, "left").select(*FACT, "fact", angle).select(*FACT, "fact", "angle", "a.*").withColumn("key", F.lower(F.trim("query")))
        asked = materialize(asked.join(used, [*FACT, "key"], "left_anti"), f"angles-{step}")
        if asked.isEmpty():
            break
        seen = report.pairs.select(*FACT, "domain", "head").distinct()
        new = gathered(report.facts, retrieve(asked.select(*FACT, "angle", "query"))).join(seen, [*FACT, "domain", "head"], "left_anti")
        hypothesis = F.when(F.col("inverted"), F.col("query")).otherwise(F.col("fact")).alias("hypothesis")
        evidence = new.join(asked.select(*FACT, "angle", hypothesis, "inverted"), [*FACT, "angle"])
        pairs = report.pairs.unionByName(judged(report.facts, evidence, judge, step))
        report = concluded(report.facts, materialize(pairs, f"pairs-{step}"), step)
        used = used.unionByName(asked.select(*FACT, "key"))
    return report


def disagreement(report: Report) -> DataFrame:
    """claim_id, n, disagreement: how far the verdicts of a fact's angles differ, each angle judged alone."""
    own = report.pairs.where(F.col("pos.level") > 0).withColumn("level", F.col("pos.level"))
    keys = (*FACT, "level", "vote")
    votes = verdict.decide(own.select(*keys).distinct(), verdict.voices(verdict.weighted(own), keys), keys)
    return verdict.disagreement(votes, FACT)
