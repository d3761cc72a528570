"""From judged pairs to verdicts: source priors, one domain one voice, the fact's decision, the claim's roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import content_words, let, relevance

SUPPORTS, REFUTES, NEUTRAL = "sustenta", "refuta", "no_concluye"
SUPPORTED, REFUTED, CONFLICTING, INSUFFICIENT = "sustentado", "refutado", "evidencia_contradictoria", "evidencia_insuficiente"

# Thresholds of the decision.
SIGNAL, DOMINANCE, FULL_VOICES, LEAST_SIGNAL, CONFLICT_PROB = 0.60, 2.0, 3, 0.0, 1.1
#: Least confidence of a claim that is left alone, and the probability on both sides that makes a conflict.
CONFIDENT, CONFLICT = 0.6, 0.75

# Professional fact-checkers.
FACT_CHECKERS = (
    "politifact.com snopes.com factcheck.org fullfact.org chequeado.com maldita.es newtral.es factual.afp.com factcheck.afp.com "
    "leadstories.com checkyourfact.com boomlive.in altnews.in colombiacheck.com verificado.com.mx aosfatos.org lupa.uol.com.br "
    "correctiv.org pagellapolitica.it africacheck.org teyit.org faktisk.no demagog.org.pl verafiles.org factcheckni.org"
).split()
# Priors by kind of source, and discounts of supporting voices.
CHECKER, DOCS, ENCYCLOPEDIA, ACADEMIC, OFFICIAL, WIKINEWS, BASE = 8.0, 8.0, 2.5, 2.5, 2.0, 1.5, 1.0
ECHO, DEBUNK, ECHO_SHARE, ECHO_WORDS = 0.3, 0.25, 0.8, 6
DEBUNKED = (
    r"\b(false(ly)?|falso|falsa(mente)?|hoax|bulo|debunk\w*|misleading|no (real )?evidence|sin evidencia|desmentid\w*|desinformaci[oó]n|purported\w*"
    r"|supuesta(mente)?|alegada(mente)?|alleged(ly)?|den(y|ies|ied)|viral claim|enga[ñn]os\w*)\b"
)


def prior(domain: Column, source: Column) -> Column:
    """How reliable a source is before it says anything."""
    return (
        F.when(domain.isin(FACT_CHECKERS), CHECKER)
        .when(source == "docs-oficiales", DOCS)
        .when(domain.rlike(r"\.(wikipedia|wikiquote|wikisource|wiktionary)\.org$") | (domain == "wikidata.org"), ENCYCLOPEDIA)
        .when(source == "tribunales", OFFICIAL)
        .when(source == "academica", ACADEMIC)
        .when(domain.rlike(r"\.(gov|edu)$|\.gov\.|\.edu\."), OFFICIAL)
        .when(source == "wikinews", WIKINEWS)
        .otherwise(BASE)
    )


def echo(fact: Column, passage: Column) -> Column:
    """The passage only repeats a long claim."""
    return let(content_words(fact), lambda words: (F.size(words) >= ECHO_WORDS) & (relevance(words, passage) / F.greatest(F.size(words), F.lit(1)) >= ECHO_SHARE))


def weight(label: Column, domain: Column, source: Column, fact: Column, passage: Column, echo_factor: Column | None = None, debunk_factor: Column | None = None) -> Column:
    """The prior, less for supporting voices that echo the claim or carry debunking words."""
    supports = label == SUPPORTS
    echoed = F.when(supports & source.isin("web", "desmentidos") & echo(fact, passage), F.lit(ECHO) if echo_factor is None else echo_factor).otherwise(1.0)
    debunked = F.when(supports & passage.rlike(f"(?i){DEBUNKED}"), F.lit(DEBUNK) if debunk_factor is None else debunk_factor).otherwise(1.0)
    return prior(domain, source) * echoed * debunked


def weighted(pairs: DataFrame, echo_factor: Column | None = None, debunk_factor: Column | None = None) -> DataFrame:
    """pairs with prior and weight."""
    c = F.col
    return pairs.withColumn("prior", prior(c("domain"), c("source"))).withColumn("weight", weight(c("label"), c("domain"), c("source"), c("fact_text"), c("ev_text"), echo_factor, debunk_factor))


def voices(pairs: DataFrame, keys: tuple[str, ...] = ("fact_id",), signal: Column | None = None) -> DataFrame:
    """One voice for each domain: its strongest signal of either side, the first one on ties."""
    strong = pairs.where((F.col("label") != NEUTRAL) & (F.col("prob") >= (F.lit(SIGNAL) if signal is None else signal)))
    order = Window.partitionBy(*keys, "domain").orderBy(F.desc(F.round(F.col("prob") * F.col("weight"), 9)), "pos")
    return strong.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def decide(facts: DataFrame, spoken: DataFrame, keys: tuple[str, ...] = ("fact_id",), dominance: Column | None = None, full: Column | None = None, least: Column | None = None, conflict: Column | None = None) -> DataFrame:
    """Verdict and confidence of each of facts (those without a voice are insufficient) from the surviving voices."""
    dominance, full = (F.lit(DOMINANCE) if dominance is None else dominance), (F.lit(FULL_VOICES) if full is None else full)
    least, conflict = (F.lit(LEAST_SIGNAL) if least is None else least), (F.lit(CONFLICT_PROB) if conflict is None else conflict)
    strength = F.col("prob") * F.col("weight")
    side = lambda label, value: F.coalesce(F.sum(F.when(F.col("label") == label, value)), F.lit(0.0))
    top = lambda label, value: F.max(F.when(F.col("label") == label, value))
    sums = spoken.groupBy(*keys).agg(
        F.round(side(SUPPORTS, strength), 9).alias("pro"),
        F.round(side(REFUTES, strength), 9).alias("con"),
        F.count(F.lit(1)).alias("voices"),
        F.coalesce(top(SUPPORTS, F.col("prior") >= OFFICIAL), F.lit(False)).alias("pro_reliable"),
        F.coalesce(top(REFUTES, F.col("prior") >= OFFICIAL), F.lit(False)).alias("con_reliable"),
        F.coalesce(top(SUPPORTS, F.col("prob")), F.lit(0.0)).alias("pro_prob"),
        F.coalesce(top(REFUTES, F.col("prob")), F.lit(0.0)).alias("con_prob"),
    )
    pro, con, total = F.col("pro"), F.col("con"), F.col("pro") + F.col("con")
    cover = F.least(F.lit(1.0), F.col("voices") / full)
    tied = (pro > 0) & (con > 0) & (F.greatest(pro, con) < dominance * F.least(pro, con))
    clash = (F.col("pro_reliable") & F.col("con_reliable")) | ((F.col("pro_prob") >= conflict) & (F.col("con_prob") >= conflict))
    for_it = F.when(tied & F.col("pro_reliable"), True).when(tied & F.col("con_reliable"), False).otherwise(pro > con)
    none = total.isNull() | (total <= least)
    verdict = F.when(none, INSUFFICIENT).when(tied & clash, CONFLICTING).when(for_it, SUPPORTED).otherwise(REFUTED)
    confidence = F.when(none, 0.0).when(tied & clash, cover).when(for_it, pro / total * cover).otherwise(con / total * cover)
    return facts.join(sums, list(keys), "left").withColumn("verdict", verdict).withColumn("confidence", confidence)


def roll_up(facts: DataFrame, keys: tuple[str, ...] = ("claim_id",)) -> DataFrame:
    """The claim's verdict: the gravest of its facts, with the least confidence among those that hold it."""
    rank = F.when(F.col("verdict") == REFUTED, 0).when(F.col("verdict") == CONFLICTING, 1).when(F.col("verdict") == INSUFFICIENT, 2).otherwise(3)
    per = facts.withColumn("gravity", rank).groupBy(*keys).agg(F.min("gravity").alias("gravity"), *(F.min(F.when(F.col("gravity") == g, F.col("confidence"))).alias(f"c{g}") for g in range(4)), F.count(F.lit(1)).alias("n_facts"))
    names = F.array(*map(F.lit, (REFUTED, CONFLICTING, INSUFFICIENT, SUPPORTED)))
    return per.select(*keys, names[F.col("gravity")].alias("verdict"), F.array("c0", "c1", "c2", "c3")[F.col("gravity")].alias("confidence"), "n_facts")


def signals(facts: DataFrame, spoken: DataFrame, keys: list[str], claim: list[str]) -> DataFrame:
    """claim, confidence, conflict, insufficient, escalate from fact verdicts and their voices.

    A conflict is a fact with a voice of CONFLICT or more on either side; confidence and verdict are the claim's.
    """
    strong = lambda label: F.max((F.col("label") == label) & (F.col("prob") >= CONFLICT))
    clash = spoken.groupBy(*keys).agg((strong(SUPPORTS) & strong(REFUTES)).alias("c"))
    conflicts = facts.select(*{*keys, *claim}).join(clash, keys, "left").groupBy(*claim).agg(F.coalesce(F.max("c"), F.lit(False)).alias("conflict"))
    found = roll_up(facts, tuple(claim)).join(conflicts, claim).select(*claim, "confidence", "conflict", (F.col("verdict") == INSUFFICIENT).alias("insufficient"))
    return found.withColumn("escalate", (F.round("confidence", 6) < CONFIDENT) | F.col("conflict") | F.col("insufficient"))


def disagreement(votes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, disagreement: one less the share of the commonest verdict of a fact's votes; 0 of fewer than two."""
    counted = votes.groupBy(*keys, "verdict").count().groupBy(*keys).agg(F.max("count").alias("top"), F.sum("count").alias("all"))
    return counted.select(*keys, F.when(F.col("all") < 2, 0.0).otherwise(F.round(1 - F.col("top") / F.col("all"), 3)).alias("disagreement"))


def flipped(label: Column) -> Column:
    """The judgement of the original fact, from that of its negation."""
    return F.when(label == SUPPORTS, REFUTES).when(label == REFUTES, SUPPORTS).otherwise(label)
