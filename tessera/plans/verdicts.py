"""Claims, pairs and verdicts over the test tables.

A benchmark item is a fact, ten facts make a claim. Each labelled document is evidence for one fact;
its labels stand for the judgement, its source for a domain and a kind of source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import quantities, text
from tessera.operators import scores, verdict
from tessera.plans.registry import query
from tessera.shared import materialize, spread, table
from tessera.verify import from_store, verify

#: Claims that the facts are dealt to.
CLAIM = 10
DOMAINS = "politifact.com es.wikipedia.org viral1.com nih.gov snopes.com news.example.org wikidata.org museum.edu viral2.com blog.example.net".split()
KINDS = "web wikipedia web web desmentidos wikinews wikidata academica tribunales docs-oficiales".split()


def fact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("fact_id"), (F.col("item_id") % CLAIM).alias("claim_id"), F.col("text").alias("fact_text"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged pairs: each labelled document with the fact that its id falls to."""
    n_facts = table(spark, sf_dir, "benchmark").agg(F.count(F.lit(1)).alias("n_facts"))
    evidence = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).join(table(spark, sf_dir, "labels"), "doc_id")
    kind = (F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 10).cast("int")
    label = F.when(F.col("toxic") == 1, verdict.NEUTRAL).when(F.col("quality") == 1, verdict.SUPPORTS).otherwise(verdict.REFUTES)
    found = evidence.join(F.broadcast(n_facts)).select(  # one row
        F.col("doc_id").alias("pos"),
        F.expr("(doc_id div 3) % n_facts").alias("fact_id"),
        label.alias("label"),
        F.array(*map(F.lit, DOMAINS))[kind].alias("domain"),
        F.array(*map(F.lit, KINDS))[kind].alias("source"),
        F.col("text").alias("ev_text"),
    )
    found = found.withColumn("prob", (50 + (F.col("pos") * 37 + F.col("fact_id") * 11) % 50) / 100)
    return found.join(fact_table(spark, sf_dir), "fact_id")


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


FACTS_SQL = f"facts AS (SELECT item_id AS fact_id, item_id % {CLAIM} AS claim_id, text AS fact_text FROM benchmark)"
WORDS_SQL = r"list_distinct(regexp_extract_all(lower({0}), '[\pL\pN_]{{4,}}'))"
PAIRS_SQL = f"""{FACTS_SQL},
pairs AS (
  SELECT d.doc_id AS pos, fact_id, claim_id, fact_text, d.text AS ev_text,
         CASE WHEN toxic = 1 THEN 'no_concluye' WHEN quality = 1 THEN 'sustenta' ELSE 'refuta' END AS label,
         (50 + (d.doc_id * 37 + fact_id * 11) % 50) / 100.0::DOUBLE AS prob,
         {sql_list(DOMAINS)}[(regexp_extract(source, '(\\d+)$', 1)::INT % 10) + 1] AS domain,
         {sql_list(KINDS)}[(regexp_extract(source, '(\\d+)$', 1)::INT % 10) + 1] AS source
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id JOIN facts ON fact_id = (d.doc_id // 3) % (SELECT count(*) FROM benchmark))"""
ECHO_SQL = f"""(len({WORDS_SQL.format('fact_text')}) >= 6 AND
  len(list_filter({WORDS_SQL.format('fact_text')}, lambda w: contains(lower(ev_text), w))) / len({WORDS_SQL.format('fact_text')}) >= 0.8)"""
PRIOR_SQL = f"""CASE WHEN domain IN ({', '.join(map(q, verdict.FACT_CHECKERS))}) THEN 8.0
  WHEN source = 'docs-oficiales' THEN 8.0
  WHEN regexp_matches(domain, '\\.(wikipedia|wikiquote|wikisource|wiktionary)\\.org$') OR domain = 'wikidata.org' THEN 2.5
  WHEN source = 'tribunales' THEN 2.0 WHEN source = 'academica' THEN 2.5
  WHEN regexp_matches(domain, '\\.(gov|edu)$|\\.gov\\.|\\.edu\\.') THEN 2.0
  WHEN source = 'wikinews' THEN 1.5 ELSE 1.0 END::DOUBLE"""
DEBUNK_SQL = f"regexp_matches(ev_text, {q('(?i)' + verdict.DEBUNKED)})"
WEIGHTED_SQL = f"""{PAIRS_SQL},
weighted AS (
  SELECT *, {PRIOR_SQL} AS prior, {ECHO_SQL} AS is_echo, {DEBUNK_SQL} AS is_debunk,
    {PRIOR_SQL} * CASE WHEN label = 'sustenta' AND source IN ('web', 'desmentidos') AND {ECHO_SQL} THEN 0.3 ELSE 1 END::DOUBLE
                * CASE WHEN label = 'sustenta' AND {DEBUNK_SQL} THEN 0.25 ELSE 1 END::DOUBLE AS weight
  FROM pairs)"""
VOICES_SQL = f"""{WEIGHTED_SQL},
voices AS (
  SELECT * FROM weighted WHERE label <> 'no_concluye' AND prob >= 0.6
  QUALIFY row_number() OVER (PARTITION BY fact_id, domain ORDER BY round(prob * weight, 9) DESC, pos) = 1)"""


def decided_sql(source: str, keys: str, facts: str, dominance: str = "2.0", full: str = "3", least: str = "0", conflict: str = "1.1") -> str:
    on = " AND ".join(f"f.{k} = s.{k}" for k in keys.split(", "))
    return f"""sums AS (
  SELECT {keys},
    round(coalesce(sum(prob * weight) FILTER (label = 'sustenta'), 0), 9) AS pro,
    round(coalesce(sum(prob * weight) FILTER (label = 'refuta'), 0), 9) AS con,
    count(*) AS voices,
    coalesce(bool_or(prior >= 2.0) FILTER (label = 'sustenta'), false) AS pro_reliable,
    coalesce(bool_or(prior >= 2.0) FILTER (label = 'refuta'), false) AS con_reliable,
    coalesce(max(prob) FILTER (label = 'sustenta'), 0) AS pro_prob, coalesce(max(prob) FILTER (label = 'refuta'), 0) AS con_prob
  FROM {source} GROUP BY {keys}),
marked AS (
  SELECT f.*, s.* EXCLUDE ({keys}), least(1.0, voices / ({full})) AS cover,
    coalesce(pro > 0 AND con > 0 AND greatest(pro, con) < ({dominance}) * least(pro, con), false) AS tied,
    (pro_reliable AND con_reliable) OR (pro_prob >= {conflict} AND con_prob >= {conflict}) AS clash
  FROM {facts} f LEFT JOIN sums s ON {on}),
decided AS (
  SELECT *, CASE WHEN pro IS NULL OR pro + con <= {least} THEN 'evidencia_insuficiente'
      WHEN tied AND clash THEN 'evidencia_contradictoria'
      WHEN (tied AND pro_reliable) OR (NOT (tied AND con_reliable) AND pro > con) THEN 'sustentado' ELSE 'refutado' END AS verdict,
    CASE WHEN pro IS NULL OR pro + con <= {least} THEN 0.0
      WHEN tied AND clash THEN cover
      WHEN (tied AND pro_reliable) OR (NOT (tied AND con_reliable) AND pro > con) THEN pro / (pro + con) * cover
      ELSE con / (pro + con) * cover END AS confidence
  FROM marked)"""


@query(f"WITH {PAIRS_SQL} SELECT pos, fact_id, {ECHO_SQL} AS is_echo FROM pairs")
def echo_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("pos", "fact_id", verdict.echo(F.col("fact_text"), F.col("ev_text")).alias("is_echo"))


@query(f"WITH {PAIRS_SQL} SELECT DISTINCT domain, source, {PRIOR_SQL} AS prior FROM pairs")
def source_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("domain", "source", verdict.prior(F.col("domain"), F.col("source")).alias("prior")).distinct()


@query(f"WITH {WEIGHTED_SQL} SELECT pos, fact_id, round(weight, 9) AS weight FROM weighted")
def pair_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.weighted(pairs(spark, sf_dir)).select("pos", "fact_id", F.round("weight", 9).alias("weight"))


@query(f"WITH {VOICES_SQL} SELECT fact_id, domain, pos, label, prob FROM voices")
def one_domain_one_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.voices(verdict.weighted(pairs(spark, sf_dir))).select("fact_id", "domain", "pos", "label", "prob")


def fact_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.decide(fact_table(spark, sf_dir).select("fact_id", "claim_id"), verdict.voices(verdict.weighted(pairs(spark, sf_dir))))


FACT_SQL = f"{VOICES_SQL}, {decided_sql('voices', 'fact_id', '(SELECT fact_id, claim_id FROM facts)')}"


@query(f"WITH {FACT_SQL} SELECT fact_id, claim_id, verdict, round(confidence, 6) AS confidence, pro, con FROM decided")
def fact_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_verdicts(spark, sf_dir).select("fact_id", "claim_id", "verdict", F.round("confidence", 6).alias("confidence"), "pro", "con")


@query(f"""WITH {FACT_SQL},
ranked AS (SELECT *, CASE verdict WHEN 'refutado' THEN 0 WHEN 'evidencia_contradictoria' THEN 1 WHEN 'evidencia_insuficiente' THEN 2 ELSE 3 END AS g FROM decided),
least AS (SELECT claim_id, min(g) AS g, count(*) AS n_facts FROM ranked GROUP BY claim_id)
SELECT claim_id, any_value(verdict) AS verdict, round(min(confidence), 6) AS confidence, any_value(n_facts) AS n_facts
FROM ranked JOIN least USING (claim_id, g) GROUP BY claim_id""")
def claim_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.roll_up(fact_verdicts(spark, sf_dir)).select("claim_id", "verdict", F.round("confidence", 6).alias("confidence"), "n_facts")


GRID = [(d, n, s) for d in (1.5, 2.0, 2.5, 3.0) for n in (1, 3, 5) for s in (0.55, 0.60, 0.70)]


@query(f"""WITH {WEIGHTED_SQL},
params AS (SELECT * FROM (VALUES {', '.join(map(str, GRID))}) t(dominance, full_voices, signal)),
voices AS (
  SELECT * FROM weighted, params WHERE label <> 'no_concluye' AND prob >= signal
  QUALIFY row_number() OVER (PARTITION BY dominance, full_voices, signal, fact_id, domain ORDER BY round(prob * weight, 9) DESC, pos) = 1),
{decided_sql('voices', 'dominance, full_voices, signal, fact_id', '(SELECT * FROM params, (SELECT fact_id FROM facts))', 'f.dominance', 'f.full_voices')}
SELECT dominance::DOUBLE AS dominance, full_voices, signal::DOUBLE AS signal, verdict, count(*) AS n_facts, round(avg(confidence), 6) AS mean_confidence
FROM decided GROUP BY ALL""")
def verdict_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parameter settings in one job: thresholds are columns, weights are computed once."""
    params = F.broadcast(spark.createDataFrame(GRID, "dominance double, full_voices int, signal double"))  # one row a setting
    keys = ("dominance", "full_voices", "signal", "fact_id")
    slim = verdict.weighted(pairs(spark, sf_dir)).select("fact_id", "pos", "label", "prob", "domain", "prior", "weight")
    spoken = verdict.voices(slim.join(params, F.col("prob") >= F.col("signal")), keys, F.col("signal"))
    facts = fact_table(spark, sf_dir).select("fact_id").join(params)
    found = verdict.decide(facts, spoken, keys, F.col("dominance"), F.col("full_voices"))
    return found.groupBy("dominance", "full_voices", "signal", "verdict").agg(F.count(F.lit(1)).alias("n_facts"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


ROLLED_SQL = """ranked AS (SELECT *, CASE verdict WHEN 'refutado' THEN 0 WHEN 'evidencia_contradictoria' THEN 1 WHEN 'evidencia_insuficiente' THEN 2 ELSE 3 END AS g FROM decided),
least AS (SELECT {0}claim_id, min(g) AS g FROM ranked GROUP BY ALL),
rolled AS (SELECT {0}claim_id, any_value(verdict) AS verdict, min(confidence) AS confidence FROM ranked JOIN least USING ({0}claim_id, g) GROUP BY ALL)"""


@query(f"""WITH {FACT_SQL}, {ROLLED_SQL.format('')},
clash AS (SELECT fact_id, coalesce(bool_or(prob >= 0.75) FILTER (label = 'sustenta'), false) AND coalesce(bool_or(prob >= 0.75) FILTER (label = 'refuta'), false) AS c FROM voices GROUP BY fact_id),
conflicts AS (SELECT claim_id, coalesce(bool_or(c), false) AS conflict FROM facts LEFT JOIN clash USING (fact_id) GROUP BY claim_id)
SELECT claim_id, round(confidence, 6) AS confidence, conflict, verdict = 'evidencia_insuficiente' AS insufficient, round(confidence, 6) < 0.6 OR conflict OR verdict = 'evidencia_insuficiente' AS escalate
FROM rolled JOIN conflicts USING (claim_id)""")
def cascade_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which claims another round of search should look at: little confidence, strong voices on both sides of a fact, or too little evidence."""
    spoken = materialize(verdict.voices(verdict.weighted(pairs(spark, sf_dir))), "voices")  # read for the verdicts and for the conflicts
    facts = fact_table(spark, sf_dir).select("fact_id", "claim_id")
    return verdict.signals(verdict.decide(facts, spoken), spoken, ["fact_id"], ["claim_id"]).withColumn("confidence", F.round("confidence", 6))


#: Angles that a fact's evidence is dealt to.
N_ANGLES = 3


@query(f"""WITH {WEIGHTED_SQL}, angled AS (SELECT *, pos % {N_ANGLES} AS angle FROM weighted),
voices AS (SELECT * FROM angled WHERE label <> 'no_concluye' AND prob >= 0.6 QUALIFY row_number() OVER (PARTITION BY fact_id, angle, domain ORDER BY round(prob * weight, 9) DESC, pos) = 1),
{decided_sql('voices', 'fact_id, angle', '(SELECT DISTINCT fact_id, angle FROM angled)')},
tally AS (SELECT fact_id, verdict, count(*) AS n FROM decided GROUP BY ALL)
SELECT fact_id, CASE WHEN sum(n) < 2 THEN 0 ELSE round(1 - max(n) / sum(n), 3) END::DOUBLE AS disagreement FROM tally GROUP BY fact_id""")
def angle_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the verdicts of a fact's angles differ, each angle judged alone: one less the share of the commonest."""
    keys = ("fact_id", "angle")
    own = verdict.weighted(pairs(spark, sf_dir)).withColumn("angle", F.col("pos") % N_ANGLES)
    votes = verdict.decide(own.select(*keys).distinct(), verdict.voices(own, keys), keys)
    return verdict.disagreement(votes, ["fact_id"])


#: Settings that are ranked: those of the decision, and those of the two classes that are hard to tell.
SETTINGS = [(d, s, w, 0.0, 1.1) for d in (1.5, 2.0, 2.5, 3.0) for s in (0.55, 0.60, 0.65) for w in (0.15, 0.25, 0.40)] + [(d, 0.60, 0.25, l, c) for l in (0.0, 0.6, 1.0, 1.6, 2.4) for c in (1.1, 0.97, 0.93, 0.88) for d in (1.5, 2.0)]
CLASSES = [verdict.SUPPORTED, verdict.REFUTED, verdict.CONFLICTING, verdict.INSUFFICIENT]
WEIGHT_SQL = f"""{PRIOR_SQL} * CASE WHEN label = 'sustenta' AND source IN ('web', 'desmentidos') AND {ECHO_SQL} THEN 0.3 ELSE 1 END::DOUBLE"""


@query(f"""WITH {PAIRS_SQL},
params AS (SELECT row_number() OVER () - 1 AS setting, * FROM (VALUES {', '.join(map(str, SETTINGS))}) t(dominance, signal, debunk, least, conflict)),
plain AS (SELECT *, {PRIOR_SQL} AS prior, {WEIGHT_SQL} AS base, label = 'sustenta' AND {DEBUNK_SQL} AS is_debunk FROM pairs),
voices AS (SELECT setting, fact_id, pos, domain, label, prob, prior, base * CASE WHEN is_debunk THEN debunk ELSE 1 END::DOUBLE AS weight FROM plain, params WHERE label <> 'no_concluye' AND prob >= signal
  QUALIFY row_number() OVER (PARTITION BY setting, fact_id, domain ORDER BY round(prob * base * CASE WHEN is_debunk THEN debunk ELSE 1 END::DOUBLE, 9) DESC, pos) = 1),
{decided_sql('voices', 'setting, fact_id', '(SELECT * FROM params, (SELECT fact_id, claim_id FROM facts))', 'f.dominance', least='least', conflict='conflict')},
{ROLLED_SQL.format('setting, ')},
told AS (SELECT setting, verdict AS pred, {sql_list(CLASSES)}[claim_id % 4 + 1] AS gold FROM rolled),
classes AS (SELECT unnest({sql_list(CLASSES)}) AS class),
counts AS (SELECT setting, class, count(*) FILTER (gold = class AND pred = class) AS tp, count(*) FILTER (pred = class) AS said, count(*) FILTER (gold = class) AS are FROM told, classes GROUP BY ALL),
f AS (SELECT setting, round(avg(CASE WHEN said + are > 0 THEN 2 * tp / (said + are) ELSE 0 END), 9) AS f1 FROM counts GROUP BY setting),
acc AS (SELECT setting, round(avg((gold = pred)::INT), 9) AS accuracy FROM told GROUP BY setting)
SELECT setting, round(accuracy, 6) AS accuracy, round(f1, 6) AS macro_f1, row_number() OVER (ORDER BY accuracy DESC, f1 DESC, setting) AS rank FROM acc JOIN f USING (setting)""")
def sweep_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every setting scored against gold verdicts and ranked by accuracy, then macro F1, in one job over the pairs."""
    rows = [(n, *s) for n, s in enumerate(SETTINGS)]
    params = F.broadcast(spark.createDataFrame(rows, "setting long, dominance double, signal double, debunk double, least double, conflict double"))  # one row a setting
    slim = verdict.weighted(pairs(spark, sf_dir), debunk_factor=F.lit(1.0)).withColumn("debunked", (F.col("label") == verdict.SUPPORTS) & F.col("ev_text").rlike(f"(?i){verdict.DEBUNKED}"))
    slim = materialize(slim.select("fact_id", "pos", "label", "prob", "domain", "prior", "weight", "debunked"), "weighted")
    own = slim.join(params, F.col("prob") >= F.col("signal")).withColumn("weight", F.col("weight") * F.when(F.col("debunked"), F.col("debunk")).otherwise(1.0))
    keys = ("setting", "fact_id")
    spoken = verdict.voices(own, keys, F.col("signal"))
    facts = fact_table(spark, sf_dir).select("fact_id", "claim_id").join(params)
    found = verdict.decide(facts, spoken, keys, F.col("dominance"), least=F.col("least"), conflict=F.col("conflict"))
    told = verdict.roll_up(found, ("setting", "claim_id")).select("setting", F.col("verdict").alias("pred"), F.array(*map(F.lit, CLASSES))[(F.col("claim_id") % 4).cast("int")].alias("gold"))
    return scores.ranked(told, "setting", CLASSES).select("setting", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {PAIRS_SQL}
SELECT fact_id, CASE WHEN max(prob) FILTER (label <> 'no_concluye') >= 0.6
  THEN arg_min(label, (-prob, pos)) FILTER (label <> 'no_concluye') ELSE 'nei' END AS strongest
FROM pairs GROUP BY fact_id""")
def strongest_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With given evidence: the strongest judgement that says something, the first of equal ones."""
    speaks = F.col("label") != verdict.NEUTRAL
    best = F.min(F.when(speaks, F.struct((-F.col("prob")).alias("p"), "pos", "label"))).alias("best")
    return pairs(spark, sf_dir).groupBy("fact_id").agg(best).select("fact_id", F.when(-F.col("best.p") >= verdict.SIGNAL, F.col("best.label")).otherwise("nei").alias("strongest"))


@query(f"""WITH {PAIRS_SQL} SELECT pos, fact_id, CASE label WHEN 'sustenta' THEN 'refuta' WHEN 'refuta' THEN 'sustenta' ELSE label END AS label FROM pairs""")
def flipped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("pos", "fact_id", verdict.flipped(F.col("label")).alias("label"))


# Claims and evidence on quantities at different times; the last column is the expected label.



def period_sql(x: str) -> str:
    return f"""CASE WHEN regexp_extract({x}, {q(quantities.YEAR)}, 1) <> '' THEN regexp_extract({x}, {q(quantities.YEAR)}, 1)
      WHEN regexp_matches({x}, {q('(?i)' + quantities.PAST)}) THEN 'past' WHEN regexp_matches({x}, {q('(?i)' + quantities.PRESENT)}) THEN 'present' END"""


def quantities_sql(x: str) -> str:
    scale = "CASE lower(z[2]) " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in quantities.SCALES.items()) + " END"
    base = "CASE WHEN regexp_matches(replace(z[1], ',', ''), '^\\d+\\.?\\d*$') THEN replace(z[1], ',', '')::DOUBLE END"
    both = f"list_zip(regexp_extract_all({x}, {q('(?i)' + quantities.QUANTITY)}, 1), regexp_extract_all({x}, {q('(?i)' + quantities.QUANTITY)}, 2))"
    return f"list_filter(list_transform({both}, lambda z: CASE WHEN {scale} IS NOT NULL THEN {base} * {scale} WHEN {base} >= 100 THEN {base} END), lambda v: v IS NOT NULL)"


def downgrade_sql(source: str, keys: str) -> str:
    return f"""told AS (SELECT *, {period_sql('claim')} AS p, {period_sql('evidence')} AS r, {quantities_sql('claim')} AS a, {quantities_sql('evidence')} AS b FROM {source}),
judged AS (SELECT *,
  coalesce(CASE WHEN p = r THEN false WHEN regexp_matches(p, '^\\d+$') AND regexp_matches(r, '^\\d+$') THEN true
    WHEN p IN ('past', 'present') AND r IN ('past', 'present') THEN true
    WHEN r = 'present' AND regexp_matches(p, '^\\d+$') THEN p::INT < 2020
    WHEN p = 'present' AND regexp_matches(r, '^\\d+$') THEN r::INT < 2020 ELSE false END, false)
  AND len(a) > 0 AND len(b) > 0
  AND len(list_filter(a, lambda x: len(list_filter(b, lambda y: greatest(x, y) > 0 AND abs(x - y) / greatest(x, y) <= 0.2)) > 0)) = 0 AS differs FROM told)
SELECT {keys}, CASE WHEN label = 'refuta' AND differs THEN 'no_concluye' ELSE label END AS label, p AS claim_period, r AS evidence_period FROM judged"""


@query(f"""WITH lines AS (SELECT l_orderkey, max(l_extendedprice) AS price, max(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey),
cases AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 5 = 0 THEN 'sustenta' ELSE 'refuta' END AS label, 'The order was worth ' || floor(o_totalprice / 4)::BIGINT || ' dollars in ' || year(o_orderdate) AS claim,
  'Its largest line cost ' || floor(price)::BIGINT || ' dollars' || CASE WHEN o_orderkey % 3 = 0 THEN ' currently' ELSE ' in ' || year(shipped) END AS evidence FROM orders JOIN lines ON o_orderkey = l_orderkey), {downgrade_sql('cases', 'case_id')}""")
def period_quantity_downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What orders are said to be worth beside their largest line, with years: a refutation by a quantity of another time settles nothing."""
    c, said = F.col, lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("price"), F.max("l_shipdate").alias("shipped"))
    cases = table(spark, sf_dir, "orders").join(lines, c("o_orderkey") == c("l_orderkey")).select(
        c("o_orderkey").alias("case_id"),
        F.when(c("o_orderkey") % 5 == 0, "sustenta").otherwise("refuta").alias("label"),
        said("The order was worth ", F.floor(c("o_totalprice") / 4), " dollars in ", F.year("o_orderdate")).alias("claim"),
        said("Its largest line cost ", F.floor("price"), " dollars", F.when(c("o_orderkey") % 3 == 0, " currently").otherwise(said(" in ", F.year("shipped")))).alias("evidence"),
    )
    return cases.select("case_id", quantities.downgraded(c("label"), c("claim"), c("evidence")).alias("label"), quantities.period(c("claim")).alias("claim_period"), quantities.period(c("evidence")).alias("evidence_period"))


@query(f"WITH {PAIRS_SQL}, cases AS (SELECT pos, label, fact_text AS claim, ev_text AS evidence FROM pairs), {downgrade_sql('cases', 'pos')}")
def adjusted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return pairs(spark, sf_dir).select("pos", quantities.downgraded(c("label"), c("fact_text"), c("ev_text")).alias("label"), quantities.period(c("fact_text")).alias("claim_period"), quantities.period(c("ev_text")).alias("evidence_period"))


@query(f"""WITH {FACT_SQL}, {ROLLED_SQL.format('')},
sides AS (SELECT fact_id, list(struct_pack(domain := domain, prob := prob, pos := pos) ORDER BY prob DESC, pos) FILTER (label = 'sustenta') AS f, list(struct_pack(domain := domain, prob := prob, pos := pos) ORDER BY prob DESC, pos) FILTER (label = 'refuta') AS c FROM voices GROUP BY fact_id),
per AS (SELECT claim_id, list(struct_pack(fact_id := fact_id, verdict := verdict, confidence := round(confidence, 3), "for" := coalesce(f, []), against := coalesce(c, [])) ORDER BY fact_id) AS facts FROM decided LEFT JOIN sides USING (fact_id) GROUP BY claim_id)
SELECT claim_id, to_json(struct_pack(verdict := verdict, confidence := round(confidence, 3), facts := facts))::VARCHAR AS report FROM rolled JOIN per USING (claim_id)""")
def claim_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim's report as JSON: its verdict and, for each fact, both sides' voices by falling probability."""
    spoken = verdict.voices(verdict.weighted(pairs(spark, sf_dir)))
    entry = F.struct((-F.col("prob")).alias("order"), "pos", "domain", "prob", "label")
    sides = spoken.groupBy("fact_id").agg(F.array_sort(F.collect_list(entry)).alias("spoken"))
    spoken_or_none = F.coalesce("spoken", F.array())
    side = lambda label: F.transform(F.filter(spoken_or_none, lambda v: v["label"] == label), lambda v: F.struct(v["domain"].alias("domain"), v["prob"].alias("prob"), v["pos"].alias("pos")))
    facts = fact_verdicts(spark, sf_dir).join(sides, "fact_id", "left").withColumn("for", side(verdict.SUPPORTS)).withColumn("against", side(verdict.REFUTES))
    told = facts.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("fact_id", "verdict", F.round("confidence", 3).alias("confidence"), "for", "against"))).alias("facts"))
    rolled = verdict.roll_up(facts)
    return rolled.join(told, "claim_id").select("claim_id", F.to_json(F.struct("verdict", F.round("confidence", 3).alias("confidence"), "facts")).alias("report"))


@query(f"""WITH {FACTS_SQL},
parts AS (SELECT fact_id, list_filter(list_transform(string_split(regexp_replace(trim(fact_text, e' \\n\\t\\r'), '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s),
   lambda s: length(s) >= 8 AND NOT starts_with(s, '¿') AND NOT ends_with(s, '?') AND NOT regexp_matches(s, {q('(?i)' + text.OPINION)})) AS ok, trim(fact_text, e' \\n\\t\\r') AS whole FROM facts),
out AS (SELECT fact_id, CASE WHEN len(ok) > 0 THEN list_transform(ok, lambda s: rtrim(s, '.')) ELSE [whole] END AS f FROM parts)
SELECT fact_id, unnest(range(0, len(f))) AS n, unnest(f) AS fact FROM out""")
def claim_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_table(spark, sf_dir).select("fact_id", F.posexplode(text.facts(F.col("fact_text"))).alias("n", "fact")).withColumn("n", F.col("n").cast("long"))


OWN_FACTS_SQL = f"""own_parts AS (SELECT item_id AS claim_id, list_filter(string_split(regexp_replace(trim(text, e' \\n\\t\\r'), '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1)),
   lambda s: length(s) >= 8 AND NOT starts_with(s, '¿') AND NOT ends_with(s, '?') AND NOT regexp_matches(s, {q('(?i)' + text.OPINION)})) AS ok, trim(text, e' \\n\\t\\r') AS whole FROM benchmark),
facts AS (SELECT claim_id, unnest(range(0, len(f))) AS n, unnest(f) AS fact_text FROM (SELECT claim_id, CASE WHEN len(ok) > 0 THEN list_transform(ok, lambda s: rtrim(s, '.')) ELSE [whole] END AS f FROM own_parts))"""
FOUND_SQL = f"""passages AS (SELECT (doc_id // 3) % (SELECT count(*) FROM benchmark) AS claim_id, doc_id AS pos, text AS ev_text, {sql_list(DOMAINS)}[(regexp_extract(source, '(\\d+)$', 1)::INT % 10) + 1] AS domain FROM documents WHERE length(text) >= 20),
met AS (SELECT *, len(fw) AS k, len(list_filter(fw, lambda w: contains(lower(ev_text), w))) AS hits FROM (SELECT *, {WORDS_SQL.format('fact_text')} AS fw FROM facts) JOIN passages USING (claim_id)),
once AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY claim_id, n, left(ev_text, 120) ORDER BY hits DESC, pos) = 1),
top AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY claim_id, n ORDER BY hits DESC, pos) <= 25),
cases AS (SELECT claim_id, n, pos, fact_text AS claim, ev_text AS evidence, domain, CASE length(ev_text) % 3 WHEN 0 THEN 'no_concluye' WHEN 1 THEN 'refuta' ELSE 'sustenta' END AS label, (50 + length(ev_text) % 50) / 100.0::DOUBLE AS prob FROM top WHERE k < 3 OR hits >= 2),
adjusted AS (WITH {downgrade_sql('cases', 'claim_id, n, pos')}),
pairs AS (SELECT claim_id, n, pos, claim AS fact_text, evidence AS ev_text, domain, 'knowledge-store' AS source, a.label, prob FROM cases JOIN adjusted a USING (claim_id, n, pos)),
{WEIGHTED_SQL.removeprefix(PAIRS_SQL + ',')},
voices AS (SELECT * FROM weighted WHERE label <> 'no_concluye' AND prob >= 0.6 QUALIFY row_number() OVER (PARTITION BY claim_id, n, domain ORDER BY round(prob * weight, 9) DESC, pos) = 1)"""


def by_length(rows: DataFrame) -> DataFrame:
    """A judge that needs no model: the label and the certainty of a premise by its length."""
    n = F.length("premise")
    label = F.when(n % 3 == 0, verdict.NEUTRAL).when(n % 3 == 1, verdict.REFUTES).otherwise(verdict.SUPPORTS)
    return rows.withColumn("label", label).withColumn("prob", (50 + n % 50) / 100)


@query(f"""WITH {OWN_FACTS_SQL}, {FOUND_SQL}, {decided_sql('voices', 'claim_id, n', '(SELECT claim_id, n FROM facts)')},
ranked AS (SELECT *, round(confidence, 3) AS sure, CASE verdict WHEN 'refutado' THEN 0 WHEN 'evidencia_contradictoria' THEN 1 WHEN 'evidencia_insuficiente' THEN 2 ELSE 3 END AS g FROM decided),
least AS (SELECT claim_id, min(g) AS g, count(*) AS n_facts FROM ranked GROUP BY claim_id)
SELECT claim_id, any_value(verdict) AS verdict, min(sure) AS confidence, any_value(n_facts) AS n_facts FROM ranked JOIN least USING (claim_id, g) GROUP BY claim_id""")
def verified_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text end to end: its facts, the passages of its documents that say most of each, judged, weighed and decided."""
    items = table(spark, sf_dir, "benchmark")
    n_items = items.agg(F.count(F.lit(1)).alias("n_items"))
    kind = (F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 10).cast("int")
    passages = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).join(F.broadcast(n_items))  # one row
    passages = passages.select(F.expr("(doc_id div 3) % n_items").alias("claim_id"), F.col("doc_id").alias("pos"), "text", F.array(*map(F.lit, DOMAINS))[kind].alias("domain"))
    report = verify(items.select(F.col("item_id").alias("claim_id"), "text"), from_store(passages), by_length)
    return report.claim_verdicts.select("claim_id", "verdict", "confidence", "n_facts")
