"""Audits of judges and labels, quantised models, and claims rewritten by a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import replies, text
from tessera.operators import sampling, scores
from tessera.plans.registry import query
from tessera.plans.retrieval import split_sql
from tessera.plans.verdicts import q, sql_list
from tessera.shared import table

#: What a judge answers, in turn.
SAID = ["Yes, it is.", "The answer is NO.", "unclear", "<think>no</think> yes", "nothing known", "No."]


def said(at: Column) -> Column:
    return F.array(*map(F.lit, SAID))[(at % len(SAID)).cast("int")]


def verdict_sql(at: str) -> str:
    return f"CASE regexp_extract(lower({sql_list(SAID)}[{at} % {len(SAID)} + 1]), '\\b(yes|no)\\b', 1) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END"


@query(f"""WITH docs AS (SELECT doc_id, quality, {split_sql('text', '.!?')} AS s FROM documents JOIN labels USING (doc_id)),
judged AS (SELECT doc_id, quality AS gold, {verdict_sql('doc_id')} AS whole, (SELECT min({verdict_sql('(doc_id + k)')}) FROM (SELECT unnest(range(0, least(len(s), 3))) AS k)) AS facts FROM docs),
known AS (SELECT * FROM judged WHERE whole IS NOT NULL AND facts IS NOT NULL),
long AS (SELECT gold, 'whole' AS judge, whole AS said FROM known UNION ALL SELECT gold, 'facts', facts FROM known)
SELECT judge, count(*) AS n, round(coalesce(avg(said) FILTER (gold = 1), 0), 6) AS tpr, round(coalesce(avg(1 - said) FILTER (gold = 0), 0), 6) AS tnr,
  round((coalesce(avg(said) FILTER (gold = 1), 0) + coalesce(avg(1 - said) FILTER (gold = 0), 0)) / 2, 6) AS bacc FROM long GROUP BY judge""")
def teacher_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge of whole claims against one of their facts, of which the least counts; items that either cannot read are left out."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.col("quality").alias("gold"), F.least(F.size(text.sentences(F.col("text"), ".!?")), F.lit(3)).alias("n"))
    facts = F.array_min(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: replies.yes_or_no(said(F.col("doc_id") + k))))  # null answers do not count
    judged = rows.select("gold", replies.yes_or_no(said(F.col("doc_id"))).alias("whole"), facts.alias("facts")).where("whole IS NOT NULL AND facts IS NOT NULL")
    long = judged.select("gold", F.explode(F.array(*(F.struct(F.lit(c).alias("judge"), F.col(c).alias("said")) for c in ("whole", "facts")))).alias("x")).select("gold", "x.*")
    return scores.judges(long, "judge", "gold", "said")


@query(f"""WITH rows AS (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) AS n FROM labels WHERE toxic = 0),
dump AS (SELECT (doc_id * 13 % 100) / 100.0::DOUBLE AS p, row_number() OVER (ORDER BY doc_id) AS n FROM labels WHERE toxic = 0)
SELECT doc_id, quality AS label, {verdict_sql('doc_id')} AS verdict, p AS earlier, NULL::DOUBLE AS other FROM rows JOIN dump USING (n)""")
def label_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels beside a judge's verdicts and, by place in order, beside a dump of scores; a dump of another length is not used."""
    labels = table(spark, sf_dir, "labels")
    rows = labels.where("toxic = 0").select("doc_id", "quality")
    scored = lambda df: df.select("doc_id", ((F.col("doc_id") * 13) % 100 / 100).alias("p"))
    found = sampling.beside(rows, scored(rows), "doc_id", "p", "earlier")
    found = sampling.beside(found, scored(labels), "doc_id", "p", "other")
    return found.select("doc_id", F.col("quality").alias("label"), replies.yes_or_no(said(F.col("doc_id"))).alias("verdict"), "earlier", "other")


@query("""WITH runs AS (SELECT unnest(['full', 'int8']) AS model, doc_id, quality, unnest([(doc_id % 10 < 9)::INT, (doc_id % 20 < 17)::INT]) AS hit, unnest([doc_id % 7 + 10, doc_id % 5 + 3]) / 1000.0 AS seconds FROM labels)
SELECT model, round(avg(hit), 6) AS accuracy, round(sum(seconds) / count(*) * 1000, 6) AS ms_per_pair, count(*) AS n FROM runs GROUP BY model""")
def quantised_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model and its quantised form: share of right labels and milliseconds a pair."""
    d = F.col("doc_id")
    entry = lambda name, hit, ms: F.struct(F.lit(name).alias("model"), hit.alias("hit"), (ms / 1000).alias("seconds"))
    runs = table(spark, sf_dir, "labels").select(F.explode(F.array(entry("full", d % 10 < 9, d % 7 + 10), entry("int8", d % 20 < 17, d % 5 + 3))).alias("r")).select("r.*")
    return scores.speed(runs, "model", "hit", "seconds")


#: What a model writes for a claim, in turn: a small edit, one with marks around it, the claim itself, another claim, nothing.
EDITED = "claim || ' indeed'"
FORMS = [f"'Rewritten claim: ' || {EDITED}", f"'**' || {EDITED} || '**'", f"'\"' || {EDITED} || '\"'", "lower(claim)", "'Something else entirely'", "''"]
MOST = 200


@query(f"""WITH c AS (SELECT doc_id, {split_sql('text', '.!?')}[1] AS claim, md5(doc_id::VARCHAR || '42') AS h FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
g AS (SELECT *, CASE doc_id % {len(FORMS)} {' '.join(f'WHEN {n} THEN {form}' for n, form in enumerate(FORMS))} END AS raw FROM c),
clean AS (SELECT *, trim(trim(trim(replace(regexp_replace(raw, '^\\s*(?:rewritten claim|new claim|claim|answer)\\s*:\\s*', '', 'i'), '**', '')), '"')) AS new FROM g),
w AS (SELECT *, list_distinct(regexp_extract_all(lower(claim), '[\\pL\\pN_]+')) AS a, list_distinct(regexp_extract_all(lower(new), '[\\pL\\pN_]+')) AS b FROM clean),
ok AS (SELECT *, len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1) AS j FROM w WHERE new <> '' AND lower(new) <> lower(claim) AND len(a) > 0 AND len(b) > 0),
numbered AS (SELECT *, row_number() OVER (ORDER BY h) AS n FROM ok WHERE j >= 0.5 AND j < 1)
SELECT doc_id, CASE WHEN n % 2 = 1 THEN 'REFUTES' ELSE 'NOT ENOUGH INFO' END AS label, sha256(new) AS claim FROM numbered WHERE n <= {MOST}""")
def synthetic_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewritten claims without a model's marks, if they are small edits; labels in turn, so many in a hash order."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id")
    # Each in a row of its own by explode(), through which no filter is pushed: claims and edits are made once, not in each place that names them.
    rows = rows.select("doc_id", F.explode(F.array(text.first_sentence(F.col("text"), ".!?"))).alias("claim"), F.concat(sampling.order("doc_id", 42)).alias("h"))
    raw = F.expr(f"CASE doc_id % {len(FORMS)} " + " ".join(f"WHEN {n} THEN {form}" for n, form in enumerate(FORMS)) + " END")
    edits = rows.select("*", F.explode(F.array(replies.unmarked(raw))).alias("new")).where(replies.small_edit(F.col("claim"), F.col("new")))
    found = sampling.numbered(edits.select("doc_id", "h", "new"), "h").where(F.col("n") <= MOST)
    return found.select("doc_id", F.when(F.col("n") % 2 == 1, "REFUTES").otherwise("NOT ENOUGH INFO").alias("label"), F.sha2("new", 256).alias("claim"))
