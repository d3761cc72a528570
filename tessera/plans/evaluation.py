"""Evaluation over derived predictions: a document's label is the truth, its id and length make the prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import answers, scores
from tessera.plans.registry import query
from tessera.plans.retrieval import split_sql
from tessera.plans.verdicts import PAIRS_SQL, WORDS_SQL, fact_table, pairs
from tessera.shared import table

CLASSES = ["sustentado", "refutado", "evidencia_contradictoria", "evidencia_insuficiente"]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, data set, gold and predicted class, confidence, truth and a score of support."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    gold = F.when(F.col("toxic") == 1, CLASSES[3]).when(F.col("quality") == 1, CLASSES[0]).otherwise(CLASSES[1])
    pred = F.when(F.col("n_chars") % 7 == 0, CLASSES[2]).when(F.col("n_chars") % 5 == 0, CLASSES[1]).otherwise(CLASSES[0])
    return rows.select("doc_id", F.col("source").alias("dataset"), gold.alias("gold"), pred.alias("pred"), ((F.col("doc_id") * 37 + F.col("n_chars")) % 100 / 100).alias("conf"), (F.col("quality") == 1).alias("truth"))


PRED_SQL = """preds AS (
  SELECT doc_id, source AS dataset,
    CASE WHEN toxic = 1 THEN 'evidencia_insuficiente' WHEN quality = 1 THEN 'sustentado' ELSE 'refutado' END AS gold,
    CASE WHEN n_chars % 7 = 0 THEN 'evidencia_contradictoria' WHEN n_chars % 5 = 0 THEN 'refutado' ELSE 'sustentado' END AS pred,
    (doc_id * 37 + n_chars) % 100 / 100.0::DOUBLE AS conf, quality = 1 AS truth
  FROM documents JOIN labels USING (doc_id))"""


@query(f"WITH {PRED_SQL} SELECT gold, pred, count(*) AS n FROM preds GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.confusion(predictions(spark, sf_dir))


PRF_SQL = f"""{PRED_SQL}, classes AS (SELECT unnest({CLASSES}) AS class),
counts AS (SELECT class, count(*) FILTER (gold = class AND pred = class) AS tp, count(*) FILTER (pred = class) AS said, count(*) FILTER (gold = class) AS are FROM classes, preds GROUP BY class),
pr AS (SELECT class, CASE WHEN said > 0 THEN tp / said ELSE 0 END::DOUBLE AS precision, CASE WHEN are > 0 THEN tp / are ELSE 0 END::DOUBLE AS recall FROM counts),
prf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr)"""


@query(f"WITH {PRF_SQL} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM prf")
def confusion_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores.class_scores(predictions(spark, sf_dir), CLASSES)
    return found.select("class", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"WITH {PRF_SQL} SELECT (SELECT round(avg((gold = pred)::INT), 6) FROM preds) AS accuracy, (SELECT round(avg(f1), 6) FROM prf) AS macro_f1")
def accuracy_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir)
    accuracy = rows.agg(F.round(F.avg((F.col("gold") == F.col("pred")).cast("int")), 6).alias("accuracy"))
    return accuracy.join(scores.class_scores(rows, CLASSES).agg(F.round(F.avg("f1"), 6).alias("macro_f1")))  # one row each


@query(f"""WITH {PRED_SQL}, per AS (SELECT dataset, (coalesce(avg((conf >= 0.5)::INT) FILTER (truth), 0) + coalesce(avg((conf < 0.5)::INT) FILTER (NOT truth), 0)) / 2 AS b FROM preds GROUP BY dataset)
SELECT dataset, round(b, 6) AS bacc FROM per UNION ALL SELECT 'mean', round(avg(b), 6) FROM per""")
def balanced_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = predictions(spark, sf_dir).groupBy("dataset").agg(scores.balanced_accuracy(F.col("truth"), F.col("conf") >= 0.5).alias("b"))
    return per.select("dataset", F.round("b", 6).alias("bacc")).unionByName(per.agg(F.round(F.avg("b"), 6).alias("bacc")).select(F.lit("mean").alias("dataset"), "bacc"))


@query(f"""WITH {PRED_SQL}, per AS (SELECT ceil(round(conf * 10, 9)) AS bin, count(*) AS n, avg(truth::INT) AS acc, avg(conf) AS m FROM preds WHERE conf > 0 GROUP BY 1)
SELECT round(sum(n * abs(acc - m)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM per""")
def ece10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.calibration_error(predictions(spark, sf_dir), "conf", "truth").select(F.round("ece", 6).alias("ece"), "n")


@query(f"""WITH s AS (SELECT doc_id, unnest({split_sql('text', '.!?;')}) AS s FROM documents),
scored AS (SELECT doc_id, (length(s) * 37 % 101) / 100.0::DOUBLE AS p FROM s)
SELECT doc_id, max(p) AS best, min(p) AS least, count(*) AS n FROM scored GROUP BY doc_id""")
def chunk_max_fact_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text's score is that of its best chunk, a claim's that of its weakest fact."""
    pieces = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.sentences(F.col("text"))).alias("s"))
    return pieces.select("doc_id", (F.length("s") * 37 % 101 / 100).alias("p")).groupBy("doc_id").agg(F.max("p").alias("best"), F.min("p").alias("least"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PRED_SQL}, grid AS (SELECT unnest([{', '.join(f'{i / 100:.2f}' for i in range(5, 55, 5))}])::DOUBLE AS t),
per AS (SELECT dataset, t, (coalesce(avg((conf >= 0.5 AND NOT (1 - conf) <= t)::INT) FILTER (truth), 0) + coalesce(avg((NOT (conf >= 0.5 AND NOT (1 - conf) <= t))::INT) FILTER (NOT truth), 0)) / 2 AS b FROM preds, grid GROUP BY ALL),
mean AS (SELECT t, round(avg(b), 9) AS b FROM per GROUP BY t)
SELECT t, round(b, 6) AS bacc FROM mean ORDER BY b DESC, t LIMIT 1""")
def veto_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The veto threshold with the best mean balanced accuracy: all settings in one job."""
    grid = F.explode(F.lit([i / 100 for i in range(5, 55, 5)])).alias("t")
    rows = predictions(spark, sf_dir).select("dataset", "truth", "conf", grid)
    said = (F.col("conf") >= 0.5) & ~((1 - F.col("conf")) <= F.col("t"))
    per = rows.groupBy("dataset", "t").agg(scores.balanced_accuracy(F.col("truth"), said).alias("b"))
    return per.groupBy("t").agg(F.round(F.avg("b"), 9).alias("b")).orderBy(F.desc("b"), "t").limit(1).select("t", F.round("b", 6).alias("bacc"))


#: Domains that an answer cites (the first one as its source), and passages of a domain that are read.
CITES, READ = 3, 5


@query(f"""WITH {PAIRS_SQL},
cites AS (SELECT fact_id, domain, row_number() OVER (PARTITION BY fact_id ORDER BY min(pos)) AS place FROM pairs GROUP BY fact_id, domain QUALIFY place <= {CITES}),
passages AS (SELECT fact_id, domain, ev_text FROM pairs QUALIFY row_number() OVER (PARTITION BY fact_id, domain ORDER BY pos) <= {READ}),
said AS (SELECT fact_id, n, s FROM (SELECT fact_id, unnest(range(0, len(x))) AS n, unnest(x) AS s FROM (SELECT fact_id, {split_sql('fact_text', '.!?»')} AS x FROM facts)) WHERE length(s) BETWEEN 25 AND 300 AND NOT ends_with(s, '?') AND fact_id IN (SELECT fact_id FROM cites)),
support AS (SELECT fact_id, domain, place, n, max(len(list_filter({WORDS_SQL.format('s')}, lambda w: contains(lower(ev_text), w))) / greatest(len({WORDS_SQL.format('s')}), 1)) AS v FROM said JOIN cites USING (fact_id) JOIN passages USING (fact_id, domain) GROUP BY ALL),
sentences AS (SELECT avg((best >= 0.6)::INT) AS recall FROM (SELECT fact_id, n, max(v) AS best FROM support GROUP BY ALL)),
cited AS (SELECT place, coalesce(max(v), 0) >= 0.6 AS ok FROM cites LEFT JOIN support USING (fact_id, domain, place) GROUP BY fact_id, domain, place),
p AS (SELECT coalesce(avg(ok::INT) FILTER (place = 1), 0) AS prim, coalesce(avg(ok::INT) FILTER (place > 1), 0) AS sec FROM cited)
SELECT round(recall, 6) AS recall, round(prim, 6) AS primary_precision, round(sec, 6) AS secondary_precision, round(CASE WHEN recall + prim > 0 THEN 2 * recall * prim / (recall + prim) ELSE 0 END, 6) AS f1 FROM sentences, p""")
def citation_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as answers that cite their first domains: sentences that some cited domain carries, and first and further citations that carry one."""
    rows = pairs(spark, sf_dir).select("fact_id", "pos", "domain", "ev_text")
    by_domain = rows.groupBy("fact_id", "domain").agg(F.min("pos").alias("first"))
    cites = by_domain.withColumn("place", F.row_number().over(Window.partitionBy("fact_id").orderBy("first"))).where(F.col("place") <= CITES).drop("first")
    passages = answers.top_each(rows, ["fact_id", "domain"], [F.col("pos")], READ).drop("rank", "pos")
    return answers.citation_scores(fact_table(spark, sf_dir).select("fact_id", F.col("fact_text").alias("text")), cites, passages, "fact_id")


@query("""WITH runs AS (SELECT user_id, event_type, sum(value) AS total, quantile_cont(value, 0.5) AS med, min(value) AS fastest, count(*) AS n FROM events GROUP BY ALL),
prints AS (SELECT user_id, event_type, n % 3 AS print, med, fastest FROM runs),
tally AS (SELECT user_id, print, count(*) AS v FROM prints GROUP BY ALL),
votes AS (SELECT user_id, print FROM tally QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY v DESC, print) = 1),
kept AS (SELECT p.* FROM prints p JOIN votes USING (user_id, print)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY med, event_type) AS r, count(*) OVER (PARTITION BY user_id) AS n_kept FROM kept)
SELECT user_id, event_type AS winner, round(med, 6) AS median, round(fastest, 6) AS best, n_kept FROM ranked WHERE r = 1""")
def code_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose result is not the majority's are out; of the others the least median wins."""
    runs = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.percentile("value", F.lit(0.5)).alias("med"), F.min("value").alias("fastest"), F.count(F.lit(1)).alias("n"))
    prints = runs.select("user_id", "event_type", (F.col("n") % 3).alias("print"), "med", "fastest")
    votes = prints.groupBy("user_id", "print").agg(F.count(F.lit(1)).alias("v"))
    most = votes.groupBy("user_id").agg(F.min_by("print", F.struct(-F.col("v"), "print")).alias("print"))
    kept = prints.join(most, ["user_id", "print"])
    best = F.min(F.struct("med", "event_type", "fastest")).alias("b")
    return kept.groupBy("user_id").agg(best, F.count(F.lit(1)).alias("n_kept")).select("user_id", F.col("b.event_type").alias("winner"), F.round("b.med", 6).alias("median"), F.round("b.fastest", 6).alias("best"), "n_kept")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS passed, round(avg((value > 50)::INT), 6) AS rate, count(*) FILTER (value IS NULL) AS violations FROM events GROUP BY event_type")
def audit_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("value") > 50
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("passed"), F.round(F.avg(ok.cast("int")), 6).alias("rate"), F.count_if(F.col("value").isNull()).alias("violations"))
