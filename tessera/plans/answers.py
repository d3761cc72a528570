"""Answers with their evidence, over the judged pairs, documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import answers, sampling, verdict
from tessera.plans.registry import query
from tessera.plans.retrieval import split_sql
from tessera.plans.verdicts import DOMAINS, PAIRS_SQL, VOICES_SQL, WORDS_SQL, pairs, sql_list
from tessera.shared import table


def best() -> list:
    return [F.col("prob").desc(), F.col("pos")]


@query(f"WITH {VOICES_SQL} SELECT fact_id, label, pos, row_number() OVER w AS rank FROM voices WINDOW w AS (PARTITION BY fact_id, label ORDER BY prob DESC, pos) QUALIFY row_number() OVER w <= 3")
def evidence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three likeliest voices of each side of a fact."""
    voices = verdict.voices(verdict.weighted(pairs(spark, sf_dir)))
    return answers.top_each(voices.select("fact_id", "label", "pos", "prob"), ["fact_id", "label"], best(), 3).select("fact_id", "label", "pos", F.col("rank").cast("long").alias("rank"))


EXCLUDED = DOMAINS[:7]


@query(f"""WITH {PAIRS_SQL}, marked AS (SELECT fact_id, pos, domain, domain NOT IN (SELECT unnest({sql_list(EXCLUDED)})) AS other FROM pairs)
SELECT fact_id, pos, domain FROM (SELECT *, bool_or(other) OVER (PARTITION BY fact_id) AS any_other FROM marked) WHERE other OR NOT any_other""")
def excluded_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of domains that were not rejected; all of it where nothing else is left."""
    return answers.without_domains(pairs(spark, sf_dir).select("fact_id", "pos", "domain"), "fact_id", EXCLUDED)


@query(f"""WITH {PAIRS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY prob DESC, pos) AS place FROM pairs),
first AS (SELECT fact_id, domain, min(place) AS place, arg_min(label = 'sustenta' AND prob >= 0.6, place) AS holds FROM ranked WHERE place <= 16 GROUP BY ALL)
SELECT fact_id, domain, row_number() OVER w AS rank FROM first WHERE place > 1 AND holds WINDOW w AS (PARTITION BY fact_id ORDER BY place) QUALIFY row_number() OVER w <= 2""")
def corroborating_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two other domains that bear out the best passage of a fact."""
    holds = (F.col("label") == verdict.SUPPORTS) & (F.col("prob") >= answers.CARRIES)
    found = answers.corroborating(pairs(spark, sf_dir).select("fact_id", "domain", "label", "prob", "pos"), "fact_id", best(), holds)
    return found.withColumn("rank", F.col("rank").cast("long"))


#: Observations of an answer.
OBSERVED = 30
PLAIN_SQL = r"regexp_replace(trim(strip_accents(replace(lower({}), 'ß', 'ss'))), '\s+', ' ', 'g')"


@query(rf"""WITH given AS (SELECT asked AS item_id, text FROM (SELECT DISTINCT doc_id // {OBSERVED} AS asked FROM documents) JOIN (SELECT row_number() OVER (ORDER BY item_id) - 1 AS n, text, count(*) OVER () AS all_ FROM benchmark) ON n = asked % all_),
said AS (SELECT item_id, unnest(range(0, len(x))) AS n, unnest(x) AS s FROM (SELECT item_id, {split_sql('text', '.!?»')} AS x FROM given)),
parts AS (SELECT *, length(s) BETWEEN 25 AND 300 AS sized, length(s) BETWEEN 25 AND 300 AND NOT ends_with(s, '?') AND NOT starts_with(s, '```') AS factual FROM said),
obs AS (SELECT doc_id // {OBSERVED} AS item_id, doc_id, text FROM documents),
verbatim AS (SELECT DISTINCT item_id, n FROM parts JOIN obs USING (item_id) WHERE factual AND contains({PLAIN_SQL.format('text')}, {PLAIN_SQL.format('s')})),
pieces AS (SELECT item_id, piece FROM (SELECT item_id, doc_id, k, substr(text, k * 400 + 1, 400) AS piece, row_number() OVER (PARTITION BY item_id ORDER BY doc_id, k) AS place FROM (SELECT *, unnest(range(0, ceil(length(text) / 400)::BIGINT)) AS k FROM obs)) WHERE place <= 40),
entailed AS (SELECT item_id, n FROM parts JOIN pieces USING (item_id) WHERE factual GROUP BY ALL HAVING max(len(list_filter({WORDS_SQL.format('s')}, lambda w: contains(lower(piece), w))) / greatest(len({WORDS_SQL.format('s')}), 1)) >= 0.6),
marked AS (SELECT *, factual AND (item_id, n) NOT IN (SELECT (item_id, n) FROM verbatim UNION SELECT (item_id, n) FROM entailed) AS m FROM parts),
joined AS (SELECT item_id, string_agg(s || CASE WHEN m THEN ' {answers.UNVERIFIED}' ELSE '' END, ' ' ORDER BY n) AS t, count(*) FILTER (m) AS n_marked, count(*) FILTER (sized) AS n_sized FROM marked GROUP BY item_id)
SELECT item_id, n_marked, sha256(CASE WHEN item_id NOT IN (SELECT item_id FROM obs) THEN CASE WHEN n_marked > 0 THEN '{answers.UNSOURCED}' || chr(10) ELSE '' END
  WHEN n_marked > n_sized / 2 THEN '{answers.UNSUPPORTED}' || chr(10) ELSE '' END || t) AS digest FROM joined""")
def grounding_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as answers, in turn, to questions of which each saw some documents: sentences that nothing carries are marked."""
    seen = table(spark, sf_dir, "documents").select(F.expr(f"doc_id div {OBSERVED}").alias("item_id"), F.col("doc_id").alias("pos"), "text")
    items = sampling.numbered(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id").select((F.col("n") - 1).alias("turn"), "text")
    total = F.broadcast(table(spark, sf_dir, "benchmark").agg(F.count(F.lit(1)).alias("total")))  # one row
    asked = seen.select("item_id").distinct().join(total).withColumn("turn", F.col("item_id") % F.col("total"))
    found = answers.review(asked.join(items, "turn").select("item_id", "text"), seen, "item_id")
    return found.select("item_id", "n_marked", F.sha2("text", 256).alias("digest"))


FOLD = 1000


@query(f"""WITH c AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS j FROM conversations),
s AS (SELECT *, 24 + length(r) + length(t) AS whole, 14 + length(r) + least(length(t), 120) AS line FROM c),
f AS (SELECT *, line < length(t) AND NOT starts_with(t, '[compactado ') AS cut, sum(whole) OVER (PARTITION BY conv_id) AS total, sum(whole) OVER (PARTITION BY conv_id ORDER BY j) AS gone, count(*) OVER (PARTITION BY conv_id) AS n FROM s),
states AS (SELECT conv_id, 0 AS j, 0 AS step, any_value(n) AS n_turns, any_value(total) AS size FROM f GROUP BY conv_id
  UNION ALL SELECT conv_id, j, 0, n - j + 1, total - gone + 28 + line FROM f WHERE cut UNION ALL SELECT conv_id, j, 1, n - j, total - gone FROM f)
SELECT conv_id, arg_min(n_turns, (j, step)) AS n_turns, arg_min(size, (j, step))::BIGINT AS size FROM states WHERE size <= {FOLD} OR n_turns <= 4 GROUP BY conv_id""")
def folded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations cut to a budget from their oldest turns on."""
    return answers.folded(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", FOLD)
