"""Training pairs: hard negatives within a page, trios from templates, balancing, mixing, chunk pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import logs, mixing, sampling
from tessera.plans.registry import query
from tessera.plans.retrieval import split_sql
from tessera.plans.verdicts import WORDS_SQL, q
from tessera.shared import materialize, spread, table

#: Neighbouring documents of one source stand for a page, as the tables name none.
PAGE = 400
#: Rows ahead that each round of the search looks at.
AHEAD = (8, 32, 128, 512, 2048, 8192)
# How a text tells a date.
DATE = r"\b(?:(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2}|(?:19|20)\d{2})\b"


def claims(spark: SparkSession, sf_dir: str, claim: str = "", evidence: str = "") -> DataFrame:
    """page, doc_id, claim (the first sentence) and evidence (the text), each with SQL for a tail of its own."""
    docs = spread(table(spark, sf_dir, "documents").select("source", "doc_id", "text")).select(F.concat_ws("/", "source", F.expr(f"doc_id div {PAGE}")).alias("page"), "doc_id", F.get(text.sentences(F.col("text")), F.lit(0)).alias("claim"), F.col("text").alias("evidence"))
    for column, tail in (("claim", claim), ("evidence", evidence)):
        docs = docs.withColumn(column, F.concat(column, F.expr(tail))) if tail else docs
    return docs


def claims_sql(claim: str = "''", evidence: str = "''") -> str:
    return f"""told AS (SELECT source || '/' || (doc_id // {PAGE}) AS page, doc_id, {split_sql('text', '.!?;')}[1] || {claim} AS claim, text || {evidence} AS evidence FROM documents),
claims AS (SELECT *, {WORDS_SQL.format('claim')} AS cw, {WORDS_SQL.format('evidence')} AS ew FROM told)"""


MATCH_SQL = "len(list_intersect(a.cw, b.cw)) < 0.5 * len(a.cw) AND len(list_intersect(a.cw, b.ew)) >= 2"
FIRST_SQL = """found AS (SELECT a.page, a.claim, a.doc_id AS claim_id, min(b.doc_id) AS evidence_id FROM claims a JOIN claims b ON a.page = b.page AND a.doc_id < b.doc_id WHERE {0} GROUP BY ALL)
SELECT claim_id, evidence_id, 'NOT ENOUGH INFO' AS label FROM found QUALIFY row_number() OVER (PARTITION BY page, claim ORDER BY claim_id) = 1"""


def first_matches(rows: DataFrame, dated: bool = False) -> DataFrame:
    """For each claim text of a page the first later evidence on other matters that shares two of its words; with dated, of other dates.

    Most claims find theirs a few rows on. Each round joins the claims that are left with the next rows of
    their page by an equal place, ever more of them, so that no page is joined with itself; a claim
    that nothing can match (fewer than two words, or no date) is left out from the start.
    """
    none = F.lit([]).cast("array<string>")
    dates = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(DATE), F.lit(0))) if dated else none
    # Words as 64-bit hashes: sets of numbers meet faster than sets of texts, and are less to move.
    words = lambda c: F.transform(text.content_words(c), lambda w: F.xxhash64(w))
    known = rows.select("page", "doc_id", "claim", words(F.col("claim")).alias("cw"), words(F.col("evidence")).alias("ew"), dates(F.col("claim")).alias("cd"), dates(F.col("evidence")).alias("ed"))
    known = known.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("doc_id")))
    known = materialize(known, "claims")
    longest = known.agg(F.max("place")).first()[0] or 0
    left = known.where((F.size("cw") >= 2) & (F.size("cd") > 0 if dated else F.lit(True))).select("page", "claim", F.col("doc_id").alias("claim_id"), "cw", "cd", "place")
    later = known.select("page", F.col("place").alias("at"), F.col("doc_id").alias("evidence_id"), F.col("cw").alias("other"), "ew", "ed")
    common = lambda a, b: F.size(F.array_intersect(a, b))
    fits = (common("cw", "other") < 0.5 * F.size("cw")) & (common("cw", "ew") >= 2)
    fits = fits & (F.size("ed") > 0) & ~F.arrays_overlap("cd", "ed") if dated else fits
    parts, start = [], 1
    steps = iter([*AHEAD, *range(2 * AHEAD[-1], longest + AHEAD[-1], AHEAD[-1])])
    while start < longest:
        end = min(next(steps), longest)
        met = left.withColumn("at", F.explode(F.sequence(F.col("place") + start, F.col("place") + end))).join(later, ["page", "at"]).where(fits)
        found = materialize(met.groupBy("page", "claim", "claim_id").agg(F.min("evidence_id").alias("evidence_id")), "matches")
        parts.append(found)
        left = materialize(left.join(found, ["page", "claim_id"], "left_anti"), "unmatched")
        start = end + 1
        if left.isEmpty():
            break
    nothing = left.select("page", "claim", "claim_id", F.col("claim_id").alias("evidence_id")).where("false")
    first = F.min(F.struct("claim_id", "evidence_id")).alias("m")
    return reduce(DataFrame.unionByName, parts, nothing).groupBy("page", "claim").agg(first).select("m.*", F.lit("NOT ENOUGH INFO").alias("label"))


@query(f"WITH {claims_sql()}, {FIRST_SQL.format(MATCH_SQL)}")
def hard_negatives_selfjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_matches(claims(spark, sf_dir))


CLAIM_TAIL, EVIDENCE_TAIL = "', in ' || (1900 + doc_id * 7 % 13)", "' On May ' || (1 + doc_id % 5) || ', in ' || (1900 + doc_id * 5 % 13)"


def dates_sql(column: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({column}), '{DATE}'))"


DATED_SQL = f"{MATCH_SQL} AND len({dates_sql('a.claim')}) > 0 AND len({dates_sql('b.evidence')}) > 0 AND NOT list_has_any({dates_sql('a.claim')}, {dates_sql('b.evidence')})"


@query(f"WITH {claims_sql(CLAIM_TAIL, EVIDENCE_TAIL)}, {FIRST_SQL.format(DATED_SQL)}")
def date_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives whose claim and evidence tell dates, but none in common. The tables' texts have hardly any, so each gets some."""
    return first_matches(claims(spark, sf_dir, CLAIM_TAIL, EVIDENCE_TAIL), dated=True)


@query("""WITH l AS (SELECT doc_id, quality, md5(doc_id::VARCHAR || '45') AS h FROM labels),
n AS (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM l GROUP BY quality))
SELECT doc_id, quality FROM l, n QUALIFY row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) <= m""")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rows of each class as the smallest class has, in a seeded hash order."""
    return sampling.balanced(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id", 45)


@query("""WITH l AS (SELECT doc_id, quality, toxic, md5(doc_id::VARCHAR || '7') AS h FROM labels)
SELECT doc_id, quality, toxic FROM l QUALIFY row_number() OVER (PARTITION BY quality, toxic ORDER BY h, doc_id) <= 333""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """333 rows of each class, in a seeded hash order."""
    return sampling.per_stratum(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), ["quality", "toxic"], "doc_id", 7, 333)


@query("""SELECT item_id AS id, 'benchmark' AS origin, unnest([1, 2, 3]) AS copy FROM benchmark UNION ALL SELECT doc_id, 'labels', 1 FROM labels""")
def replicated_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small set three times and a large one once."""
    small = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("origin"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("copy"))
    large = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("labels").alias("origin"), F.lit(1).alias("copy"))
    return logs.mixed([small, large])


CAPS = {"labels": 120, "documents": 60}


@query(f"""WITH s AS (SELECT 'benchmark' AS origin, item_id AS id, 'item' AS label, NULL AS cap, 3 AS copies FROM benchmark
  UNION ALL SELECT 'labels', doc_id, quality::VARCHAR, {CAPS['labels']}, 1 FROM labels UNION ALL SELECT 'documents', doc_id, lang, {CAPS['documents']}, 1 FROM documents),
h AS (SELECT *, md5(origin || '|' || id || '|17') AS h FROM s),
kept AS (SELECT * FROM h QUALIFY cap IS NULL OR row_number() OVER (PARTITION BY origin, label ORDER BY h, id) <= cap),
copied AS (SELECT *, unnest(range(1, copies + 1))::INT AS copy FROM kept)
SELECT origin, id, label, copy, row_number() OVER (ORDER BY md5(h || '|' || copy)) AS place FROM copied""")
def capped_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sets in one order by hash: a small one three times, two with a cap for each label, and a fourth that is not there."""
    path = lambda name: f"{sf_dir}/{name}.parquet"
    return mixing.mix(spark, [
        mixing.Source("benchmark", path("benchmark"), "item_id", "'item'", copies=3), mixing.Source("labels", path("labels"), "doc_id", "quality", CAPS["labels"]),
        mixing.Source("documents", path("documents"), "doc_id", "lang", CAPS["documents"]), mixing.Source("absent", path("absent"), "id", "label", 5),
    ], 17)


# A denial and its confirmation.
DENIES, CONFIRMS = "The ministry issued a statement refuting rumors that ", "The ministry issued a statement confirming that "


@query(f"""WITH r AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) AS i, count(*) OVER () AS n FROM benchmark),
p AS (SELECT a.item_id, lower(left(a.text, 1)) || rtrim(substr(a.text, 2), '.') AS s, lower(left(b.text, 1)) || rtrim(substr(b.text, 2), '.') AS o FROM r a JOIN r b ON b.i = a.n + 1 - a.i)
SELECT item_id, unnest(['REFUTES', 'SUPPORTS', 'NOT ENOUGH INFO']) AS label, sha256(unnest([{q(DENIES)} || s || '.', {q(CONFIRMS)} || s || '.', {q(DENIES)} || o || '.'])) AS evidence FROM p""")
def denial_trios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim denied, confirmed, and beside the denial of the claim that mirrors it in order."""
    items = table(spark, sf_dir, "benchmark")
    forward = sampling.numbered(items, "item_id").select("item_id", "text", "n")
    total = F.broadcast(items.agg(F.count(F.lit(1)).alias("total")))  # one row
    mirrored = forward.join(total).select((F.col("total") + 1 - F.col("n")).alias("n"), F.col("text").alias("other"))
    clause = lambda c: F.concat(F.lower(F.substring(c, 1, 1)), F.regexp_replace(F.substr(F.col(c), F.lit(2)), r"\.+$", ""))
    says = lambda how, c: F.concat(F.lit(how), clause(c), F.lit("."))
    trio = F.array(*(F.struct(F.lit(l).alias("label"), F.sha2(e, 256).alias("evidence")) for l, e in (("REFUTES", says(DENIES, "text")), ("SUPPORTS", says(CONFIRMS, "text")), ("NOT ENOUGH INFO", says(DENIES, "other")))))
    return forward.join(mirrored, "n").select("item_id", F.explode(trio).alias("t")).select("item_id", "t.label", "t.evidence")


ENTITIES, TIMES = ["Nigeria", "Peru", "Norway", "Japan"], ["in 1960", "in 1990", "currently"]


@query(f"""WITH g AS (SELECT i, {ENTITIES}[i % 4 + 1] AS e, 10 + i % 90 AS n1, 10 + (i * 7 + 13) % 90 AS n2, {TIMES}[i % 3 + 1] AS t1, {TIMES}[(i + 1) % 3 + 1] AS t2 FROM (SELECT c_custkey AS i FROM customer))
SELECT i AS id, e || ' had ' || n1 || ' million people ' || t1 || '.' AS claim, unnest(['SUPPORTS', 'REFUTES', 'NOT ENOUGH INFO']) AS label,
 unnest([e || ' counted ' || n1 || ' million ' || t1 || '.', e || ' counted ' || n2 || ' million ' || t1 || '.', e || ' counted ' || n2 || ' million ' || t2 || '.']) AS evidence
FROM g WHERE abs(n2 - n1) > greatest(1, n1 // 4)""")
def temporal_trios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities at times: the same, another at the same time, another at another time."""
    i = F.col("id")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).select("id", F.lit(ENTITIES)[(i % 4).cast("int")].alias("e"), (10 + i % 90).alias("n1"), (10 + (i * 7 + 13) % 90).alias("n2"), F.lit(TIMES)[(i % 3).cast("int")].alias("t1"), F.lit(TIMES)[((i + 1) % 3).cast("int")].alias("t2"))
    rows = rows.where(F.abs(F.col("n2") - F.col("n1")) > F.greatest(F.lit(1), F.expr("n1 div 4")))
    says = lambda verb, n, tail, t: F.concat(F.col("e"), F.lit(f" {verb} "), F.col(n), F.lit(f" {tail} "), F.col(t), F.lit("."))
    trio = F.array(*(F.struct(F.lit(l).alias("label"), says("counted", n, "million", t).alias("evidence")) for l, n, t in (("SUPPORTS", "n1", "t1"), ("REFUTES", "n2", "t1"), ("NOT ENOUGH INFO", "n2", "t2"))))
    return rows.select("id", says("had", "n1", "million people", "t1").alias("claim"), F.explode(trio).alias("t")).select("id", "claim", "t.label", "t.evidence")


@query(f"""WITH s AS (SELECT doc_id, n, s, lead(s) OVER (PARTITION BY doc_id ORDER BY n) AS next FROM (SELECT doc_id, unnest(range(0, len(x))) AS n, unnest(x) AS s FROM (SELECT doc_id, {split_sql('text', '.!?')} AS x FROM documents)))
SELECT doc_id, n, length(s) AS size, length(next) AS next_size FROM s WHERE next IS NOT NULL AND length(s) >= 25 AND length(next) / length(s) BETWEEN 0.85 AND 1.15""")
def chunk_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring sentences of like length: claim and next chunk of a long document."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"), ".!?")).alias("n", "s"))
    rows = rows.withColumn("next", F.lead("s").over(Window.partitionBy("doc_id").orderBy("n"))).select("doc_id", F.col("n").cast("long").alias("n"), F.length("s").cast("long").alias("size"), F.length("next").cast("long").alias("next_size"))
    return rows.where("next_size IS NOT NULL AND size >= 25 AND next_size / size BETWEEN 0.85 AND 1.15")


@query(f"""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\pL\\pN_]+')) AS w FROM documents),
n AS (SELECT doc_id, w, lead(doc_id) OVER o AS other, lead(w) OVER o AS v FROM w JOIN (SELECT doc_id, source FROM documents) USING (doc_id) WINDOW o AS (PARTITION BY source, doc_id // {PAGE} ORDER BY doc_id))
SELECT doc_id, other, round(len(list_intersect(w, v)) / greatest(len(list_distinct(list_concat(w, v))), 1), 6) AS jaccard FROM n WHERE other IS NOT NULL""")
def edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words each text shares with the next one of its page: a small edit has nearly all."""
    order = Window.partitionBy("source", F.expr(f"doc_id div {PAGE}")).orderBy("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.lead("doc_id").over(order).alias("other"), F.lead("text").over(order).alias("next")).where("other IS NOT NULL")
    return rows.select("doc_id", "other", F.round(text.jaccard(F.col("text"), F.col("next")), 6).alias("jaccard"))


@query(f"""WITH s AS (SELECT doc_id, quality, toxic, {split_sql('text', '.!?')} AS s FROM documents JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN toxic = 1 THEN 'NOT ENOUGH INFO' WHEN quality = 1 THEN 'SUPPORTS' ELSE 'REFUTES' END AS label, length(left(array_to_string(s[1:5], ' '), 2000)) AS size FROM s WHERE length(array_to_string(s[1:5], ' ')) >= 30""")
def evidence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence joined from sentences, long enough and cut to size."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    joined = F.array_join(F.slice(text.sentences(F.col("text"), ".!?"), 1, 5), " ")
    label = F.when(F.col("toxic") == 1, "NOT ENOUGH INFO").when(F.col("quality") == 1, "SUPPORTS").otherwise("REFUTES")
    return rows.select("doc_id", label.alias("label"), joined.alias("e")).where("length(e) >= 30").select("doc_id", "label", F.least(F.length("e"), F.lit(2000)).cast("long").alias("size"))
