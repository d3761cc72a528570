"""Sources' records as evidence, passages of pages and queries for the web, on cases and on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import answers
from tessera.plans.registry import query
from tessera.plans.retrieval import split_sql
from tessera.plans.verdicts import WORDS_SQL, q
from tessera.shared import table
from tessera.sources import payloads

HEAD_SQL, BODY_SQL = r"regexp_replace(left(text, 50), '\s+', ' ', 'g')", r"regexp_replace(left(text, 900), '\s+', ' ', 'g')"


@query(f"""WITH d AS (SELECT doc_id, source, lang, {HEAD_SQL} AS h, {BODY_SQL} AS b FROM documents),
e AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'web' WHEN 1 THEN 'hackernews' WHEN 2 THEN 'reddit' WHEN 3 THEN 'nvd' WHEN 4 THEN 'openlibrary' ELSE 'crossref' END AS source,
  CASE doc_id % 6 WHEN 0 THEN b WHEN 1 THEN trim(h || '. ' || b, '. ') WHEN 2 THEN trim(h || '. ' || b, '. ') WHEN 3 THEN 'CVE-' || doc_id || ': ' || b
    WHEN 4 THEN 'Registro bibliográfico: «' || h || '», de ' || source || ', ' || lang || CASE WHEN doc_id % 4 = 0 THEN ', publicado por primera vez en ' || (1900 + doc_id % 100) ELSE '' END || '.' ELSE trim(b) END AS text,
  CASE doc_id % 6 WHEN 0 THEN 'https://www.' || source || '.org/' || doc_id WHEN 1 THEN 'https://news.ycombinator.com/item?id=' || doc_id WHEN 2 THEN 'https://www.reddit.com/r/' || doc_id WHEN 3 THEN 'https://nvd.nist.gov/vuln/detail/CVE-' || doc_id
    WHEN 4 THEN 'https://openlibrary.org/w/' || doc_id ELSE 'https://doi.org/10.1/' || doc_id END AS url,
  CASE doc_id % 6 WHEN 0 THEN source || '.org' WHEN 1 THEN 'news.ycombinator.com' WHEN 2 THEN 'reddit.com' WHEN 3 THEN 'nvd.nist.gov' WHEN 4 THEN 'openlibrary.org' ELSE 'crossref.org' END AS domain, b FROM d),
whole AS (SELECT doc_id, source, 0 AS pos, CASE WHEN source IN ('hackernews', 'reddit', 'nvd') THEN left(text, 1000) ELSE text END AS text, url, domain FROM e WHERE source <> 'crossref' AND length(text) >= CASE source WHEN 'hackernews' THEN 30 ELSE 40 END AND (source <> 'nvd' OR length(b) >= 40)),
parts AS (SELECT doc_id, list_reduce({split_sql('text', '.!?')}, lambda acc, x: CASE
    WHEN length(string_split(acc, chr(2))[-1]) > 0 AND length(string_split(acc, chr(2))[-1]) + length(x) > 600 THEN acc || chr(2) || x
    WHEN length(string_split(acc, chr(2))[-1]) = 0 THEN acc || x ELSE acc || ' ' || x END) AS p, url, domain FROM e WHERE source = 'crossref' AND length(text) >= 40),
passages AS (SELECT doc_id, 'crossref' AS source, unnest(range(0, len(string_split(p, chr(2))))) AS pos, unnest(string_split(p, chr(2))) AS text, url, domain FROM parts)
SELECT doc_id, source, pos, sha256(text) AS digest, url, domain FROM (SELECT * FROM whole UNION ALL SELECT * FROM passages WHERE pos < 2)""")
def source_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records of six sources, in the form in which these deliver them, as evidence."""
    c, at = F.col, F.col("doc_id").cast("string")
    even = lambda size: F.regexp_replace(F.substring("text", 1, size), r"\s+", " ")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", even(50).alias("h"), even(900).alias("b"))
    url = lambda head: F.concat(F.lit(head), at)
    record = lambda **fields: F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))
    forms = {
        "web": record(href=F.concat(F.lit("https://www."), "source", F.lit(".org/"), at), body=c("b")),
        "hackernews": record(objectID=at, title=c("h"), story_text=c("b")),
        "reddit": record(data=F.struct(c("h").alias("title"), c("b").alias("selftext"), url("/r/").alias("permalink"))),
        "nvd": record(cve=F.struct(url("CVE-").alias("id"), F.array(F.struct(F.lit("es").alias("lang"), F.lit("no").alias("value")), F.struct(F.lit("en").alias("lang"), c("b").alias("value"))).alias("descriptions"))),
        "openlibrary": record(title=c("h"), author_name=F.array("source", "lang"), first_publish_year=F.when(F.expr("doc_id % 4 = 0"), F.expr("1900 + doc_id % 100")).otherwise(0), key=url("/w/")),
        "crossref": record(title=F.array("h"), abstract=F.concat(F.lit("<jats:p>"), "b", F.lit("</jats:p>")), DOI=url("10.1/")),
    }
    names = F.array(*map(F.lit, forms))[(c("doc_id") % 6).cast("int")]
    payload = F.array(*forms.values())[(c("doc_id") % 6).cast("int")]
    made = rows.select(names.alias("source"), c("doc_id").alias("n"), F.lit("").alias("query"), F.lit("").alias("lang"), payload.alias("payload"))
    found = payloads.render(made, {k: payloads.RECORDS[k] for k in forms})
    return found.select(F.col("n").alias("doc_id"), "source", F.col("pos").cast("long").alias("pos"), F.sha2("text", 256).alias("digest"), "url", "domain")


@query("""WITH born AS (SELECT o_custkey, strftime(min_by(o_orderdate, o_orderkey), '%Y-%m-%d') AS d, min(o_orderkey) % 3 AS p FROM orders GROUP BY o_custkey),
told AS (SELECT 'Q' || c_custkey AS qid, c_name AS label, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS d, list_filter([
    CASE p WHEN 0 THEN c_name || ' inception: ' || left(born.d, 4) || '.' WHEN 1 THEN c_name || ' inception: ' || left(born.d, 7) || '.' WHEN 2 THEN c_name || ' inception: ' || born.d || '.' END,
    CASE WHEN n_regionkey <> 2 THEN c_name || ' country of citizenship: ' || n_name || '.' END, CASE WHEN c_acctbal >= 1 THEN c_name || ' population: ' || floor(c_acctbal)::BIGINT || '.' END], lambda x: x IS NOT NULL) AS says
  FROM customer LEFT JOIN born ON c_custkey = o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)
SELECT qid, CASE WHEN d IS NULL THEN '' ELSE label || ' (' || d || '). ' END || array_to_string(says, ' ') AS text FROM told WHERE len(says) > 0""")
def wikidata_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities' first statements as sentences, with the names of what they point to, where those are known.

    Customers stand for entities: the dates of their orders, of differing precision, their nation and their balance for statements.
    """
    c, none = F.col, F.lit(None).cast("string")
    qid = lambda key: F.concat(F.lit("Q"), key.cast("string"))
    customers = table(spark, sf_dir, "customer")
    entities = customers.select(qid(c("c_custkey")).alias("qid"), c("c_name").alias("label"), F.when(c("c_custkey") % 4 > 0, c("c_mktsegment")).alias("description"))
    of = lambda rows, key, code, place, time, precision, amount, target: rows.select(
        qid(key).alias("qid"), F.lit(code).alias("property"), place.cast("long").alias("place"), time.alias("time"), precision.cast("int").alias("precision"), amount.alias("amount"), target.alias("target"))
    time = F.concat(F.lit("+"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    statements = of(table(spark, sf_dir, "orders"), c("o_custkey"), "P571", c("o_orderkey"), time, 9 + c("o_orderkey") % 3, none, none)
    statements = statements.unionByName(of(customers, c("c_custkey"), "P27", F.lit(0), none, F.lit(None), none, F.concat(F.lit("N"), c("c_nationkey").cast("string"))))
    statements = statements.unionByName(of(customers.where("c_acctbal >= 1"), c("c_custkey"), "P1082", F.lit(0), none, F.lit(None), F.concat(F.lit("+"), F.floor("c_acctbal").cast("string")), none))
    labels = table(spark, sf_dir, "nation").where("n_regionkey <> 2").select(F.concat(F.lit("N"), c("n_nationkey").cast("string")).alias("qid"), c("n_name").alias("label"))
    return payloads.entity_facts(entities, statements, labels)


#: Documents are dealt to as many items.
ITEMS = 20
PASSAGES_SQL = f"""s AS (SELECT doc_id, {split_sql('text', '.!?')} AS s FROM documents),
packed AS (SELECT doc_id, list_reduce(s, lambda acc, x: CASE
    WHEN length(string_split(acc, chr(2))[-1]) > 0 AND length(string_split(acc, chr(2))[-1]) + length(x) > 600 THEN acc || chr(2) || x
    WHEN length(string_split(acc, chr(2))[-1]) = 0 THEN acc || x ELSE acc || ' ' || x END) AS p FROM s),
cut AS (SELECT doc_id, unnest(range(0, len(string_split(p, chr(2))))) AS place, unnest(string_split(p, chr(2))) AS passage FROM packed WHERE p <> ''),
met AS (SELECT doc_id, place, passage, len(list_filter({WORDS_SQL.format('b.text')}, lambda w: contains(lower(passage), w))) AS score FROM cut JOIN benchmark b ON b.item_id = doc_id % {ITEMS})"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text", (F.col("doc_id") % ITEMS).alias("item_id")).join(items, "item_id")


@query(f"""WITH {PASSAGES_SQL} SELECT doc_id, place, score, length(passage) AS size FROM
(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS rank FROM met) WHERE rank <= 3 AND length(passage) >= 40""")
def page_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three passages of each page that share most words with its query, without short ones."""
    best = asked(spark, sf_dir).select("doc_id", F.explode(F.slice(payloads.scored_passages(F.col("query"), F.col("text")), 1, 3)).alias("x"))
    return best.select("doc_id", F.col("x.place").cast("long").alias("place"), (-F.col("x.worse")).cast("long").alias("score"), F.length("x.passage").cast("long").alias("size")).where("size >= 40")


@query(f"""WITH {PASSAGES_SQL}, hits AS (SELECT doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS hit FROM documents),
full_text AS (SELECT doc_id, 'page' AS kind, place, length(passage) AS size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS rank FROM met) JOIN (SELECT doc_id FROM hits WHERE hit <= 3) USING (doc_id) WHERE rank <= 3 AND length(passage) >= 40)
SELECT * FROM full_text UNION ALL SELECT doc_id, 'snippet', 0, length(left(text, 200)) FROM hits WHERE hit > 3 AND hit <= 8 AND length(left(text, 200)) >= 40""")
def web_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of eight hits of each source three as passages of the page, the others as snippets; only ids are ranked, texts join afterwards."""
    ids = table(spark, sf_dir, "documents").select("source", "doc_id")
    # Spark keeps eight rows of a source in each task before the shuffle.
    first = ids.withColumn("hit", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("hit <= 8").select("doc_id", "hit")
    hits = asked(spark, sf_dir).join(first, "doc_id").select("doc_id", "hit", "query", "text")
    best = F.transform(F.slice(payloads.scored_passages(F.col("query"), F.col("text")), 1, 3), lambda x: F.struct(F.lit("page").alias("kind"), x["place"].cast("long").alias("place"), F.length(x["passage"]).cast("long").alias("size")))
    snippet = F.array(F.struct(F.lit("snippet").alias("kind"), F.lit(0).cast("long").alias("place"), F.length(F.substring("text", 1, 200)).cast("long").alias("size")))
    return hits.select("doc_id", F.explode(F.when(F.col("hit") <= 3, best).otherwise(snippet)).alias("x")).select("doc_id", "x.*").where("size >= 40")


@query("""SELECT item_id, left(text, 40) || ' fact check' AS checked, left(text, 40) || ' (site:mathworld.wolfram.com OR site:encyclopediaofmath.org OR site:proofwiki.org OR site:oeis.org OR site:dlmf.nist.gov)' AS documented FROM benchmark""")
def aimed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that look for fact checks and for official documentation."""
    head = F.substring("text", 1, 40)
    return table(spark, sf_dir, "benchmark").select("item_id", payloads.fact_check_query(head, F.lit("en")).alias("checked"), payloads.documentation_query(head, F.lit("matematicas")).alias("documented"))


CODE_SQL = q(text.CODE_LINE)


@query(f"""WITH t AS (SELECT doc_id // 4 AS asked, doc_id, CASE WHEN doc_id // 4 % 3 = 0 THEN left(text, 24) WHEN doc_id // 4 % 3 = 1 THEN 'return ' || text ELSE text END AS text FROM documents),
said AS (SELECT asked, doc_id, unnest(list_filter({split_sql('text', '.!?»')}, lambda x: length(x) BETWEEN 25 AND 300 AND NOT ends_with(x, '?') AND NOT regexp_matches(x, {CODE_SQL}))) AS s FROM t),
heads AS (SELECT asked, doc_id, {r"regexp_replace(left(text, 220), '^\s+|\s+$', '', 'g')"} AS s FROM t WHERE asked NOT IN (SELECT asked FROM said) AND trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY asked ORDER BY doc_id) <= 3)
SELECT asked, doc_id, length(s) AS size, sha256(s) AS digest FROM (SELECT * FROM said UNION ALL SELECT * FROM heads)""")
def answer_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that can answer a question, of four passages each; the heads of three where no passage has one. Some passages are short, some begin with code."""
    turn = F.expr("doc_id div 4 % 3")
    shaped = F.when(turn == 0, F.substring("text", 1, 24)).when(turn == 1, F.concat(F.lit("return "), "text")).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "documents").select(F.expr("doc_id div 4").alias("asked"), "doc_id", shaped.alias("text"))
    return answers.answer_sentences(rows, "asked", "doc_id").select("asked", "doc_id", F.length("s").cast("long").alias("size"), F.sha2("s", 256).alias("digest"))
