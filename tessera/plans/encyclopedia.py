"""Articles of each encyclopedia, of other languages and of the press, with documents and pages as articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.plans.payloads import ITEMS, asked
from tessera.plans.registry import query
from tessera.plans.retrieval import TRIM_SQL, split_sql
from tessera.plans.verdicts import WORDS_SQL
from tessera.shared import table
from tessera.sources import articles, payloads


def packed_sql(source: str, keys: str, column: str) -> str:
    """Passages of about 600 characters, with their places, of a relation's texts."""
    return f"""(SELECT {keys}, unnest(range(0, len(string_split(p, chr(2))))) AS place, unnest(string_split(p, chr(2))) AS passage FROM (
  SELECT {keys}, list_reduce({split_sql(column, '.!?')}, lambda acc, x: CASE
    WHEN length(string_split(acc, chr(2))[-1]) > 0 AND length(string_split(acc, chr(2))[-1]) + length(x) > 600 THEN acc || chr(2) || x
    WHEN length(string_split(acc, chr(2))[-1]) = 0 THEN acc || x ELSE acc || ' ' || x END) AS p FROM {source}) WHERE p <> '')"""


CLEAN_SQL = TRIM_SQL.format(r"regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')")
SCORE_SQL = f"len(list_filter({WORDS_SQL.format('query')}, lambda w: contains(lower(passage), w)))"


def kind_sql(kind: articles.Kind) -> str:
    source = f"(SELECT item_id, article, query, left({CLEAN_SQL.format('text')}, {kind.head}) AS text FROM a WHERE length({CLEAN_SQL.format('text')}) >= {kind.least})" if kind.rendered else "a"
    order = "score DESC, article, turn" if kind.again else "article, turn"
    return f"""SELECT item_id, '{kind.name}' AS source, rank, article, place, score, sha256(passage) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY {order}) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id, article ORDER BY score DESC, place) AS turn FROM (SELECT *, {SCORE_SQL} AS score FROM {packed_sql(source, 'item_id, article, query', 'text')})) WHERE turn <= {kind.each}) WHERE rank <= {kind.most}"""


@query(f"""WITH a AS (SELECT doc_id % {ITEMS} AS item_id, b.text AS query, d.text, row_number() OVER (PARTITION BY doc_id % {ITEMS} ORDER BY doc_id) AS article
  FROM documents d JOIN benchmark b ON b.item_id = doc_id % {ITEMS} QUALIFY article <= {articles.ARTICLES}) {' UNION ALL '.join(map(kind_sql, articles.KINDS))}""")
def source_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each encyclopedia gives for a question: two articles, their best passages, ranked again or one after the other."""
    # Only ids are ranked; the texts of two articles a question join afterwards.
    ids = asked(spark, sf_dir).select("item_id", "doc_id")
    first = ids.withColumn("article", F.row_number().over(Window.partitionBy("item_id").orderBy("doc_id"))).where(F.col("article") <= articles.ARTICLES)
    rows = asked(spark, sf_dir).join(first.select("doc_id", "article"), "doc_id")
    found = articles.passages(rows, "item_id")
    return found.select("item_id", "source", *(F.col(c).cast("long").alias(c) for c in ("rank", "article", "place", "score")), F.sha2("passage", 256).alias("digest"))


@query(f"""WITH links AS (SELECT doc_id % {ITEMS} AS item_id, lang, text FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id % {ITEMS}, lang ORDER BY doc_id) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(list_position({articles.PREFERRED}, lang), 99), lang) AS rank FROM links WHERE lang <> 'es')
SELECT item_id, lang, rank, place, sha256(passage) AS digest FROM {packed_sql('(SELECT * FROM ranked WHERE rank <= 5)', 'item_id, lang, rank', 'text')} WHERE place < 2""")
def multilingual_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first passages of an article in its other languages; the first document of each language stands for it."""
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % ITEMS).alias("item_id"), "lang", "doc_id", "text")
    first = docs.groupBy("item_id", "lang").agg(F.min("doc_id").alias("doc_id"))
    found = articles.in_other_languages(docs.join(first.select("doc_id"), "doc_id", "left_semi"), "item_id")
    return found.select("item_id", "lang", F.col("rank").cast("long").alias("rank"), F.col("place").cast("long").alias("place"), F.sha2("passage", 256).alias("digest"))


@query(f"""WITH hits AS (SELECT page_id % {ITEMS} AS item_id, url, html, row_number() OVER (PARTITION BY page_id % {ITEMS} ORDER BY page_id) AS hit FROM pages WHERE page_id % 7 <> 0 QUALIFY hit <= 2),
texts AS (SELECT item_id, url, b.text AS query, {CLEAN_SQL.format('html')} AS text FROM hits JOIN benchmark b USING (item_id)),
scored AS (SELECT *, {SCORE_SQL} AS score FROM {packed_sql('texts', 'item_id, url, query', 'text')}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, url ORDER BY score DESC, place) AS rank FROM scored)
SELECT item_id, url, place, score, sha256(passage) AS digest FROM ranked WHERE rank <= 3 AND length(passage) >= 40""")
def press_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A press index's answer of six entries, some without an address, and the passages of the two pages that are read."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html", (F.col("page_id") % ITEMS).alias("item_id"))
    ranked = pages.select("item_id", "page_id", F.when(F.col("page_id") % 7 != 0, F.col("url")).alias("url")).withColumn("k", F.row_number().over(Window.partitionBy("item_id").orderBy("page_id"))).where("k <= 6")
    answer = ranked.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("k", "url"))).alias("all"))  # six entries
    payload = F.to_json(F.struct(F.transform("all", lambda a: F.struct(a["url"].alias("url"), F.lit("title").alias("title"))).alias("articles")))
    chosen = answer.select("item_id", F.explode(articles.listed(payload)).alias("a")).select("item_id", F.col("a.url").alias("url"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    read = pages.select("item_id", "url", "html").join(chosen, ["item_id", "url"]).join(items, "item_id")
    best = F.explode(F.slice(payloads.scored_passages(F.col("query"), text.strip_markup(F.col("html"))), 1, 3)).alias("x")
    found = read.select("item_id", "url", best).where(F.length("x.passage") >= 40)
    return found.select("item_id", "url", F.col("x.place").cast("long").alias("place"), (-F.col("x.worse")).cast("long").alias("score"), F.sha2("x.passage", 256).alias("digest"))
