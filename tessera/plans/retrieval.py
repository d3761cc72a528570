"""Shaping and finding passages: lexical and vector retrieval, gates, deduplication, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import pages, text, vectors
from tessera.operators import cells, lexical, search, trigrams
from tessera.plans.registry import SQL, query
from tessera.plans.verdicts import PAIRS_SQL, WORDS_SQL, pairs, q
from tessera.shared import spread, table
from tessera.sources import registry as source_registry

#: Passages that a query keeps, and the least length of one.
TOP, LEAST = 25, 20
TRIM_SQL = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def split_sql(column: str, marks: str) -> str:
    return rf"string_split(regexp_replace({TRIM_SQL.format(column)}, '([{marks}])\s+', '\1' || chr(1), 'g'), chr(1))"


@query(rf"""
WITH words AS (SELECT item_id, unnest({WORDS_SQL.format('text')}) AS w FROM benchmark),
vocabulary AS (SELECT list(DISTINCT w) AS v FROM words),
hits AS (SELECT doc_id, text, unnest(list_filter(v, lambda w: contains(lower(text), w))) AS w FROM documents, vocabulary WHERE length(text) >= {LEAST}),
scored AS (SELECT item_id, doc_id, any_value(left(text, 120)) AS head, count(*) AS score FROM hits JOIN words USING (w) GROUP BY ALL),
once AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY item_id, head ORDER BY score DESC, doc_id) = 1)
SELECT item_id, doc_id, score, row_number() OVER w AS rank FROM once
WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= {TOP}""")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with most of an item's words, one of each head of 120 characters."""
    return lexical.top_k(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"), TOP, LEAST)


def indexed_lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from posting lists of trigrams, which are asked for the rarest trigram of each word."""
    index = trigrams.build(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), LEAST)
    return trigrams.top_k(spark, index, table(spark, sf_dir, "benchmark"), TOP)


query(SQL["lexical_topk"])(indexed_lexical_topk)


#: Passages of a round, and characters of the best new one that ask on.
PER_ROUND, ASKED = 5, 80


def ranked_sql(name: str, queries: str) -> str:
    """CTEs that rank the passages of `queries` (item_id, text) as `name`."""
    return f"""{name}_words AS (SELECT item_id, unnest({WORDS_SQL.format('text')}) AS w FROM {queries}),
{name}_hits AS (SELECT doc_id, text, unnest(list_filter(v, lambda w: contains(lower(text), w))) AS w FROM documents, (SELECT list(DISTINCT w) AS v FROM {name}_words) WHERE length(text) >= {LEAST}),
{name}_scored AS (SELECT item_id, doc_id, any_value(left(text, 120)) AS head, count(*) AS score FROM {name}_hits JOIN {name}_words USING (w) GROUP BY ALL),
{name}_once AS (SELECT * FROM {name}_scored QUALIFY row_number() OVER (PARTITION BY item_id, head ORDER BY score DESC, doc_id) = 1),
{name} AS (SELECT item_id, doc_id, row_number() OVER w AS rank FROM {name}_once WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= {PER_ROUND})"""


@query(f"""WITH {ranked_sql('one', 'benchmark')},
further AS (SELECT item_id, left(text, {ASKED}) AS text FROM one JOIN documents USING (doc_id) WHERE rank = 1), {ranked_sql('two', 'further')}
SELECT item_id, doc_id, 1 AS round FROM one UNION ALL SELECT item_id, doc_id, 2 FROM two ANTI JOIN one USING (item_id, doc_id)""")
def question_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of two rounds: of an item's words, and of the beginning of the best passage that those find."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def ask(found: DataFrame) -> DataFrame:
        best = found.groupBy("item_id").agg(F.min_by("doc_id", "rank").alias("doc_id"))
        return best.join(docs, "doc_id").select("item_id", F.substring("text", 1, ASKED).alias("text"))

    return search.in_rounds(table(spark, sf_dir, "benchmark"), lambda asked: lexical.top_k(docs, asked, PER_ROUND, LEAST), ask)


@query(f"SELECT doc_id, unnest(range(0, len(s))) AS n, unnest(s) AS sentence FROM (SELECT doc_id, {split_sql('text', '.!?;')} AS s FROM documents)")
def sentences_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("n", "sentence")).withColumn("n", F.col("n").cast("long"))


@query(f"""
WITH s AS (SELECT doc_id, {split_sql('text', '.!?')} AS s FROM documents),
packed AS (SELECT doc_id, list_reduce(s, lambda acc, x: CASE
    WHEN length(string_split(acc, chr(2))[-1]) > 0 AND length(string_split(acc, chr(2))[-1]) + length(x) > 600 THEN acc || chr(2) || x
    WHEN length(string_split(acc, chr(2))[-1]) = 0 THEN acc || x ELSE acc || ' ' || x END) AS p FROM s)
SELECT doc_id, unnest(range(0, len(string_split(p, chr(2))))) AS n, length(unnest(string_split(p, chr(2)))) AS size, sha256(unnest(string_split(p, chr(2)))) AS digest FROM packed WHERE p <> ''""")
def passages_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(text.pack(F.col("text"))).alias("n", "passage"))
    return packed.select("doc_id", F.col("n").cast("long").alias("n"), F.length("passage").cast("long").alias("size"), F.sha2("passage", 256).alias("digest"))


@query(r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') AS domain FROM pages")
def domain_of_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.domain(F.col("url")).alias("domain"))


@query(rf"""SELECT page_id, length(t) AS size, sha256(t) AS digest FROM (SELECT page_id,
  {TRIM_SQL.format(r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')")} AS t FROM pages)""")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", text.strip_markup(F.col("html")).alias("t"))
    return found.select("page_id", F.length("t").cast("long").alias("size"), F.sha2("t", 256).alias("digest"))


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, left(text, 120) ORDER BY doc_id) = 1")
def prefix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first passage of each source and head of 120 characters, by a partial aggregate."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.substring("text", 1, 120).alias("head"))
    return docs.groupBy("source", "head").agg(F.min("doc_id").alias("doc_id")).select("source", "doc_id")


@query("""WITH known AS (SELECT DISTINCT sha256(concat_ws('|', source, text))[1:24] AS h FROM documents JOIN labels USING (doc_id))
SELECT doc_id, sha256(concat_ws('|', source, text))[1:24] AS fingerprint FROM documents WHERE sha256(concat_ws('|', source, text))[1:24] NOT IN (SELECT h FROM known)""")
def fingerprint_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that the store does not hold yet: the labelled documents are the store."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.fingerprint(F.col("source"), F.col("text")).alias("fingerprint"))
    known = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("fingerprint").distinct()
    return docs.join(known, "fingerprint", "left_anti").select("doc_id", "fingerprint")


@query(f"""WITH {PAIRS_SQL} SELECT pos, fact_id, len({WORDS_SQL.format('fact_text')}) < 3 OR
  len(list_filter({WORDS_SQL.format('fact_text')}, lambda w: contains(lower(ev_text), w))) >= 2 AS probative FROM pairs""")
def probative_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("pos", "fact_id", text.probative(F.col("fact_text"), F.col("ev_text")).alias("probative"))


@query(f"SELECT doc_id, len({WORDS_SQL.format('text')}) AS n_words FROM documents")
def content_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.content_words(F.col("text"))).cast("long").alias("n_words"))


QUERY_VECTORS = "vec_id % 100 = 0"
TOPK_SQL = """scores AS (
  SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scores)"""


def nearest(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = vectors.top_k(rows, rows.where(QUERY_VECTORS), k)
    return found.withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {TOPK_SQL} SELECT * FROM ranked WHERE rank <= 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every vector whose id is divisible by 100."""
    return nearest(spark, sf_dir, 10)


@query(f"WITH {TOPK_SQL} SELECT * FROM ranked WHERE rank <= 10")
def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by an index of cells, half of whose rows were appended after it was built."""
    rows = table(spark, sf_dir, "embeddings")
    index = cells.append(cells.build(rows.where("vec_id % 2 = 0")), rows.where("vec_id % 2 = 1"))
    found = cells.top_k(index, rows.where(QUERY_VECTORS), 10)
    return found.withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


#: Passages that the nearest neighbours stand for are judged by meaning: at most so many, from this score on, and as few as these pass unjudged.
JUDGED, MEANING, FEW = 30, 0.80, 3


def by_meaning(found: DataFrame, key: str) -> DataFrame:
    """Rows of found (key, score, rank) that mean something to their query: all of up to FEW, else the close ones of the first JUDGED, else the first FEW."""
    by = Window.partitionBy(key)
    sized = found.withColumn("_n", F.count(F.lit(1)).over(by)).withColumn("_close", F.max((F.col("score") >= MEANING) & (F.col("rank") <= JUDGED)).over(by))
    close = F.when(F.col("_close"), (F.col("score") >= MEANING) & (F.col("rank") <= JUDGED)).otherwise(F.col("rank") <= FEW)
    return sized.where((F.col("_n") <= FEW) | close).drop("_n", "_close")


@query(f"""WITH {TOPK_SQL}, top AS (SELECT * FROM ranked WHERE rank <= query_id // 100 * 7 % 41 + 1),
marked AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, bool_or(score >= 0.25 AND rank <= {JUDGED}) OVER (PARTITION BY query_id) AS any_close FROM top)
SELECT query_id, id, score FROM marked WHERE n <= {FEW} OR CASE WHEN any_close THEN score >= 0.25 AND rank <= {JUDGED} ELSE rank <= {FEW} END""")
def semantic_filter_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a query's passages the close ones; the nearest three if none is close; all where there are no more than three.

    Queries find 1 to 41 passages each. The tables' vectors are further apart than those of texts, so close begins at 0.25 here.
    """
    found = nearest(spark, sf_dir, 41).where(F.expr("rank <= query_id div 100 * 7 % 41 + 1"))
    shifted = found.withColumn("score", F.col("score") + (MEANING - 0.25))
    return by_meaning(shifted, "query_id").select("query_id", "id", F.round(F.col("score") - (MEANING - 0.25), 6).alias("score"))


#: Added to each dimension of the tables' vectors, which point anywhere, so that like those of texts they share a direction.
SHARED = 0.1875
UNIT_SQL = f"""moved AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE + {SHARED}) AS v FROM embeddings),
normed AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM moved),
unit AS (SELECT vec_id, list_transform(v, lambda x: x / n) AS embedding FROM normed)"""


@query(f"""WITH {UNIT_SQL}, {TOPK_SQL.replace('FROM embeddings a, embeddings b', 'FROM unit a, unit b')}
SELECT query_id, id, score FROM ranked WHERE rank <= 20 AND score >= 0.78 AND score < 0.90
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) = 1""")
def cosine_band_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of twenty nearest the first that is near but not too near: material for neutral pairs."""
    moved = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") + SHARED).alias("v"))
    normed = moved.withColumn("n", F.sqrt(vectors.dot(F.col("v"), F.col("v"))))
    unit = normed.select("vec_id", F.transform("v", lambda x: x / F.col("n")).alias("embedding"))
    near = vectors.top_k(unit, unit.where(QUERY_VECTORS), 20).withColumn("score", F.round("score", 6))
    band = near.where((F.col("score") >= 0.78) & (F.col("score") < 0.90))
    return band.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("n = 1").select("query_id", "id", "score")


@query(f"WITH registry AS (SELECT * FROM (VALUES {source_registry.values_sql()}) t(source, universal, categories)), topics AS (SELECT unnest([{', '.join(map(q, [*text.TOPICS, 'general']))}]) AS topic) SELECT topic, source FROM topics, registry WHERE universal OR list_contains(categories, topic)")
def topic_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources a topic is asked at."""
    topics = spark.createDataFrame([(t,) for t in (*text.TOPICS, "general")], "topic string")
    sources = F.broadcast(source_registry.frame(spark))  # the registry's rows
    return topics.join(sources, F.col("universal") | F.expr("array_contains(categories, topic)")).select("topic", "source")


TOPIC_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, {q('(?i)' + p)}) THEN {q(n)}" for n, p in text.TOPICS.items()) + " ELSE 'general' END"


@query(f"SELECT doc_id, {TOPIC_SQL} AS topic FROM documents")
def topic_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.topic(F.col("text")).alias("topic"))


@query(r"SELECT doc_id, sha256(array_to_string(regexp_extract_all(text, '\S+'), ' ')) AS digest FROM documents WHERE regexp_matches(text, '\S')")
def openalex_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts from their inverted indexes: words with their positions, as a source delivers them."""
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    rows = spread(table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\S")).select("doc_id", "text"))
    places = rows.select("doc_id", source_registry.inverted_index(words).alias("index"))
    return places.select("doc_id", F.sha2(source_registry.from_inverted_index(F.col("index")), 256).alias("digest"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 2 = 0 THEN '-' ELSE '' END || year(ts) WHEN 1 THEN strftime(ts, '%Y-%m') ELSE strftime(ts, '%Y-%m-%d') END AS shown FROM events""")
def wikidata_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as precisely as their source claims; years before our era with their sign."""
    time = F.concat(F.when(F.expr("event_id % 2 = 0"), "-").otherwise("+"), F.date_format("ts", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    precision = (F.lit(9) + F.col("event_id") % 3).cast("int")
    return table(spark, sf_dir, "events").select("event_id", source_registry.wikidata_date(time, precision).alias("shown"))


PAGES_SQL = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '')"


@query(f"""WITH langs AS (SELECT DISTINCT {PAGES_SQL} AS domain, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages)
SELECT domain, lang, row_number() OVER w AS rank FROM langs WHERE lang NOT IN ('', 'es')
WINDOW w AS (PARTITION BY domain ORDER BY coalesce(list_position(['en', 'fr', 'de', 'pt', 'it'], lang), 99), lang) QUALIFY row_number() OVER w <= 5""")
def language_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages that a site is read in besides the query's own: preferred ones first, then by name."""
    pages = table(spark, sf_dir, "pages").select(text.domain(F.col("url")).alias("domain"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))
    langs = pages.where("lang <> '' AND lang <> 'es'").distinct()
    preferred = F.array_position(F.lit(["en", "fr", "de", "pt", "it"]), F.col("lang"))
    order = Window.partitionBy("domain").orderBy(F.when(preferred == 0, 99).otherwise(preferred), "lang")
    return langs.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 5")


def shown_sql(column: str) -> str:
    """A page without the parts that hold no text, for RE2."""
    for pattern in pages.DROPPED:
        column = f"regexp_replace({column}, {q(pattern)}, ' ', 'g')"
    return column


@query(f"""WITH t AS (SELECT page_id, regexp_extract_all({shown_sql("coalesce(html, '')")}, '{pages.TOKEN}') AS ts FROM pages),
each AS (SELECT page_id, unnest(ts) AS token, unnest(range(1, len(ts) + 1)) AS i FROM t),
worth AS (SELECT *, CASE WHEN starts_with(token, '<') THEN {pages.TAG} ELSE {pages.WORD} END AS v FROM each),
sums AS (SELECT *, sum(v) OVER w AS upto, sum(v) OVER w - v AS before FROM worth WINDOW w AS (PARTITION BY page_id ORDER BY i)),
least AS (SELECT *, min(before) OVER (PARTITION BY page_id ORDER BY i) AS low FROM sums),
begun AS (SELECT *, max(CASE WHEN before = low THEN i END) OVER (PARTITION BY page_id ORDER BY i) AS first FROM least),
best AS (SELECT page_id, first, i AS last FROM begun WHERE upto > low QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY upto - low DESC, i) = 1),
kept AS (SELECT e.page_id, count(*) AS n_words, string_agg(token, ' ' ORDER BY i) AS text FROM each e JOIN best b ON e.page_id = b.page_id AND i BETWEEN first AND last WHERE NOT starts_with(token, '<') GROUP BY e.page_id)
SELECT page_id, coalesce(n_words, 0) AS n_words, sha256(coalesce(text, '')) AS digest FROM t LEFT JOIN kept USING (page_id)""")
def page_main_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each page the stretch of words that few tags break."""
    words = pages.main_words(F.col("html"))
    rows = spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", words.alias("words"))
    return rows.select("page_id", F.size("words").cast("long").alias("n_words"), F.sha2(F.array_join("words", " "), 256).alias("digest"))
