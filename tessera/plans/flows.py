"""Files, sinks, connectors and streams over the test tables: what is written comes back as the rules say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import models, text
from tessera.operators import logs
from tessera.plans.registry import query
from tessera.plans.retrieval import TOPIC_SQL
from tessera.plans.verdicts import sql_list
from tessera.shared import shared_path, table
from tessera.sources import archives, connector, knowledge_store, payloads, sinks
from tessera.streaming import events, state

EDGES_SQL = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(f"""WITH p AS (SELECT doc_id, {EDGES_SQL.format('unnest(string_split(text, chr(10)))')} AS passage FROM documents)
SELECT 'https://www.store' || doc_id % 7 || '.example/' || doc_id AS url, 'store' || doc_id % 7 || '.example' AS domain, count(*) AS passages, sum(length(passage))::BIGINT AS chars FROM p WHERE passage <> '' GROUP BY doc_id""")
def knowledge_store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of knowledge stores, files of concatenated objects: the passages that a scan finds."""
    url = F.format_string("https://www.store%d.example/%d", F.col("doc_id") % 7, F.col("doc_id"))
    pages = table(spark, sf_dir, "documents").select(F.to_json(F.struct(url.alias("url"), F.split("text", "\n").alias("url2text"))))
    folder = shared_path(spark, "store")
    pages.write.option("maxRecordsPerFile", 10000).text(folder)  # a file is one record of the scan
    return knowledge_store.passages(spark, folder).groupBy("url", "domain").agg(F.count(F.lit(1)).alias("passages"), F.sum(F.length("passage")).alias("chars"))


@query("SELECT doc_id // 100 || '.zip' AS archive, lang || '/' || doc_id || '.txt' AS name, octet_length(encode(text)) AS size, sha256(text) AS digest FROM documents")
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred documents to an archive, beside a member of another kind, and the members that are texts."""
    rows = table(spark, sf_dir, "documents").withColumn("archive", F.expr("string(doc_id div 100)"))
    texts = rows.select("archive", F.concat("lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    lists = rows.select("archive").distinct().select("archive", F.lit("index.json").alias("name"), F.encode(F.lit("{}"), "UTF-8").alias("content"))
    folder = shared_path(spark, "archives")
    archives.write(texts.unionByName(lists), folder)
    return archives.members(spark, folder, "*.txt").select(F.element_at(F.split("archive", "/"), -1).alias("archive"), "name", "size", F.sha2("content", 256).alias("digest"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS attempt, lang AS prediction FROM documents")
def resumed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as appended lines: a second attempt does what the first one left or failed at; the last good record of a key counts."""
    schema, path = "doc_id long, attempt long, prediction string", shared_path(spark, "results")
    todo = table(spark, sf_dir, "documents").select("doc_id", "lang")
    good = lambda: spark.read.schema(schema).json(path).where("prediction <> 'ERROR'")
    failed = F.when(F.col("doc_id") % 5 == 0, "ERROR").otherwise(F.col("lang"))
    sinks.append_json(todo.where("doc_id % 10 <> 0").select("doc_id", F.lit(1).cast("long").alias("attempt"), failed.alias("prediction")), path)
    rest = logs.absent(todo, good(), ["doc_id"])
    sinks.append_json(rest.select("doc_id", F.lit(2).cast("long").alias("attempt"), F.col("lang").alias("prediction")), path)
    return logs.latest(good(), ["doc_id"], ["attempt"])


@query("""WITH made AS (SELECT doc_id, 'v1' AS model, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS attempt FROM documents UNION ALL SELECT doc_id, 'v2', 2 FROM documents)
SELECT model, attempt, count(*) AS pairs FROM made GROUP BY ALL""")
def cached_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged pairs kept by model: what a model has judged it does not judge again, another model does."""
    path, keys = shared_path(spark, "pairs"), ["model", "doc_id"]
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    made = lambda model, attempt, of: of.select("doc_id", F.lit(attempt).cast("long").alias("attempt"), F.lit(model).alias("model"))
    sinks.append_absent(made("v1", 1, rows.where("lang = 'en'")), path, keys, ["model"])
    sinks.append_absent(made("v1", 2, rows).unionByName(made("v2", 2, rows)), path, keys, ["model"])
    return spark.read.parquet(path).groupBy("model", "attempt").agg(F.count(F.lit(1)).alias("pairs"))


LABELS = [*text.TOPICS, "general", "weather"]


@query(f"""WITH t AS (SELECT doc_id, {TOPIC_SQL} AS plain, {sql_list(LABELS)}[doc_id % {len(LABELS)} + 1] AS label, doc_id % 10 / 10.0 AS score FROM documents)
SELECT doc_id, CASE WHEN plain = 'general' AND list_contains({sql_list([*text.TOPICS])}, label) AND score >= 0.5 THEN label ELSE plain END AS topic FROM t""")
def refined_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics by patterns, and by a classifier's labels (here dealt in turn) where no pattern tells."""
    label = F.array(*map(F.lit, LABELS))[(F.col("doc_id") % len(LABELS)).cast("int")]
    return table(spark, sf_dir, "documents").select("doc_id", models.refined_topic(F.col("text"), label, F.col("doc_id") % 10 / 10.0).alias("topic"))


def asked(query: str, lang: str) -> list[dict]:
    """A connector's answer: two posts, the second too short to count."""
    return [{"data": {"title": f"On {query}", "selftext": "What is known of it and of what stands beside it.", "permalink": f"/r/{lang}/{query}"}}, {"data": {"title": "Short", "permalink": "/"}}]


@query("SELECT 'reddit' AS source, 'On item ' || item_id || '. What is known of it and of what stands beside it' AS text, 'https://www.reddit.com/r/en/item ' || item_id AS url, 'reddit.com' AS domain, 'en' AS lang FROM benchmark")
def connector_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as queries to a source behind a connector: its records as evidence."""
    queries = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("item "), "item_id").alias("query"), F.lit("en").alias("lang"))
    found = connector.records(queries, "item_id", "reddit", asked)
    return payloads.render(found, {"reddit": payloads.RECORDS["reddit"]}).select("source", "text", "url", "domain", "lang")


def run_stream(rows: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """All that a stream of files gives now, appended to path batch by batch: its rows with the batch's number."""
    write = lambda batch, n: batch.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={n}")
    stream = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-progress").foreachBatch(write)
    stream.trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.schema(T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType())])).option("recursiveFileLookup", "true").parquet(path)


DECISIONS = ["permitir", "denegar", "preguntar"]


@query(f"SELECT date_trunc('hour', ts) AS hour, event_type AS herramienta, {sql_list(DECISIONS)}[event_id % 3 + 1] AS decision, count(*) AS n FROM events GROUP BY ALL")
def audit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of the audit log, read as a stream and kept: decisions by tool and hour."""
    decision = F.array(*map(F.lit, DECISIONS))[(F.col("event_id") % 3).cast("int")]
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("herramienta"), F.col("props").alias("argumento"), decision.alias("decision"))
    folder = shared_path(spark, "audit")
    sinks.append_json(rows, folder)
    sinks.append_json(rows.limit(1).select(F.lit("no record").alias("other")), folder)
    kept = run_stream(events.audit(spark, folder), shared_path(spark, "audit-kept"))
    return events.decisions(kept).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("""WITH last AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations QUALIFY age <= 20)
SELECT conv_id, count(*) AS turns, min(turn) AS first_turn, max(turn) AS last_turn, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS digest FROM last GROUP BY conv_id""")
def rolling_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a stream of two files, turn by turn: the latest state of each."""
    folder = shared_path(spark, "turns")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    for k, part in enumerate(("turn % 2 = 0", "turn % 2 = 1")):
        rows.where(part).write.parquet(f"{folder}/{k}")
    # Two batches at any size: a table of many splits has been written in as many files, each batch of which costs a round of all states.
    half = max(len(spark.read.parquet(f"{folder}/{k}").inputFiles()) for k in range(2))
    stream = spark.readStream.schema("conv_id long, turn long, text string").option("maxFilesPerTrigger", half).parquet(f"{folder}/*")
    kept = run_stream(state.recent(stream), shared_path(spark, "turns-kept"), "update")
    last = logs.latest(kept, ["conv_id"], ["batch"])
    return last.select("conv_id", F.size("turns").cast("long").alias("turns"), F.array_min("turns").alias("first_turn"), F.array_max("turns").alias("last_turn"), F.sha2(F.array_join("texts", "\n"), 256).alias("digest"))


@query("""WITH w AS (SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL)
SELECT * FROM w WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows of a stream, once the watermark has passed their end."""
    folder = shared_path(spark, "events")
    table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").coalesce(1).write.parquet(folder)
    kept = run_stream(events.hourly(events.read(spark, folder, "ts timestamp, event_type string, value double")), shared_path(spark, "windows"))
    return kept.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def shuffled_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through a buffer of a thousand rows: another order, the same rows."""
    return events.shuffled(table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest")), 1000, 7)
