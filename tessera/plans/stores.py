"""Persistent stores as append-only logs with views: sessions, threads, caches, queues, audit."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import logs
from tessera.plans.registry import query
from tessera.shared import shared_path, table
from tessera.sources import snapshots


@query("""SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, max(turn) AS last_turn, left(arg_min(text, turn), 80) AS title FROM conversations GROUP BY conv_id""")
def conversations_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's size, last turn and title: the beginning of its first turn."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("role").alias("roles"), F.max("turn").alias("last_turn"), F.substring(F.min_by("text", "turn"), 1, 80).alias("title"))


@query("SELECT conv_id % 7 AS workspace, count(*) AS turns, count(DISTINCT conv_id) AS sessions, max(turn) AS last_turn FROM conversations GROUP BY 1")
def workspace_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy((F.col("conv_id") % 7).alias("workspace")).agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("conv_id").alias("sessions"), F.max("turn").alias("last_turn"))


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations QUALIFY age <= 20")
def recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty turns of each conversation."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.row_number().over(order).cast("long").alias("age")).where("age <= 20")


@query("SELECT conv_id, turn, role, text FROM conversations ORDER BY turn DESC, conv_id LIMIT 20")
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty latest turns of all."""
    return table(spark, sf_dir, "conversations").orderBy(F.desc("turn"), "conv_id").limit(20).select("conv_id", "turn", "role", "text")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS since FROM events WHERE event_type <> 'error' GROUP BY user_id")
def latest_record_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each key; failed ones do not count."""
    rows = table(spark, sf_dir, "events").where("event_type <> 'error'")
    return logs.latest(rows, ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_type").alias("state"), F.col("ts").alias("since"))


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS g FROM events)
SELECT user_id, min(ts) AS since, count(*) AS failures FROM e WHERE bad GROUP BY user_id, g HAVING count(*) >= 3""")
def failure_cooldown_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three failures or more in a row: where a source must rest."""
    rows = table(spark, sf_dir, "events").withColumn("bad", F.col("event_type") == "error")
    return logs.runs(rows, "user_id", ["ts", "event_id"], "bad").where("bad AND n >= 3").select("user_id", F.col("since"), F.col("n").alias("failures"))


@query("SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY ALL HAVING max(ts) > (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached keys that are not older than seven days at the last write."""
    rows = table(spark, sf_dir, "events")
    now = F.broadcast(rows.agg(F.max("ts").alias("now")))  # one row
    return rows.groupBy("user_id", "event_type").agg(F.max("ts").alias("ts")).join(now, F.expr("ts > now - INTERVAL 7 DAYS")).drop("now")


@query("""WITH s AS (SELECT event_id % 500 AS task, CASE event_id // 500 % 4 WHEN 0 THEN 'pendiente' WHEN 1 THEN 'en_curso' WHEN 2 THEN 'hecha' ELSE 'fallida' END AS state, event_id FROM events),
last AS (SELECT task, arg_max(state, event_id) AS state FROM s GROUP BY task)
SELECT state, count(*) AS n, min(task) AS oldest FROM last GROUP BY state""")
def queue_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The work queue from its event log: how many tasks are in each state, and the oldest."""
    names = F.lit(["pendiente", "en_curso", "hecha", "fallida"])
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("task"), names[F.expr("event_id div 500 % 4").cast("int")].alias("state"), "event_id")
    return logs.latest(rows, ["task"], ["event_id"]).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min("task").alias("oldest"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props)) AS n_keys FROM events")
def variant_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.json_object_keys("props")
    parsed = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(parsed, keys[0]).alias("first_value"), F.size(keys).cast("long").alias("n_keys"))


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly tumbling windows; streaming.events runs the same over a stream."""
    rows = table(spark, sf_dir, "events")
    return rows.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


RULES = [(0, "denegar", "error"), (1, "preguntar", "purchase"), (2, "permitir", "view"), (2, "permitir", "click")]


@query("""WITH rules AS (SELECT * FROM (VALUES (0, 'denegar', 'error'), (1, 'preguntar', 'purchase'), (2, 'permitir', 'view'), (2, 'permitir', 'click')) t(priority, decision, kind)),
parts AS (SELECT user_id, event_type, coalesce(min(priority), 1) AS p FROM events LEFT JOIN rules ON kind = event_type GROUP BY ALL)
SELECT user_id, CASE min(p) WHEN 0 THEN 'denegar' WHEN 1 THEN 'preguntar' ELSE 'permitir' END AS decision FROM parts GROUP BY user_id""")
def permission_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deny before ask before allow; a compound command is allowed only if all its parts are."""
    rules = F.broadcast(spark.createDataFrame(RULES, "priority int, decision string, event_type string"))  # the rules
    parts = table(spark, sf_dir, "events").select("user_id", "event_type").distinct().join(rules, "event_type", "left")
    worst = F.min(F.coalesce("priority", F.lit(1)))
    return parts.groupBy("user_id").agg(F.lit(["denegar", "preguntar", "permitir"])[worst].alias("decision"))


@query("""WITH one AS (SELECT doc_id, quality FROM labels WHERE doc_id % 5 <> 0),
two AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS quality FROM labels WHERE (doc_id % 5 <> 0 OR doc_id % 3 = 0) AND doc_id % 7 <> 0)
SELECT 1 AS version, * FROM one UNION ALL SELECT 3, * FROM two UNION ALL SELECT 4, * FROM two UNION ALL SELECT 5, doc_id, toxic FROM labels""")
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of labels by version: written, changed and with keys deleted, compacted, written over; a write that was not committed, and one that came too late, do not count."""
    labels = table(spark, sf_dir, "labels")
    store = snapshots.Store(spark, shared_path(spark, "store"), "doc_id")
    versions = [store.overwrite(labels.where("doc_id % 5 <> 0").select("doc_id", "quality"))]
    store.upsert(labels.where("doc_id % 3 = 0").select("doc_id", (1 - F.col("quality")).alias("quality")))
    versions.append(store.upsert(labels.where("doc_id % 7 = 0").select("doc_id", F.lit(None).cast(labels.schema["quality"].dataType).alias("quality"))))
    store.stage(labels.select("doc_id", F.lit(9).alias("quality")), "aborted")
    versions.append(store.compact())
    versions.append(store.overwrite(labels.select("doc_id", F.col("toxic").alias("quality"))))
    try:
        store.commit(2, snapshots.SNAPSHOT, f"{store.folder}/data/aborted")
    except AnalysisException:
        pass  # version 2 is there
    return reduce(DataFrame.unionByName, [store.read(v).select(F.lit(v).cast("int").alias("version"), "doc_id", "quality") for v in versions])
