"""An agent's queue, permissions, memory and answers over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text, wording
from tessera.operators import grouping, permissions, queue, verdict
from tessera.plans.registry import query
from tessera.plans.verdicts import FACT_SQL, ROLLED_SQL, fact_table, pairs, q, sql_list
from tessera.shared import materialize, table

STATES = [queue.PENDING, queue.RUNNING, queue.DONE, queue.FAILED]
LOG_SQL = f"""log AS (SELECT event_id % 500 AS task, event_type AS kind, {sql_list(STATES)}[event_id % 11 % 4 + 1] AS state, event_id AS stamp FROM events),
last AS (SELECT task, arg_max(kind, stamp) AS kind, arg_max(state, stamp) AS state FROM log GROUP BY task)"""


def task_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of 500 tasks."""
    return table(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("task"), F.col("event_type").alias("kind"), F.array(*map(F.lit, STATES))[F.expr("event_id % 11 % 4").cast("int")].alias("state"), F.col("event_id").alias("at"))


@query(f"""WITH {LOG_SQL}, back AS (SELECT task, kind, state AS before, CASE state WHEN 'en_curso' THEN 'pendiente' ELSE state END AS state FROM last),
took AS (SELECT task FROM back WHERE state = 'pendiente' ORDER BY task LIMIT 40),
ended AS (SELECT task, task % 3 <> 0 AS ok FROM took WHERE task % 2 = 0)
SELECT task, before, CASE WHEN ok THEN 'hecha' WHEN NOT ok THEN 'fallida' WHEN took.task IS NOT NULL THEN 'en_curso' ELSE state END AS state FROM back LEFT JOIN took USING (task) LEFT JOIN ended USING (task)""")
def queue_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after a restart (orphans are pending again), forty tasks taken, oldest first, and half of these ended well or badly."""
    log = task_log(spark, sf_dir)
    before = queue.current(log).select("task", F.col("state").alias("before"))
    log = log.unionByName(queue.requeued(log, 1 << 40))
    took = materialize(queue.taken(log, 40, (1 << 40) + 1), "taken")
    log = log.unionByName(took)
    results = took.where("task % 2 = 0").select("task", (F.col("task") % 3 != 0).alias("ok"))
    log = log.unionByName(queue.finished(log, results, (1 << 40) + 2))
    return before.join(queue.current(log).select("task", "state"), "task")


@query(f"""WITH {LOG_SQL} SELECT kind, count(*) FILTER (state = 'en_curso') AS orphans, count(*) FILTER (state = 'pendiente') AS pending FROM last GROUP BY kind""")
def queue_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By kind: tasks that a dead worker left, and tasks that wait."""
    last = queue.current(task_log(spark, sf_dir))
    return last.groupBy("kind").agg(F.count_if(F.col("state") == queue.RUNNING).alias("orphans"), F.count_if(F.col("state") == queue.PENDING).alias("pending"))


ROOT = "/work"
RULES = [permissions.rule(permissions.ALLOW, f"Ejecutar({c})") for c in permissions.DEFAULT_ALLOWED] + [
    permissions.rule(permissions.DENY, "Ejecutar(npm *)"), permissions.rule(permissions.ASK, "Ejecutar(git diff HEAD)"), permissions.rule(permissions.DENY, "Leer(//etc/**)"),
    permissions.rule(permissions.ASK, "Escribir(secret/**)"), permissions.rule(permissions.ALLOW, "Escribir(docs/*.t?t)"),
]
SAID = [
    "git status", "git  log  -5 && ls", "ls -la; rm  -rf /", "echo 'a && b' | ls", "git diff HEAD || ls", "echo \"open && ls", "ls", "npm   install pkg & ls", "git log", "git logs",
    "/work/docs/a.txt", "/work/docs/b/a.txt", "/etc/ssh/key", "/work/secret/x/y", "/work/src/a.py", "/workshop/a.py", "/work",
    "ls " + "a" * 5000, "ls " + "'x;y' " * 1000 + "&& npm i", "/work/docs/a.txt\n", "/etc/ssh/key\n", "git log\n",
]
TOOLS, MODES = ["Ejecutar", "Leer", "Escribir", "Buscar", "Borrar"], ["plan", "preguntar", "aceptar_ediciones", "lote"]


@query(f"""WITH r AS (SELECT event_id, {sql_list(SAID)}[event_id % {len(SAID)} + 1] AS a, {sql_list(MODES)}[event_id // 5 % 4 + 1] AS m, {sql_list(TOOLS)}[event_id // 20 % 5 + 1] AS t FROM events),
p AS (SELECT *, CASE WHEN a = 'echo "open && ls' THEN [a] ELSE list_filter(list_transform(string_split_regex(replace(replace(a, 'a && b', 'a _ b'), 'x;y', 'x_y'), '&&|\\|\\||[;|&]'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') END AS parts, starts_with(a, '/work/') OR a = '/work' AS inside FROM r),
d AS (SELECT *, CASE WHEN t = 'Leer' THEN 'permitir' WHEN m IN ('plan', 'lote') THEN 'denegar' WHEN m = 'aceptar_ediciones' AND t = 'Escribir' AND inside THEN 'permitir' ELSE 'preguntar' END AS fallback FROM p)
SELECT event_id, CASE WHEN t = 'Buscar' THEN CASE WHEN m = 'plan' THEN 'denegar' ELSE 'permitir' END WHEN t = 'Borrar' THEN 'denegar'
  WHEN t = 'Ejecutar' THEN CASE WHEN list_contains(parts, 'rm -rf /') THEN 'denegar' WHEN len(list_filter(parts, lambda x: x = 'npm' OR starts_with(x, 'npm '))) > 0 THEN 'denegar' WHEN list_contains(parts, 'git diff HEAD') THEN 'preguntar'
    WHEN len(parts) > 0 AND len(list_filter(parts, lambda x: x IN ('git status', 'ls', 'git diff', 'git log') OR starts_with(x, 'ls ') OR starts_with(x, 'git diff ') OR starts_with(x, 'git log '))) = len(parts) THEN 'permitir' ELSE fallback END
  WHEN m = 'lote' AND t = 'Escribir' AND NOT inside THEN 'denegar' WHEN t = 'Leer' AND regexp_matches(a, '^/etc/[^\\n]*$') THEN 'denegar'
  WHEN t = 'Escribir' AND regexp_matches(a, '^/work/secret/[^\\n]*$') THEN 'preguntar' WHEN t = 'Escribir' AND regexp_matches(a, '^/work/docs/[^/]*\\.t[^/]t$') THEN 'permitir' ELSE fallback END AS decision FROM d""")
def permission_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for tools in every mode: quotes keep separators, patterns of commands and paths, deny before ask before allow."""
    pick = lambda values, at: F.array(*map(F.lit, values))[F.expr(at).cast("int")]
    rows = table(spark, sf_dir, "events").select("event_id", pick(SAID, f"event_id % {len(SAID)}").alias("a"), pick(MODES, "event_id div 5 % 4").alias("m"), pick(TOOLS, "event_id div 20 % 5").alias("t"))
    return rows.select("event_id", permissions.decision(F.col("t"), F.col("a"), F.col("m"), RULES, ROOT).alias("decision"))


LANGS = ["es", "en", "fr", "de", "pt", "it", "xx"]


def phrase_sql(name: str) -> str:
    return "CASE lang " + " ".join(f"WHEN {q(code)} THEN {q(p[name])}" for code, p in wording.PHRASES.items()) + f" ELSE {q(wording.PHRASES['en'][name])} END"


@query(f"""WITH {FACT_SQL}, {ROLLED_SQL.format('')},
deciding AS (SELECT claim_id, min(fact_id) AS fact_id FROM decided JOIN rolled USING (claim_id, verdict) GROUP BY claim_id),
best AS (SELECT fact_id, label, arg_min(struct_pack(domain := domain, text := ev_text, url := 'https://' || domain || '/' || pos), (-prob, pos)) AS v FROM voices GROUP BY ALL),
counts AS (SELECT claim_id, count(pos) AS n FROM facts LEFT JOIN voices USING (fact_id, claim_id) GROUP BY claim_id),
told AS (SELECT claim_id, verdict, {sql_list(LANGS)}[claim_id % {len(LANGS)} + 1] AS lang, round_even(round(confidence, 6) * 100, 0)::INT || '%' AS sure, n, p.v AS pro, c.v AS con
  FROM rolled JOIN deciding USING (claim_id) JOIN counts USING (claim_id) LEFT JOIN best p ON p.fact_id = deciding.fact_id AND p.label = 'sustenta' LEFT JOIN best c ON c.fact_id = deciding.fact_id AND c.label = 'refuta'),
said AS (SELECT *, {phrase_sql('confidence')} || ' ' || sure AS conf FROM told)
SELECT claim_id, CASE verdict
  WHEN 'refutado' THEN {phrase_sql('no')} || coalesce(': ' || con.domain || ' ' || {phrase_sql('states')} || ' «' || trim(left(con.text, 150)) || '…» (' || conf || '; ' || con.url || ')', ' (' || conf || ').')
  WHEN 'sustentado' THEN {phrase_sql('yes')} || coalesce(': ' || pro.domain || ' ' || {phrase_sql('states')} || ' «' || trim(left(pro.text, 150)) || '…» (' || conf || '; ' || pro.url || ')', ' (' || conf || ').')
  WHEN 'evidencia_contradictoria' THEN {phrase_sql('both')} || pro.domain || ' ' || {phrase_sql('says')} || ' «' || trim(left(pro.text, 110)) || '…»' || {phrase_sql('but')} || con.domain || ' ' || {phrase_sql('says')} || ' «' || trim(left(con.text, 110)) || '…» (' || conf || ').'
  ELSE replace({phrase_sql('few')}, '{{n}}', n::VARCHAR) END AS answer FROM said""")
def concise_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim's answer of one breath, in one of six languages (English for others), built from its verdict and its deciding fact's strongest voice."""
    spoken = materialize(verdict.voices(verdict.weighted(pairs(spark, sf_dir))), "voices")
    facts = materialize(verdict.decide(fact_table(spark, sf_dir).select("fact_id", "claim_id"), spoken).select("fact_id", "claim_id", "verdict", "confidence"), "decided")
    rolled = verdict.roll_up(facts)
    deciding = facts.join(rolled.select("claim_id", "verdict"), ["claim_id", "verdict"]).groupBy("claim_id").agg(F.min("fact_id").alias("fact_id"))
    entry = F.struct("domain", F.col("ev_text").alias("text"), F.concat(F.lit("https://"), "domain", F.lit("/"), F.col("pos").cast("string")).alias("url"))
    side = lambda label: F.min_by(F.when(F.col("label") == label, entry), F.when(F.col("label") == label, F.struct(-F.col("prob"), F.col("pos"))))
    best = spoken.groupBy("fact_id").agg(side(verdict.SUPPORTS).alias("pro"), side(verdict.REFUTES).alias("con"))
    counts = facts.join(spoken.groupBy("fact_id").agg(F.count(F.lit(1)).alias("v")), "fact_id", "left").groupBy("claim_id").agg(F.sum(F.coalesce("v", F.lit(0))).alias("voices"))
    rows = rolled.join(deciding, "claim_id").join(counts, "claim_id").join(best, "fact_id", "left")
    lang = F.array(*map(F.lit, LANGS))[(F.col("claim_id") % len(LANGS)).cast("int")]
    return rows.select("claim_id", wording.concise(lang, F.col("verdict"), F.round("confidence", 6), F.col("voices"), F.col("pro"), F.col("con")).alias("answer"))


REPLIES = ["<think>is false</think> It is supported by two sources.", "The claim is FALSE.", "Es cierto, según dos fuentes.", "<think>never closed", "", "Nothing is decided."]


@query(f"""WITH {FACT_SQL}, r AS (SELECT fact_id, verdict, trim(regexp_replace({sql_list(REPLIES)}[fact_id % {len(REPLIES)} + 1], '(?s)<think>.*?(</think>|$)', '', 'g')) AS reply FROM decided)
SELECT fact_id, CASE WHEN reply = '' OR (verdict = 'sustentado' AND regexp_matches(lower(reply), 'refutada|refutado|es falsa|es falso|refuted|is false'))
  OR (verdict = 'refutado' AND regexp_matches(lower(reply), 'sustentada|sustentado|es cierta|es cierto|es verdadera|supported|is true')) THEN NULL ELSE reply END AS synthesis FROM r""")
def safe_syntheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's texts on verdicts: thoughts go, and what tells the opposite of the verdict is dropped."""
    facts = verdict.decide(fact_table(spark, sf_dir).select("fact_id", "claim_id"), verdict.voices(verdict.weighted(pairs(spark, sf_dir))))
    reply = F.array(*map(F.lit, REPLIES))[(F.col("fact_id") % len(REPLIES)).cast("int")]
    return facts.select("fact_id", wording.safe(reply, F.col("verdict")).alias("synthesis"))


@query("SELECT doc_id, length(e) AS size, sha256(e) AS digest FROM (SELECT doc_id, CASE WHEN length(text) <= 1500 THEN text ELSE left(text, 750) || ' … ' || right(text, 750) END AS e FROM documents)")
def elided_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without their middle."""
    rows = table(spark, sf_dir, "documents").select("doc_id", text.elide(F.col("text")).alias("e"))
    return rows.select("doc_id", F.length("e").cast("long").alias("size"), F.sha2("e", 256).alias("digest"))


NORMAL_SQL = r"regexp_replace(trim(strip_accents(replace(lower({}), 'ß', 'ss'))), '\s+', ' ', 'g')"


@query(f"""WITH v AS (SELECT conv_id, turn, {NORMAL_SQL.format('text')} AS k FROM conversations), asked AS (SELECT DISTINCT k FROM v WHERE turn = 0),
met AS (SELECT k, conv_id, turn FROM v JOIN asked USING (k))
SELECT sha256(k) AS claim, conv_id, turn, row_number() OVER w AS age FROM met WINDOW w AS (PARTITION BY k ORDER BY turn DESC, conv_id DESC) QUALIFY row_number() OVER w <= 3""")
def memory_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three latest records of each first turn's text, whatever its case, accents and spacing."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.plain_key("text").alias("k"))
    met = rows.join(rows.where("turn = 0").select("k").distinct(), "k")
    order = Window.partitionBy("k").orderBy(F.desc("turn"), F.desc("conv_id"))
    return met.withColumn("age", F.row_number().over(order).cast("long")).where("age <= 3").select(F.sha2("k", 256).alias("claim"), "conv_id", "turn", "age")


STOP_SQL = sql_list(text.STOPWORDS)


def terms_sql(column: str, most: int = 4) -> str:
    every = rf"regexp_extract_all({column}, '[\pL\pN_]{{4,}}')"
    low = f"list_transform({every}, lambda z: lower(z))"
    return f"list_filter({every}, lambda x, i: list_position({low}, lower(x)) = i AND NOT list_contains({STOP_SQL}, lower(x)))[1:{most}]"


@query(f"SELECT conv_id, turn, array_to_string({terms_sql('text')}, ' ') AS terms FROM conversations")
def key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four words that name a turn's topic."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(grouping.key_terms(F.col("text")), " ").alias("terms"))


@query(f"""WITH t AS (SELECT conv_id % 3 AS workspace, conv_id, turn, text, row_number() OVER (PARTITION BY conv_id % 3 ORDER BY conv_id DESC, turn DESC) AS age FROM conversations)
SELECT workspace, conv_id, turn, age, array_to_string({terms_sql('text')}, ' ') AS terms FROM t WHERE age BETWEEN 21 AND 220""")
def compacted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each workspace the 200 turns before the last 20, as their terms alone."""
    order = Window.partitionBy("workspace").orderBy(F.desc("conv_id"), F.desc("turn"))
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 3).alias("workspace"), "conv_id", "turn", "text").withColumn("age", F.row_number().over(order).cast("long")).where("age <= 220")
    return rows.where("age >= 21").select("workspace", "conv_id", "turn", "age", F.array_join(grouping.key_terms(F.col("text")), " ").alias("terms"))
