"""Rules over models' replies, turns and questions that are made from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import arithmetic, replies, text
from tessera.operators import grouping
from tessera.plans.agents import terms_sql
from tessera.plans.dialogue import ELLIPTIC_SQL, LEADS, QUESTION_SQL, TRIM, TURNS_SQL, edge, edges
from tessera.plans.registry import query
from tessera.plans.retrieval import TRIM_SQL, split_sql
from tessera.plans.verdicts import q, sql_list
from tessera.shared import table


def picked(values: list[str], at: str) -> Column:
    return F.array(*map(F.lit, values))[F.expr(at).cast("int")]


#: What stands around a document's first words in a model's reply; {} is their place.
FORMS = [
    "<think>REFUTED? {}</think>It is SUPPORTED.", "SUPPORTED at first, {} but then REFUTED", "Not enough evidence; misleading {}", "complete {}", "<think>never closed SUPPORTED {}",
    "1. **Who said {}?** When was it said?\n- Who said {}?\nnot a question", 'search: "{}"\nsearch "{}"\nshort',
]
SAID_SQL = f"replace(CASE doc_id % {len(FORMS)} " + " ".join(f"WHEN {n} THEN {q(f)}" for n, f in enumerate(FORMS)) + " END, '{}', left(text, 30))"
SHOWN_SQL = r"regexp_replace(reply, '(?s)<think>.*?(</think>|$)', '', 'g')"


def bare_sql(x: str) -> str:
    inner = TRIM_SQL.format(x)
    return TRIM_SQL.format(rf"regexp_replace({inner}, '^[*_`\"]+|[*_`\"]+$', '', 'g')")


def ordered_sql(values: str) -> str:
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


@query(rf"""WITH r AS (SELECT doc_id, {SAID_SQL} AS reply FROM documents), s AS (SELECT doc_id, {SHOWN_SQL} AS t FROM r),
l AS (SELECT *, list_filter(list_transform(string_split(t, chr(10)), lambda x: {bare_sql(r"regexp_replace(x, '^\s*(?:[-*•]|\d+[.)])\s*', '')")}), lambda x: x <> '') AS lines FROM s),
p AS (SELECT *, list_filter(list_transform(flatten(list_transform(lines, lambda x: string_split(regexp_replace(x, '\?\s+', '?' || chr(1), 'g'), chr(1)))), lambda x: {bare_sql('x')}), lambda x: ends_with(x, '?') AND length(x) > 10) AS asked,
  list_filter(list_transform(lines, lambda x: {bare_sql(r"regexp_replace(x, '^search\s*:?\s*', '', 'i')")}), lambda x: length(x) > 10) AS sought FROM l),
v AS (SELECT doc_id, unnest({sql_list(list(replies.VERDICTS))}) AS label, upper(t) AS u FROM s),
w AS (SELECT doc_id, arg_max(label, length(u) - length(string_split(u, label)[-1])) AS label FROM v WHERE contains(u, label) GROUP BY doc_id)
SELECT doc_id, CASE WHEN contains(upper(t), 'MISLEADING') THEN 'enganosa' WHEN contains(upper(t), 'COMPLETE') THEN 'completa' END AS omission,
  CASE label {' '.join(f"WHEN {q(a)} THEN {q(b)}" for a, b in replies.VERDICTS.items())} END AS verdict,
  array_to_string(CASE WHEN len(asked) > 0 THEN {ordered_sql('asked')} ELSE {ordered_sql('sought')} END[1:3], '|') AS questions FROM p LEFT JOIN w USING (doc_id)""")
def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What models' replies say: an omission, the verdict named last, questions to look up."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.replace(picked(FORMS, f"doc_id % {len(FORMS)}"), F.lit("{}"), F.substring("text", 1, 30)).alias("reply"))
    reply = F.col("reply")
    return rows.select("doc_id", replies.omission(reply).alias("omission"), replies.verdict(reply).alias("verdict"), F.array_join(replies.questions(reply, 3), "|").alias("questions"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'look ' || n_chars WHEN 1 THEN 'I read' END AS thought, CASE WHEN doc_id % 3 < 2 THEN source END AS tool,
  CASE doc_id % 3 WHEN 0 THEN '{"n": ' || n_chars || ', "q": "{' || lang || '}"}' WHEN 1 THEN '{}' END AS arguments FROM documents""")
def model_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first action of each step: one behind a thought and other objects, one with arguments of another kind, none."""
    n, tool = F.col("n_chars").cast("string"), F.concat(F.lit('{"herramienta": "'), "source", F.lit('", "argumentos": '))
    first = F.concat(F.lit("<think>look "), n, F.lit('</think>{"a": 1} '), tool, F.lit('{"n": '), n, F.lit(', "q": "{'), "lang", F.lit('}"}} {"herramienta": "b"}'))
    reply = F.when(F.expr("doc_id % 3 = 0"), first).when(F.expr("doc_id % 3 = 1"), F.concat(F.lit("I read {oops "), tool, F.lit("3}"))).otherwise(F.concat(F.lit("no action "), "lang"))
    return table(spark, sf_dir, "documents").select("doc_id", replies.actions(reply).alias("a")).select("doc_id", "a.*")


CODE = ["for x in y:  \n    print(x)", "return 1", "let a = 1\nlet b = 2\nlet c = 3", ""]


@query(rf"""WITH p AS (SELECT doc_id, left(text, 60) || chr(10) || {sql_list(CODE)}[doc_id % 4 + 1] || chr(10) || text AS t FROM documents),
l AS (SELECT doc_id, unnest(range(0, len(x))) AS n, unnest(x) AS line FROM (SELECT doc_id, string_split(t, chr(10)) AS x FROM p)),
c AS (SELECT *, regexp_matches(line, {q(text.CODE_LINE)}) AS code FROM l),
g AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id, code ORDER BY n) AS run FROM c),
runs AS (SELECT doc_id, run, min(n) AS first, string_agg(regexp_replace(line, '\s+$', ''), chr(10) ORDER BY n) FILTER (place <= 12) AS code FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY n) AS place FROM g WHERE code) GROUP BY doc_id, run HAVING count(*) >= 2)
SELECT doc_id, sha256(arg_min(runs.code, first)) AS code FROM p LEFT JOIN runs USING (doc_id) GROUP BY doc_id""")
def code_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first run of code in each passage."""
    passage = F.concat(F.substring("text", 1, 60), F.lit("\n"), picked(CODE, "doc_id % 4"), F.lit("\n"), "text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(replies.code_run(passage), 256).alias("code"))


@query(f"""WITH a AS (SELECT doc_id, list_filter({split_sql("translate(left(text, 700), chr(10), ' ')", '.!?»')}, lambda s: length(s) BETWEEN 25 AND 300 AND NOT ends_with(s, '?')) AS s, source AS main, ['b.org', source, lang || '.net'] AS others FROM documents)
SELECT doc_id, sha256(array_to_string(s, '|')) AS stated, main AS primary_domains, 'b.org,' || others[3] AS secondary_domains FROM a""")
def answer_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What answers state and whom they cite, without their code."""
    also = F.concat(F.lit("\nAlso reported by: b.org, "), "source", F.lit(", b.org,, "), "lang", F.lit(".net."))
    answer = F.concat(F.translate(F.substring("text", 1, 700), "\n", " "), F.lit("\n```python\nThis is code and not prose at all.\n```\nSource: "), "source", F.lit(" — https://x/y"), also)
    rows = table(spark, sf_dir, "documents").select("doc_id", replies.body(answer).alias("s"), replies.cited(answer).alias("c"))
    return rows.select("doc_id", F.sha2(F.array_join("s", "|"), 256).alias("stated"), F.array_join("c.primary", ",").alias("primary_domains"), F.array_join("c.secondary", ",").alias("secondary_domains"))


REST_SQL = r"regexp_replace(regexp_replace(t, " + q("(?i)^(?:" + text.CONNECTOR + ")") + r", ''), '^[ ,;]+|[ ,;]+$', '', 'g')"
FOLLOWS_SQL = f"""(NOT (length(t) <= 40 AND regexp_matches(t, {q(edge(text.SOCIAL))})) AND NOT (length(t) < 40 AND regexp_matches(t, {q(edge(text.REJECTION))}))
  AND (regexp_matches(t, {q(edge(text.CONNECTOR))}) OR (length(t) < 60 AND regexp_matches(t, {q(edges(text.DEICTIC))})) OR {ELLIPTIC_SQL}))"""


@query(f"""WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM ({TURNS_SQL})),
k AS (SELECT *, {TRIM} AS t, list_filter({terms_sql("coalesce(before, '')")}, lambda z: NOT contains(lower(text), lower(z))) AS missing FROM c),
j AS (SELECT *, array_to_string(missing, ' ') || ' — ' || CASE WHEN {REST_SQL} = '' THEN t ELSE {REST_SQL} END AS joined FROM k)
SELECT conv_id, turn, sha256(CASE WHEN before IS NOT NULL AND {FOLLOWS_SQL} AND len(missing) > 0 THEN joined || CASE WHEN NOT ends_with(joined, '?') AND (ends_with(t, '?') OR regexp_matches(t, {q(edge(text.REQUEST))})) THEN '?' ELSE '' END ELSE text END) AS resolved FROM j""")
def resolved_follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follow-ups as questions of their own, with the terms of the turn before."""
    lead = picked(LEADS, f"(conv_id * 3 + turn) % {len(LEADS)}")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(lead, F.when(F.expr("(conv_id + turn) % 2 = 0"), F.col("text")).otherwise(F.substring("text", 1, 20))).alias("text"))
    rows = rows.withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.select("conv_id", "turn", F.sha2(replies.follow_up(F.col("text"), F.col("before"), grouping.key_terms(F.col("before"))), 256).alias("resolved"))


EDGE, END = r"(^|[^\pL\pN_])", r"([^\pL\pN_]|$)"


def negation_sql(x: str) -> str:
    """By the first rule that fits, at its first place."""
    rules = [(rf"no\s+({text.VERBS_ES})", r"\1\2\3"), (rf"({text.VERBS_EN})\s+not", r"\1\2\3"), (f"({text.VERBS_ES})", r"\1no \2\3"), (f"({text.VERBS_EN})", r"\1\2 not\3")]
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {q('(?i)' + EDGE + p + END)}) THEN regexp_replace({x}, {q('(?i)' + EDGE + p + END)}, {q(new)})" for p, new in rules) + " END"


#: Sentences around an item's first words.
TOLD = ["El agua es {}", "Water is not {}", "{} no está aquí", "{} and it can be so", "{}"]
TOLD_SQL = f"replace({sql_list(TOLD)}[doc_id % {len(TOLD)} + 1], '{{}}', left(text, 40))"


def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.replace(picked(TOLD, f"doc_id % {len(TOLD)}"), F.lit("{}"), F.substring("text", 1, 40)).alias("text"))


@query(f"SELECT doc_id, {negation_sql('t')} AS negated FROM (SELECT doc_id, {TOLD_SQL} AS t FROM documents)")
def negated_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims negated at the first verb that takes it, or affirmed."""
    return told(spark, sf_dir).select("doc_id", text.negation(F.col("text")).alias("negated"))


@query(f"""WITH t AS (SELECT doc_id, lang, {TOLD_SQL} AS f FROM documents), n AS (SELECT doc_id, f, [struct_pack(kind := 'negacion', query := {negation_sql('f')}), struct_pack(kind := 'reformulacion', query := '  ' || f), struct_pack(kind := 'reformulacion', query := lang || ' ' || f), struct_pack(kind := 'reformulacion', query := lang || ' ' || f || ' ')] AS a FROM t),
k AS (SELECT doc_id, lower({TRIM_SQL.format('f')}) AS own, list_filter(a, lambda x: x.query IS NOT NULL) AS a FROM n),
e AS (SELECT doc_id, unnest(range(0, len(a))) AS n, unnest(a).kind AS kind, unnest(a).query AS query, own FROM k),
f AS (SELECT *, lower({TRIM_SQL.format('query')}) AS key FROM e),
o AS (SELECT * FROM f WHERE key NOT IN ('', own) QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY n) = 1),
m AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n) <= 3)
SELECT doc_id, coalesce(string_agg(kind || ':' || query, '|' ORDER BY n), '') AS angles FROM documents LEFT JOIN m USING (doc_id) GROUP BY doc_id""")
def query_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other ways to look for a fact: its negation and other wordings, distinct and unlike the fact."""
    fact = F.col("text")
    worded = F.concat("lang", F.lit(" "), fact)
    found = replies.angles(fact, F.array(F.concat(F.lit("  "), fact), worded, F.concat(worded, F.lit(" "))), 3)
    return told(spark, sf_dir).select("doc_id", F.array_join(F.transform(found, lambda a: F.concat(a["kind"], F.lit(":"), a["query"])), "|").alias("angles"))


BARE = [w.translate(replies.PLAIN) for w in replies.ACCENTED]


@query(rf"""SELECT doc_id, sha256(array_to_string(list_transform(regexp_extract_all(t, '[\pL\pN_]+|[^\pL\pN_]+'), lambda w: coalesce({sql_list(replies.ACCENTED)}[list_position({sql_list(BARE)}, w)], w)), '')) AS corrected
FROM (SELECT doc_id, {sql_list(BARE)}[doc_id % {len(BARE)} + 1] || ' ' || translate(text, 'áéíóúñ', 'aeioun') || ' Segun,' || {sql_list(BARE)}[doc_id * 7 % {len(BARE)} + 1] AS t FROM documents)""")
def accents_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left-out accents of frequent Spanish words."""
    plain = F.concat(picked(BARE, f"doc_id % {len(BARE)}"), F.lit(" "), F.translate("text", "áéíóúñ", "aeioun"), F.lit(" Segun,"), picked(BARE, f"doc_id * 7 % {len(BARE)}"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(replies.accents(plain), 256).alias("corrected"))


NOW = "2026-07-16 09:05:00"
ASKED = ["concat('¿Qué día es hoy? ', lang)", "'what time is it'", "concat('cuánto es ', doc_id % 20 * 5, '% de ', doc_id % 1000 * 20)", "concat('how much is ', doc_id % 50, ' + ', doc_id % 7, ' * 4?')", "concat('what is ', doc_id)", "concat('what is ', doc_id, '/0')", "text"]


@query(f"""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'Hoy es jueves 16 de julio de 2026. {replies.LOCAL_CLOCK}' WHEN 1 THEN 'Son las 09:05 (hora local de esta máquina). {replies.LOCAL_CLOCK}'
  WHEN 2 THEN 'El ' || doc_id % 20 * 5 || '% de ' || doc_id % 1000 * 20 || ' es ' || (doc_id % 20) * (doc_id % 1000) || '. {replies.LOCAL_SUM}'
  WHEN 3 THEN doc_id % 50 || '+' || doc_id % 7 || '*4 = ' || (doc_id % 50 + doc_id % 7 * 4) || '. {replies.LOCAL_SUM}' END AS answer FROM documents""")
def computed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that a clock or arithmetic answers; the clock is an argument."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr("CASE doc_id % 7 " + " ".join(f"WHEN {n} THEN {x}" for n, x in enumerate(ASKED)) + " END").alias("question"))
    return rows.select("doc_id", replies.computed_answers(F.col("question"), F.lit(NOW)).alias("answer"))


SUMS = ["concat(doc_id, ' + ', n_chars, ' * 4')", "concat('-(', doc_id, ' - ', n_chars, ') ** 2')", "concat(n_chars, ' / 4 % 3')", "concat('__import__(', doc_id, ')')", "concat(doc_id, ' / (', n_chars, ' - ', n_chars, ')')"]


@query("""SELECT doc_id, (CASE doc_id % 5 WHEN 0 THEN doc_id + n_chars * 4 WHEN 1 THEN -((doc_id - n_chars) * (doc_id - n_chars)) WHEN 2 THEN (n_chars / 4.0) % 3 END)::DOUBLE AS value FROM documents""")
def safe_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, powers and remainders; null for calls and divisions by zero."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr("CASE doc_id % 5 " + " ".join(f"WHEN {n} THEN {x}" for n, x in enumerate(SUMS)) + " END").alias("text"))
    return rows.select("doc_id", arithmetic.evaluate("text").alias("value"))
