"""Dialogue rules over conversations and documents: acts, languages, key terms, antecedents, keys, arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import grouping, spelling
from tessera.plans.agents import terms_sql
from tessera.plans.registry import query
from tessera.plans.verdicts import q, sql_list
from tessera.shared import spread, table

TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
UNICODE_EDGE = r"([^\pL\pN_]|$)"


def edge(pattern: str) -> str:
    """A pattern for RE2, whose \\b knows ASCII only: an edge behind a word is a non-letter or the end."""
    return "(?i)" + pattern.replace(r"\b", r"(?:[^\pL\pN_]|$)").removeprefix("(?i)")


FIRST = r"regexp_extract(t, '^\S+')"
QUESTION_SQL = f"""CASE WHEN ends_with(t, '?') THEN true
  WHEN upper({FIRST}) = {FIRST} AND lower({FIRST}) <> {FIRST} AND length({FIRST}) > 2 THEN false
  WHEN regexp_matches(t, {q(edge(text.REQUEST))}) AND length(t) < 140 THEN true
  ELSE regexp_matches(t, {q(edge(text.ASKS))}) AND length(t) < 140 AND NOT ends_with(t, '.') END"""


@query(f"SELECT conv_id, turn, {QUESTION_SQL} AS is_question FROM (SELECT conv_id, turn, {TRIM} AS t FROM conversations)")
def question_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.is_question(F.col("text")).alias("is_question"))


TASKS = ["Resume ", "haz una lista de ", "¿Analiza ", "Crea un ", "  Diseña ", "resumenes de ", "", "Traduce"]
TASK_SQL = q("(?i)" + text.TASK.replace(r"(?![\p{L}\p{N}_])", r"([^\pL\pN_]|$)"))


@query(f"""WITH x AS (SELECT conv_id, turn, {sql_list(TASKS)}[(conv_id * 5 + turn) % {len(TASKS)} + 1] || CASE WHEN conv_id % 4 = 0 THEN left(text, 3) || '?' ELSE text END AS text FROM conversations)
SELECT conv_id, turn, CASE WHEN length(t) >= {text.TASK_LEAST} AND NOT ends_with(t, '?') AND NOT ({QUESTION_SQL}) AND regexp_matches(t, {TASK_SQL}) THEN sha256(t) END AS task FROM (SELECT conv_id, turn, {TRIM} AS t FROM x)""")
def task_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of turns, with beginnings in turn, asks for work: their text's hash."""
    lead = F.array(*map(F.lit, TASKS))[((F.col("conv_id") * 5 + F.col("turn")) % len(TASKS)).cast("int")]
    rest = F.when(F.col("conv_id") % 4 == 0, F.concat(F.substring("text", 1, 3), F.lit("?"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(text.task(F.concat(lead, rest)), 256).alias("task"))


#: Beginnings that turns get, in turn.
LEADS = ["", "Y ", "¿Qué ", "gracias", "dame otra", "¿tienes ejemplos?", "eso ", "NASA says ", "how "]
TURNS_SQL = f"SELECT conv_id, turn, {sql_list(LEADS)}[(conv_id * 3 + turn) % {len(LEADS)} + 1] || CASE WHEN (conv_id + turn) % 2 = 0 THEN text ELSE left(text, 20) END AS text FROM conversations"
BARE_TERM = "translate(lower(w), 'áéíóúüñ', 'aeiouun')"


def edges(pattern: str) -> str:
    """Like edge(), for patterns that begin with an edge too."""
    return edge(pattern.replace(r"\b(", r"(?:^|[^\pL\pN_])(", 1) if pattern.startswith(r"\b") else pattern)


ELLIPTIC_SQL = f"(length(t) < 60 AND regexp_matches(t, {q(edge(text.REQUEST))}) AND len(list_filter({terms_sql('t')}, lambda w: NOT list_contains({sql_list(text.GENERIC)}, {BARE_TERM}))) = 0)"


@query(f"""SELECT conv_id, turn, CASE WHEN length(t) <= 40 AND regexp_matches(t, {q(edge(text.SOCIAL))}) THEN 'social' WHEN length(t) < 40 AND regexp_matches(t, {q(edge(text.REJECTION))}) THEN 'rejection'
  WHEN regexp_matches(t, {q(edge(text.CONNECTOR))}) OR (length(t) < 60 AND regexp_matches(t, {q(edges(text.DEICTIC))})) OR {ELLIPTIC_SQL} THEN 'follow_up' WHEN {QUESTION_SQL} THEN 'question' ELSE 'claim' END AS act
FROM (SELECT conv_id, turn, {TRIM} AS t FROM ({TURNS_SQL}))""")
def dialogue_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn is: social, rejection, follow-up, question or claim. Some turns get a beginning that tells."""
    lead = F.array(*map(F.lit, LEADS))[F.expr(f"(conv_id * 3 + turn) % {len(LEADS)}").cast("int")]
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(lead, F.when(F.expr("(conv_id + turn) % 2 = 0"), F.col("text")).otherwise(F.substring("text", 1, 20))).alias("text"))
    return rows.select("conv_id", "turn", text.dialogue_act(F.col("text")).alias("act"))


PROFILE_SQL = "(VALUES " + ", ".join(f"({q(lang)}, {sql_list(words.split())})" for lang, words in text.FUNCTION_WORDS.items()) + ") p(l, ws)"


@query(rf"""WITH owners AS (SELECT l, unnest(ws) AS w FROM {PROFILE_SQL}), weights AS (SELECT l, w, 1.0::DOUBLE / count(*) OVER (PARTITION BY w) AS v FROM owners),
words AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(lower(text), '\s+'), lambda x: trim(x, '¿?¡!.,;:«»"''()')), lambda x: x <> '')) AS w FROM documents),
counted AS (SELECT doc_id, w, count(*) AS c FROM words GROUP BY ALL),
totals AS (SELECT doc_id, sum(c) AS n FROM counted GROUP BY doc_id),
scores AS (SELECT doc_id, l, round(sum(c * v), 6) AS s, sum(c) AS hits FROM counted JOIN weights USING (w) GROUP BY ALL),
two AS (SELECT doc_id, max(s) AS top, arg_max(l, (s, -list_position(['es', 'en', 'de', 'fr', 'pt', 'it'], l))) AS l, count(*) AS k FROM scores GROUP BY doc_id),
judged AS (SELECT two.doc_id, CASE WHEN (SELECT count(*) FROM scores s WHERE s.doc_id = two.doc_id AND s.s = top) = 1 AND (SELECT hits FROM scores s WHERE s.doc_id = two.doc_id AND s.l = two.l) >= 2 AND n >= 2 THEN l ELSE 'es' END AS detected FROM two JOIN totals USING (doc_id))
SELECT d.doc_id, coalesce(detected, 'es') AS detected FROM documents d LEFT JOIN judged USING (doc_id)""")
def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language whose function words weigh most; Spanish if two tie or too few are found."""
    return grouping.languages(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


ANTECEDENT_SQL = r"list_distinct(regexp_extract_all(lower(text), '[\pL\pN_]{4,}'))"


@query(f"""WITH words AS (SELECT conv_id, turn, unnest({ANTECEDENT_SQL}) AS w FROM conversations),
df AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY conv_id, w) AS v FROM words),
met AS (SELECT a.conv_id, a.turn, b.turn AS antecedent, round(sum(a.v), 6) AS score FROM df a JOIN df b ON a.conv_id = b.conv_id AND a.w = b.w AND b.turn < a.turn GROUP BY ALL)
SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, antecedent) = 1""")
def keyword_antecedent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each turn the earlier one of its conversation that shares most of its rare words."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(text.content_words(F.col("text"))).alias("w"))
    return grouping.antecedents(words, "conv_id", "turn", "w")


#: Of the hashed vectors' likeness, from which a remembered turn is taken for the antecedent.
ALIKE = 0.3


@query(f"""WITH words AS (SELECT conv_id, turn, unnest({ANTECEDENT_SQL}) AS w FROM conversations),
df AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY conv_id, w) AS v FROM words),
met AS (SELECT a.conv_id, a.turn, b.turn AS antecedent, round(sum(a.v), 6) AS score FROM df a JOIN df b ON a.conv_id = b.conv_id AND a.w = b.w AND b.turn < a.turn GROUP BY ALL),
rare AS (SELECT conv_id, turn, antecedent FROM met QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, antecedent) = 1 AND score >= 0.5),
vecs AS (SELECT conv_id, turn, list_transform(range(256), lambda i: len(list_filter(ps, lambda p: p = i))) AS v FROM (SELECT conv_id, turn, list(('0x' || left(md5(w), 2))::INT) AS ps FROM words GROUP BY ALL)),
pairs AS (SELECT a.conv_id, a.turn, b.turn AS antecedent, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(a.v, lambda x: x * x)) * list_sum(list_transform(b.v, lambda x: x * x))), 6) AS score
  FROM vecs a JOIN vecs b ON a.conv_id = b.conv_id AND b.turn < a.turn - 1 AND b.turn >= a.turn - 220),
near AS (SELECT conv_id, turn, antecedent FROM pairs WHERE score > {ALIKE} QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, antecedent) = 1)
SELECT v.conv_id, v.turn, coalesce(r.antecedent, n.antecedent, v.turn - 1) AS antecedent, CASE WHEN r.antecedent IS NOT NULL THEN 'words' WHEN n.antecedent IS NOT NULL THEN 'meaning' ELSE 'last' END AS how
FROM vecs v LEFT JOIN rare r USING (conv_id, turn) LEFT JOIN near n USING (conv_id, turn) WHERE coalesce(r.antecedent, n.antecedent, v.turn - 1) >= 0""")
def antecedent_by_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each turn the earlier one that it goes back to: by rare words, else by likeness to remembered turns, else the last one."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(text.content_words(F.col("text"))).alias("w"))
    return grouping.remembered(words, "conv_id", "turn", "w", ALIKE)


@query("SELECT item_id, regexp_replace(trim(strip_accents(replace(lower(text), 'ß', 'ss'))), '\\s+', ' ', 'g') AS key FROM benchmark")
def normalized_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", text.plain_key("text").alias("key"))


@query(f"""WITH RECURSIVE t AS (SELECT conv_id, turn, {terms_sql('text', 10)} AS terms, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations QUALIFY n <= 9),
asked AS (SELECT conv_id, list_transform(terms, lambda a: lower(a)) AS words FROM t WHERE n = 1),
own AS (SELECT conv_id, n - 1 AS k, list_transform(list_filter(terms, lambda x: len(list_filter(words, lambda a: contains(lower(x), a) OR contains(a, lower(x)))) = 0), lambda x: lower(x)) AS mine FROM t JOIN asked USING (conv_id) WHERE n > 1),
step AS (SELECT conv_id, 0::BIGINT AS k, []::STRUCT(terms VARCHAR[], members BIGINT)[] AS parts FROM asked
  UNION ALL SELECT conv_id, k, CASE WHEN place IS NULL THEN list_append(parts, struct_pack(terms := mine, members := 1::BIGINT))
    ELSE list_transform(parts, lambda g, i: CASE WHEN i = place THEN struct_pack(terms := list_concat(g.terms, mine), members := g.members + 1) ELSE g END) END
  FROM (SELECT own.conv_id, own.k, own.mine, step.parts, list_filter(range(1, len(step.parts) + 1), lambda i: list_has_any(step.parts[i].terms, own.mine))[1] AS place FROM step JOIN own ON own.conv_id = step.conv_id AND own.k = step.k + 1)),
ended AS (SELECT conv_id, arg_max(parts, k) AS parts FROM step GROUP BY conv_id),
large AS (SELECT conv_id, g, i, count(*) OVER (PARTITION BY conv_id) AS n FROM (SELECT conv_id, unnest(parts) AS g, unnest(range(len(parts))) AS i FROM ended) WHERE g.members >= 2),
best AS (SELECT conv_id, g, row_number() OVER (PARTITION BY conv_id ORDER BY g.members DESC, i) - 1 AS part FROM large WHERE n >= 2 QUALIFY part < 3),
counted AS (SELECT conv_id, part, w, count(*) AS c FROM (SELECT conv_id, part, unnest(g.terms) AS w FROM best) GROUP BY ALL),
top AS (SELECT conv_id, part, string_agg(w, ',' ORDER BY c DESC, w) AS terms FROM (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY conv_id, part ORDER BY c DESC, w) <= 3) GROUP BY ALL)
SELECT conv_id, part, g.members AS size, coalesce(terms, '') AS terms FROM best LEFT JOIN top USING (conv_id, part)""")
def clarification_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each conversation the groups that its eight turns after the first form by distinctive terms, joined greedily in order.

    The first turn stands for the question: terms that hold one of its own, or stand in one, tell nothing.
    """
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.array(grouping.key_terms(F.col("text"), 10))).alias("terms"))  # a row each, so that terms are found once
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("n <= 9")
    first = best.where("n = 1").select("conv_id", F.col("terms").alias("asked"))
    related = lambda t: F.exists("asked", lambda a: F.contains(F.lower(t), F.lower(a)) | F.contains(F.lower(a), F.lower(t)))
    own = best.where("n > 1").join(first, "conv_id").select("conv_id", "turn", F.filter("terms", lambda t: ~related(t)).alias("terms"))
    return grouping.greedy_groups(own, "conv_id", "turn", "terms")


# Letters of long words are lost in the even turns: the fourth of each stretch of eight plain letters.
TYPO, TYPED = "([a-z]{3})[a-z]([a-z]{4})", "turn % 2 = 0"
MAY_SQL = f"list_filter(regexp_extract_all(text, '{spelling.WORD}'), lambda w: length(w) >= {spelling.LEAST} AND w = lower(w) AND regexp_matches(w, '" + r"\p{Ll}'))"
TOKENS_SQL = spelling.WORD + r"|[^\p{L}\p{N}_]+"


@query(rf"""WITH v AS (SELECT w AS word, count(*) AS n FROM (SELECT unnest({MAY_SQL}) AS w FROM documents) GROUP BY w HAVING count(*) >= 2),
t AS (SELECT conv_id, turn, CASE WHEN {TYPED} THEN regexp_replace(text, '{TYPO}', '\1\2', 'g') ELSE text END AS text FROM conversations),
u AS (SELECT DISTINCT unnest({MAY_SQL}) AS given FROM t),
s AS (SELECT given, translate(given, '{spelling.MARKED}', '{spelling.BARE}') AS p FROM u ANTI JOIN v ON given = word),
ends AS (SELECT given, p, word, n FROM s JOIN v ON left(given, 2) = left(word, 2) UNION SELECT given, p, word, n FROM s JOIN v ON right(given, 2) = right(word, 2)),
near AS (SELECT given, word, n FROM ends WHERE abs(length(given) - length(word)) <= 1 AND levenshtein(given, word) <= 3 AND p <> translate(word, '{spelling.MARKED}', '{spelling.BARE}') AND (contains(given, 'ü') OR NOT contains(word, 'ü'))
  AND CASE length(word) - length(given)
    WHEN 0 THEN len(list_filter(range(1, length(word) + 1), lambda i: given[i] <> word[i])) = 1
    WHEN 1 THEN list_contains(list_transform(range(length(word)), lambda i: left(word, i) || substr(word, i + 2)), given)
    ELSE list_contains(list_transform(range(length(given)), lambda i: left(given, i) || substr(given, i + 2)), word) END),
best AS (SELECT given, word FROM near QUALIFY row_number() OVER (PARTITION BY given ORDER BY n DESC, word) = 1),
m AS (SELECT map(list(given), list(word)) AS m FROM best)
SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(text, '{TOKENS_SQL}'), lambda x: coalesce(m[x], x)), '') AS text,
  len(list_filter(regexp_extract_all(text, '{spelling.WORD}'), lambda x: m[x] IS NOT NULL)) AS changed FROM t, m""")
def spelling_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with lost letters, corrected by the words of all documents, where one edit leads to one."""
    known = spelling.index(spelling.vocabulary(table(spark, sf_dir, "documents").select("text")))
    typed = F.when(F.expr(TYPED), F.regexp_replace("text", TYPO, "$1$2")).otherwise(F.col("text"))
    return spelling.corrected(table(spark, sf_dir, "conversations").select("conv_id", "turn", typed.alias("text")), known, ["conv_id", "turn"])
