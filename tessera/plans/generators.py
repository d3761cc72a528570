"""Further training material and checks of it: mined pairs, cited sentences, long documents, transcripts, temperature."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import replies, text
from tessera.operators import sampling, scores
from tessera.plans.evaluation import CLASSES, PRF_SQL, predictions
from tessera.plans.registry import query
from tessera.plans.retrieval import TOPK_SQL, nearest, split_sql
from tessera.plans.verdicts import q
from tessera.shared import shared_path, table
from tessera.sources import sinks, snapshots

#: Rows of each label that mining keeps.
MINED = 100


@query(f"""WITH p AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'SUPPORTS' ELSE 'NOT ENOUGH INFO' END AS label, length({split_sql('text', '.!?')}[1]) AS claim_size, md5(doc_id::VARCHAR || '11') AS h
  FROM documents JOIN labels USING (doc_id) WHERE length(text) BETWEEN 800 AND 6000 AND length({split_sql('text', '.!?')}[1]) >= 15)
SELECT doc_id, label, claim_size FROM p QUALIFY row_number() OVER (PARTITION BY label ORDER BY h, doc_id) <= {MINED}""")
def mined_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Premises and hypotheses of fitting lengths, as many of each label."""
    rows = table(spark, sf_dir, "documents").where(F.length("text").between(800, 6000)).join(table(spark, sf_dir, "labels"), "doc_id")
    label = F.when(F.col("quality") == 1, "SUPPORTS").otherwise("NOT ENOUGH INFO")
    size = F.length(F.get(text.sentences(F.col("text"), ".!?"), F.lit(0))).cast("long")
    found = rows.select("doc_id", label.alias("label"), size.alias("claim_size")).where("claim_size >= 15")
    return sampling.per_stratum(found, ["label"], "doc_id", 11, MINED)


#: Which sentences of its own document a claim cites, and the steps to two unrelated ones.
CITED, TRIES = (0, 2, 5), ((7919, 1), (104729, 2))


@query(f"""WITH docs AS (SELECT doc_id, {split_sql('text', '.!?')} AS s, (SELECT count(*) FROM documents) AS total FROM documents),
own AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'SUPPORTS' ELSE 'REFUTES' END AS label, doc_id AS evidence_id, length(trim(array_to_string(list_filter([s[1], s[3], s[6]], lambda x: x IS NOT NULL), ' '))) AS size FROM docs JOIN labels USING (doc_id)),
tries AS (SELECT doc_id, unnest([1, 2]) AS try, unnest([(doc_id * 7919 + 1) % total, (doc_id * 104729 + 2) % total]) AS other FROM docs JOIN labels USING (doc_id)),
nei AS (SELECT t.doc_id, 'NOT ENOUGH INFO' AS label, other AS evidence_id, length(d.s[t.doc_id % len(d.s) + 1]) AS size, try FROM tries t JOIN docs d ON d.doc_id = other WHERE other <> t.doc_id AND length(d.s[t.doc_id % len(d.s) + 1]) >= 30)
SELECT * FROM own WHERE size >= 30 UNION ALL SELECT doc_id, label, evidence_id, size FROM nei QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY try) = 1""")
def cited_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with the sentences that they cite, and with one of an unrelated document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.sentences(F.col("text"), ".!?").alias("s"))
    total = F.broadcast(docs.agg(F.count(F.lit(1)).alias("total")))  # one row
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    cited = F.trim(F.array_join(F.array(*(F.get("s", F.lit(k)) for k in CITED)), " "))
    own = docs.join(labels, "doc_id").select("doc_id", F.when(F.col("quality") == 1, "SUPPORTS").otherwise("REFUTES").alias("label"), F.col("doc_id").alias("evidence_id"), F.length(cited).cast("long").alias("size"))
    tries = labels.join(total).select("doc_id", F.posexplode(F.array(*((F.col("doc_id") * a + b) % F.col("total") for a, b in TRIES))).alias("try", "evidence_id")).where("evidence_id <> doc_id")
    met = tries.join(docs.select(F.col("doc_id").alias("evidence_id"), "s"), "evidence_id")
    size = F.length(F.get("s", (F.col("doc_id") % F.size("s")).cast("int"))).cast("long")
    other = met.select("doc_id", "try", "evidence_id", size.alias("size")).where("size >= 30").groupBy("doc_id").agg(F.min_by(F.struct("evidence_id", "size"), "try").alias("x"))
    return own.where("size >= 30").unionByName(other.select("doc_id", F.lit("NOT ENOUGH INFO").alias("label"), "x.*"))


CHUNKS_SQL = f"""s AS (SELECT doc_id, {split_sql('text', '.!?')} AS s FROM documents),
packed AS (SELECT doc_id, string_split(list_reduce(s, lambda acc, x: CASE
    WHEN length(string_split(acc, chr(2))[-1]) > 0 AND length(string_split(acc, chr(2))[-1]) + length(x) > 1500 THEN acc || chr(2) || x
    WHEN length(string_split(acc, chr(2))[-1]) = 0 THEN acc || x ELSE acc || ' ' || x END), chr(2)) AS p FROM s),
cut AS (SELECT doc_id, CASE WHEN length(p[-1]) <= 400 THEN p[:-2] ELSE p END AS p FROM packed)"""


@query(f"""WITH {CHUNKS_SQL}, docs AS (SELECT doc_id, p[1] AS doc, p[2] AS other, array_to_string({split_sql('p[1]', '.!?')}[1:2], ' ') AS claim FROM cut WHERE len(p) >= 2)
SELECT doc_id, unnest(['SUPPORTS', 'REFUTES', 'NOT ENOUGH INFO']) AS label, sha256(unnest([claim, claim || ' not', claim])) AS claim, sha256(unnest([doc, doc, other])) AS evidence FROM docs
WHERE length(claim) > 30 AND length(claim || ' not') / length(claim) > 0.85 AND length(claim || ' not') / length(claim) < 1.15""")
def long_document_trios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim on a document's first chunk, the claim corrupted, and the claim beside the next chunk.

    A model writes claims and corruptions; two sentences and a negation stand in for it.
    """
    rows = table(spark, sf_dir, "documents").select("doc_id", text.chunks(F.col("text")).alias("p")).where("size(p) >= 2")
    claim = F.array_join(F.slice(text.sentences(F.get("p", F.lit(0)), ".!?"), 1, 2), " ")
    rows = rows.select("doc_id", F.get("p", F.lit(0)).alias("doc"), F.get("p", F.lit(1)).alias("other"), claim.alias("claim")).withColumn("corrupted", F.concat("claim", F.lit(" not")))
    ratio = F.length("corrupted") / F.length("claim")
    trio = F.array(*(F.struct(F.lit(l).alias("label"), F.sha2(c, 256).alias("claim"), F.sha2(e, 256).alias("evidence")) for l, c, e in (("SUPPORTS", "claim", "doc"), ("REFUTES", "corrupted", "doc"), ("NOT ENOUGH INFO", "claim", "other"))))
    return rows.where((F.length("claim") > 30) & (ratio > 0.85) & (ratio < 1.15)).select("doc_id", F.explode(trio).alias("t")).select("doc_id", "t.*")


@query(rf"""WITH rows AS (SELECT item_id, b.text AS claim, d.text AS doc FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
words AS (SELECT *, list_distinct(regexp_extract_all(lower(claim), '[\pL\pN_]{{5,}}')) AS w, {split_sql('lower(doc)', '.!?')} AS s FROM rows)
SELECT item_id, len(w) >= 3 AND len(list_filter(s, lambda x: len(list_filter(w, lambda y: contains(x, y))) >= len(w) - 1)) = 0 AS composed FROM words""")
def composed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a claim draws on more than one sentence of its document."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("claim")).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("doc")), "item_id")
    return rows.select("item_id", text.composed(F.col("claim"), F.col("doc")).alias("composed"))


@query("""WITH t AS (SELECT conv_id, turn, role, text, string_agg('<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM conversations)
SELECT conv_id, turn, sha256(coalesce(before, '') || '<|im_start|>assistant' || chr(10)) AS prompt, sha256(coalesce(text, '') || '<|im_end|>') AS response FROM t WHERE role = 'assistant'""")
def transcript_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer of a transcript with all that was said before it."""
    turn = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "conversations").withColumn("before", F.array_join(F.collect_list(turn).over(before), "")).where("role = 'assistant'")
    prompt = F.concat("before", F.lit("<|im_start|>assistant\n"))
    return rows.select("conv_id", "turn", F.sha2(prompt, 256).alias("prompt"), F.sha2(F.concat(F.coalesce("text", F.lit("")), F.lit("<|im_end|>")), 256).alias("response"))


#: Temperatures that are tried.
GRID = [round(0.05 * k, 2) for k in range(1, 101)]


@query(f"""WITH rows AS (SELECT (50 + doc_id * 37 % 50) / 100.0::DOUBLE AS conf, quality = 1 AS truth FROM labels), z AS (SELECT 2 * ln(conf / (1 - conf)) AS z, truth FROM rows),
loss AS (SELECT t, round(avg(ln(1 + exp(CASE WHEN truth THEN -z / t ELSE z / t END))), 9) AS nll FROM z, (SELECT unnest({GRID})::DOUBLE AS t) GROUP BY t)
SELECT arg_min(t, (nll, t)) AS temperature, min(nll) AS nll, (SELECT nll FROM loss WHERE t = 1) AS before FROM loss""")
def temperature_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The temperature with the least loss: all of a grid in one pass over the rows."""
    conf = (50 + F.col("doc_id") * 37 % 50) / 100
    rows = table(spark, sf_dir, "labels").select((2 * F.ln(conf / (1 - conf))).alias("z"), (F.col("quality") == 1).alias("truth"))
    return scores.temperature(rows, "z", "truth", GRID).select("temperature", F.round("nll", 9).alias("nll"), F.round("before", 9).alias("before"))


@query(f"""WITH rows AS (SELECT doc_id, (50 + doc_id * 37 % 50) / 100.0::DOUBLE AS conf, quality = 1 AS truth FROM labels), z AS (SELECT doc_id, 2 * ln(conf / (1 - conf)) AS z, truth FROM rows),
loss AS (SELECT t, round(avg(ln(1 + exp(CASE WHEN truth THEN -z / t ELSE z / t END))), 9) AS nll FROM z, (SELECT unnest({GRID})::DOUBLE AS t) GROUP BY t),
best AS (SELECT arg_min(t, (nll, t)) AS t FROM loss)
SELECT doc_id, round(1 / (1 + exp(-z / t)), 6) AS prob FROM z, best""")
def temperature_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled scores: the fitted temperature lies in a store beside its model's name, over an older one, and is read from there."""
    conf = (50 + F.col("doc_id") * 37 % 50) / 100
    rows = table(spark, sf_dir, "labels").select("doc_id", (2 * F.ln(conf / (1 - conf))).alias("z"), (F.col("quality") == 1).alias("truth"))
    store = snapshots.Store(spark, shared_path(spark, "temperatures"), "model")
    fitted = scores.temperature(rows, "z", "truth", GRID).select(F.lit("judge").alias("model"), "temperature")
    store.overwrite(fitted.select("model", F.lit(1.0).alias("temperature")))
    store.upsert(fitted)
    stored = F.broadcast(store.read().where("model = 'judge'").select("temperature"))  # one row
    return rows.join(stored).select("doc_id", F.round(1 / (1 + F.exp(-F.col("z") / F.col("temperature"))), 6).alias("prob"))


@query(f"WITH {PRF_SQL} SELECT round(avg(f1), 6) AS macro_f1, count(*) AS n FROM prf WHERE class IN (SELECT gold FROM preds)")
def present_label_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro F1 over the labels that the gold rows have."""
    rows = predictions(spark, sf_dir)
    found = scores.class_scores(rows, CLASSES).join(rows.select(F.col("gold").alias("class")).distinct(), "class", "left_semi")
    return found.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, quality AS label FROM labels WHERE doc_id % 3 > 0")
def checked_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump of part of the labels, written as text and read again, beside the data set; the job fails if a label differs."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    folder = shared_path(spark, "dump")
    sinks.append_json(labels.where("doc_id % 3 > 0"), folder)
    return scores.joined_checked(spark.read.schema(labels.schema).json(folder), labels, "doc_id", "label")


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM labels), b AS (SELECT page_id, row_number() OVER (ORDER BY page_id) AS n FROM pages) SELECT n, doc_id, page_id FROM a JOIN b USING (n)""")
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two tables by their places in order."""
    a = sampling.numbered(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    b = sampling.numbered(table(spark, sf_dir, "pages").select("page_id"), "page_id")
    return a.join(b, "n").select("n", "doc_id", "page_id")


@query(r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS p FROM documents),
packed AS (SELECT doc_id, unnest(string_split(list_reduce(p, lambda acc, x: acc || CASE WHEN length(replace(string_split(acc, chr(2))[-1], chr(10), '')) + length(x) > 800 THEN chr(2) ELSE chr(10) END || x), chr(2))) AS piece FROM p WHERE len(p) > 0)
SELECT doc_id, length(piece) AS size, sha256(piece) AS digest FROM packed WHERE length(piece) >= 40""")
def paragraph_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs (the tables' lines) packed into pieces of about 800 characters."""
    spaced = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.paragraphs(spaced)).alias("p"))
    return rows.select("doc_id", F.length("p").cast("long").alias("size"), F.sha2("p", 256).alias("digest"))


# Orders for files, in the order in which they are tried.
NAME, TARGET, END = r"[«\"']?([^«»\"']+?)[»\"']?", r"[«\"']?([^«»\"'?!]+?)[»\"']?", r"[?!\s]*$"
ORDERS = [
    ("mover", r"^\s*(?:mueve|mover|move)\s+(?:la carpeta |el archivo |the folder |the file )?" + NAME + r"\s+(?:a|hacia|to)\s+" + TARGET + END),
    ("copiar", r"^\s*(?:copia|copiar|copy)\s+(?:la carpeta |el archivo )?" + NAME + r"\s+(?:a|en|to)\s+" + TARGET + END),
    ("renombrar", r"^\s*(?:renombra|renombrar|rename)\s+" + NAME + r"\s+(?:a|como|to)\s+" + TARGET + END),
    ("crear_carpeta", r"^\s*(?:crea|crear|create)\s+(?:una |la )?(?:carpeta|folder|directorio)\s+(?:llamada? )?" + TARGET + END),
    ("listar", r"^\s*(?:lista|listar|list|muestra|qu[eé] hay en)\s+(?:la carpeta |el contenido de )?" + TARGET + END),
    ("papelera", r"^\s*(?:borra|borrar|elimina|eliminar|delete)\s+(?:la carpeta |el archivo )?" + TARGET + END),
]
#: Orders with places for a name and a target, what they ask for, and whether they name a target.
TOLD = [
    ("mueve el archivo '{n}' a {t}", "mover", True), ("copy {n} to {t}!", "copiar", True), ("renombra {n} como {t}", "renombrar", True), ("crea una carpeta llamada {n}", "crear_carpeta", False),
    ("qué hay en {n}?", "listar", False), ("borra la carpeta {n}", "papelera", False), ("el {n} hierve en {t}", None, False), ("borra {n} " + "x" * 160, None, False),
]


@query(f"""SELECT doc_id, CASE doc_id % {len(TOLD)} {' '.join(f"WHEN {n} THEN {q(a)}" for n, (_, a, _) in enumerate(TOLD) if a)} END AS action,
  CASE WHEN doc_id % {len(TOLD)} < 6 THEN source || doc_id || '.txt' END AS origin, CASE WHEN doc_id % {len(TOLD)} < 3 THEN lang || '-' || source END AS target FROM documents""")
def file_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders for files: the first pattern that fits a text of 160 characters or fewer."""
    forms = F.array(*(F.lit(t) for t, _, _ in TOLD))[(F.col("doc_id") % len(TOLD)).cast("int")]
    name, target = F.concat("source", F.col("doc_id").cast("string"), F.lit(".txt")), F.concat("lang", F.lit("-"), "source")
    said = F.replace(F.replace(forms, F.lit("{n}"), name), F.lit("{t}"), target)
    return table(spark, sf_dir, "documents").select("doc_id", replies.file_order(said, ORDERS).alias("o")).select("doc_id", "o.action", "o.origin", "o.target")


#: Scores of neighbours that are near but not the same: the tables' vectors are further apart than those of texts (0.78 to 0.90).
BAND = (0.25, 0.45)


@query(rf"""WITH {TOPK_SQL}, words AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\pL\pN_]{{5,}}')) AS w FROM documents),
met AS (SELECT query_id, id, rank FROM ranked JOIN words a ON a.doc_id = query_id JOIN words b ON b.doc_id = id WHERE rank <= 20 AND score >= {BAND[0]} AND score < {BAND[1]} AND (len(a.w) = 0 OR len(list_intersect(a.w, b.w)) / len(a.w) <= 0.4))
SELECT query_id, id, rank FROM met QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) = 1""")
def other_event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each query the first near neighbour whose text has few of its words: a claim beside evidence of another event."""
    band = nearest(spark, sf_dir, 20).where((F.col("score") >= BAND[0]) & (F.col("score") < BAND[1]))
    words = table(spark, sf_dir, "documents").select("doc_id", text.content_words(F.col("text"), 5).alias("w"))
    met = band.join(words.select(F.col("doc_id").alias("query_id"), F.col("w").alias("own")), "query_id").join(words.select(F.col("doc_id").alias("id"), "w"), "id")
    apart = (F.size("own") == 0) | (F.size(F.array_intersect("own", "w")) / F.greatest(F.size("own"), F.lit(1)) <= 0.4)
    return met.where(apart).groupBy("query_id").agg(F.min_by(F.struct("id", "rank"), "rank").alias("x")).select("query_id", "x.*")
