"""The thin queries opN_<name>: each applies its operator to the whole table and derives the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, exact_dedup, html, licenses, minhash, packing, periodic, prefix_trie, quality, secrets, sharding, simhash, warc
from tessera.shared import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The columns that a query needs, over all cores."""
    return spread(table(spark, sf_dir, name).select(*columns))


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "digest_ok")


SQL["op1_warc"] = r"""
WITH p AS (
  SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS largest FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> largest THEN largest END AS refers_to,
       url, true AS digest_ok
FROM w
"""


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents", "doc_id", "text", "source"))
    count = lambda kind: F.size(F.filter("base", lambda c: c["kind"] == kind)).cast("long")
    said = lambda verdict: F.size(F.filter("all", lambda c: c["kind"] == verdict)).cast("long")
    return found.withColumn("all", secrets.all_spans()).select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in secrets.LEAST),
        F.sha2(secrets.spelled(F.col("base")), 256).alias("base_sha256"),
        secrets.spelled(F.col("all")).alias("spans"),
        said("live").alias("n_live"),
        said("example").alias("n_example"),
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(packing.pieces(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path()))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(read(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col(decontaminate.N_WORDS).alias("n_words"),
        F.col(decontaminate.N_HIT).alias("n_hit"),
        F.size(decontaminate.ITEMS).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", decontaminate.ITEMS), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def _op5_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    size = decontaminate.WINDOW
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {words} AS w FROM benchmark),
windows AS (SELECT item, w, least({size}, len(w)) AS n, unnest(range(1, greatest(len(w) - {size} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0),
keys AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM windows),
seen AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM keys) WHERE len(w) >= n)),
met AS (SELECT r, i, n, item FROM seen JOIN keys USING (k, n)),
hits AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM met) GROUP BY r),
items AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM met WHERE item IS NOT NULL GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(array_to_string(coalesce(items, []), ',')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)"""


SQL["op5_decontamination"] = _op5_sql()


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.deduplicate(exact_dedup.digests(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


SQL["op6_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST)
"""


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.deduplicate(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.with_scores(spread(docs), quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), F.col(quality.SCORE).alias("score"), (F.col(quality.SCORE) >= quality.THRESHOLD).cast("int").alias("predicted"))


@query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents", "doc_id", "text"))
    starts = F.flatten(F.transform("places", lambda p: p["starts"]))
    base = F.transform("places", lambda p: p["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.concat_ws(",", F.array_sort(F.array_distinct(base))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(F.array_union(base, "linked"), F.transform("wrapped", lambda w: w["label"])))).alias("labels"),
        F.when(F.size(starts) > 0, F.lit(1.0)).otherwise(F.aggregate("wrapped", F.col("share"), lambda most, w: F.greatest(most, w["share"]))).alias("score"),
        F.aggregate("wrapped", F.col("n_links"), lambda n, w: n + w["n"]).alias("n_links"),
    )


@query
def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.main_text(read(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _op9_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = "regexp_extract_all({0}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    told = ", ".join(f"({n}, '{label}', {own}, {need}, {wide})" for (n, label, own, need), wide in zip(licenses.template_sets(), licenses.window_widths(), strict=True))
    starts = []
    for phrase, label in licenses.PHRASES.items():
        same = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(phrase.split()))
        starts.append(f"list_transform(list_filter(range(len(w)), lambda i: {same}), lambda i: {{'s': i, 'l': '{label}'}})")
    # A window begins at a template's word and is `wide` words long; those of one template that overlap are one link.
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS t FROM documents),
w AS (SELECT r, doc_id, {words.format('t')} AS w FROM t),
p AS (SELECT r, doc_id, len(w) AS n_words, list_concat({', '.join(starts)}) AS p FROM w),
templates AS (SELECT * FROM (VALUES {told}) x(n, label, own, need, wide)),
lines AS (SELECT r, unnest(range(len(ls))) AS l, unnest(ls) AS line FROM (SELECT r, string_split(t, chr(10)) AS ls FROM t)),
blocks AS (SELECT r, l, {words.format('line')} AS b FROM lines),
links AS (SELECT r, l, n, label, len(list_intersect(list_distinct(b), own)) / len(own) AS share FROM blocks, templates WHERE len(list_intersect(list_distinct(b), own)) >= need),
linked AS (SELECT r, count(*) AS n_links, list(DISTINCT label) AS ls, max(share) AS share FROM links GROUP BY r),
tokens AS (SELECT r, l, word, row_number() OVER (PARTITION BY r ORDER BY l, k) AS i FROM (SELECT r, l, unnest(b) AS word, unnest(range(len(b))) AS k FROM blocks)),
theirs AS (SELECT r, n, i, l, word FROM tokens JOIN (SELECT n, unnest(own) AS word FROM templates) USING (word)),
enough AS (SELECT r, n, need, wide FROM (SELECT r, n, count(DISTINCT word) AS c FROM theirs GROUP BY r, n) JOIN templates USING (n) WHERE c >= need),
windows AS (SELECT r, n, a.i AS start, max(b.i) AS stop, a.l AS head, max(b.l) AS tail, count(DISTINCT b.word) AS overlap
  FROM enough JOIN theirs a USING (r, n) JOIN theirs b USING (r, n) WHERE b.i >= a.i AND b.i < a.i + wide GROUP BY r, n, a.i, a.l),
across AS (SELECT * FROM windows JOIN templates USING (n) WHERE overlap >= need AND head < tail AND NOT EXISTS (SELECT 1 FROM links k WHERE k.r = windows.r AND k.n = windows.n AND k.l BETWEEN head AND tail)),
apart AS (SELECT *, start > coalesce(max(stop) OVER (PARTITION BY r, n ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS new FROM across),
wrapped AS (SELECT r, list(DISTINCT label) AS ls, count(*) FILTER (new) AS n_links, max(overlap / len(own)) AS share FROM apart GROUP BY r)
SELECT doc_id, n_words, len(p) AS n_base,
  list_min(list_transform(p, lambda x: x.s)) AS first_word, list_max(list_transform(p, lambda x: x.s)) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.l))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(p, lambda x: x.l), coalesce(linked.ls, []), coalesce(wrapped.ls, [])))), ',') AS labels,
  CASE WHEN len(p) > 0 THEN 1.0 ELSE greatest(coalesce(linked.share, 0), coalesce(wrapped.share, 0)) END::DOUBLE AS score, coalesce(linked.n_links, 0) + coalesce(wrapped.n_links, 0) AS n_links
FROM p LEFT JOIN linked USING (r) LEFT JOIN wrapped USING (r)"""


SQL["op9_licenses"] = _op9_sql()


def _op3_sql() -> str:
    found = []
    for rank, (kind, pattern) in enumerate({"assign": secrets.ASSIGN, "access": secrets.ACCESS, "hex": secrets.HEX}.items()):
        p = "'" + pattern.replace("'", "''") + "'"
        value = f"regexp_extract_all(t, {p}, 2)" if kind == "assign" else f"regexp_extract_all(t, {p})"
        found.append(f"""SELECT r, doc_id, source, {rank} AS rank, '{kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS match, unnest({value}) AS value, parts, m
  FROM (SELECT *, regexp_extract_all(t, {p}) AS m, string_split_regex(t, {p}) AS parts FROM t)""")
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
every AS ({' UNION ALL '.join(found)}),
placed AS (SELECT *, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start FROM every),
base AS (SELECT r, doc_id, source, rank, kind, start, start + length(match) AS stop, value FROM placed
  WHERE length(value) >= CASE kind WHEN 'assign' THEN 8 WHEN 'access' THEN 16 ELSE 32 END),
owned AS (SELECT value, count(DISTINCT coalesce('=' || source, '')) AS owners, count(DISTINCT (coalesce('=' || source, ''), coalesce('=' || doc_id, ''))) AS repositories FROM base GROUP BY value),
heads AS (SELECT value, string_split(value, '') AS cs FROM owned),
looks AS (SELECT value, regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(cs)) >= {secrets.LIVE_CHARACTERS}
  AND -list_sum(list_transform(list_distinct(cs), lambda c: len(list_filter(cs, lambda x: x = c)) / len(cs) * log2(len(list_filter(cs, lambda x: x = c)) / len(cs)))) >= {secrets.LIVE_BITS} AS random FROM heads),
told AS (SELECT b.*, CASE WHEN owners >= {secrets.EXAMPLE_OWNERS} OR repositories >= {secrets.EXAMPLE_REPOSITORIES} THEN 'example' WHEN owners = 1 AND random THEN 'live' ELSE '' END AS verdict FROM base b JOIN owned USING (value) JOIN looks USING (value)),
spans AS (SELECT r, rank, kind, start, stop FROM base UNION ALL SELECT DISTINCT r, CASE verdict WHEN 'live' THEN 3 ELSE 4 END, verdict, start, stop FROM told WHERE verdict <> ''),
joined AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS b,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS a,
  count(*) FILTER (kind = 'live') AS n_live, count(*) FILTER (kind = 'example') AS n_example FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256,
  coalesce(a, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM t LEFT JOIN joined USING (r)"""


SQL["op3_secrets"] = _op3_sql()


@query
def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", minhash.kept().alias("kept"))


def _op11_sql() -> str:
    upper, size = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", minhash.SHINGLE
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+')"
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
g AS (SELECT r, doc_id, list_distinct(list_transform(range(1, greatest(1, len(w) - {size - 1}) + 1), lambda i: array_to_string(w[i:i + {size - 1}], ' '))) AS s FROM d WHERE len(w) > 0),
c AS (SELECT min(r) AS c, any_value(s) AS s, len(any_value(s)) AS n FROM g GROUP BY list_sort(s)),
e AS (SELECT c, n, unnest(s) AS k FROM c),
met AS (SELECT x.c AS a, y.c AS b FROM e x JOIN e y ON x.k = y.k AND x.c < y.c GROUP BY x.c, y.c, x.n, y.n HAVING 100 * count(*) >= {minhash.PERCENT} * (x.n + y.n - count(*))),
twice AS (SELECT a, b FROM met UNION ALL SELECT b, a FROM met),
reach(a, b) AS (SELECT a, b FROM twice UNION SELECT reach.a, twice.b FROM reach JOIN twice ON reach.b = twice.a),
roots AS (SELECT c, least(c, coalesce(min(b), c)) AS root FROM c LEFT JOIN reach ON c = a GROUP BY c),
own AS (SELECT g.r, g.doc_id, len(g.s) AS n, root FROM g JOIN c ON list_sort(g.s) = list_sort(c.s) JOIN roots USING (c)),
least AS (SELECT root, min(doc_id) AS component_id FROM own GROUP BY root)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n IS NULL THEN d.doc_id ELSE component_id END AS component_id,
  d.doc_id IS NOT DISTINCT FROM CASE WHEN n IS NULL THEN d.doc_id ELSE component_id END AS kept
FROM d LEFT JOIN own USING (r) LEFT JOIN least USING (root)"""


SQL["op11_minhash"] = _op11_sql()


#: DuckDB has no crc32: its table, and the sum of an ASCII string `{0}` by it.
CRC_TABLE = "crc AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS bytes FROM range(256) t(n))"
CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, bytes[(xor(c, b) & 255) + 1])), 4294967295)"


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered(table(spark, sf_dir, "conversations"))
    conv = F.col("conv")
    convs, rebuilt = prefix_trie.from_heads(turns, (F.crc32(conv.cast("string")) % 6).cast("int"), conv - conv % 100, 5)
    return prefix_trie.trie(convs, rebuilt).select(*prefix_trie.NODE)


SQL["op12_prefix_trie"] = f"""
WITH {CRC_TABLE},
t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, {CRC.format('c::VARCHAR')} % 6 AS h FROM (SELECT DISTINCT c FROM t), crc),
heads AS (SELECT k.c, h, count(t.c) AS taken FROM k LEFT JOIN t ON t.c = k.c - k.c % 100 AND t.pos < h GROUP BY k.c, h),
s AS (SELECT k.c, pos + 1 AS depth, role, text FROM k JOIN t ON t.c = k.c - k.c % 100 AND pos < h
  UNION ALL SELECT c, taken + pos - h + 1, role, text FROM heads JOIN t USING (c) WHERE pos >= h),
p AS (SELECT c, depth, length(text) AS chars, list(len(role) || ':' || role || text) OVER (PARTITION BY c ORDER BY depth) AS prefix FROM s),
m AS (SELECT c, depth, chars, min(c) OVER (PARTITION BY prefix) AS node FROM p UNION ALL SELECT c, 0, 0, min(c) OVER () FROM k),
last AS (SELECT c, max(depth) AS depth FROM m GROUP BY c),
n AS (SELECT node, depth, count(*) AS n_convs, any_value(chars) AS chars FROM m GROUP BY node, depth),
up AS (SELECT DISTINCT b.node, b.depth, a.node AS parent FROM m b JOIN m a ON a.c = b.c AND a.depth = b.depth - 1),
kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM up GROUP BY ALL),
under AS (SELECT DISTINCT a.node, a.depth, b.node AS n2, b.depth AS d2 FROM m a JOIN m b ON a.c = b.c AND b.depth >= a.depth),
sums AS (SELECT u.node, u.depth, sum((x.n_convs - 1) * x.chars)::BIGINT AS saved_tokens, count(*) FILTER (kids.n_children IS NULL) AS n_leaves
  FROM under u JOIN n x ON x.node = n2 AND x.depth = d2 LEFT JOIN kids ON kids.node = n2 AND kids.depth = d2 GROUP BY u.node, u.depth),
ends AS (SELECT node, depth, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM m JOIN last USING (c, depth) GROUP BY node, depth)
SELECT n.node AS conv_id, n.depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN sums USING (node, depth) LEFT JOIN up USING (node, depth) LEFT JOIN kids USING (node, depth) LEFT JOIN ends USING (node, depth)"""


def _periodic_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text; the texts of a tenth of the ids repeat a part of their words from some word on."""
    g = F.floor(F.crc32(F.col("doc_id").cast("string")) / 10)
    words = F.array(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))  # of one, so that they are taken once
    n = lambda w: F.size(w).cast("long")
    a = lambda w: g % n(w)
    p = lambda w: 1 + F.floor((n(w) - a(w)) / (3 + g % 8))

    def repeated(w: Column) -> Column:
        times = F.ceil((n(w) - a(w)) / p(w)).cast("int")
        again = F.flatten(F.array_repeat(F.slice(w, (a(w) + 1).cast("int"), p(w).cast("int")), times))
        return F.array_join(F.concat(F.slice(w, 1, a(w).cast("int")), F.slice(again, 1, (n(w) - a(w)).cast("int"))), " ")

    dealt = (F.crc32(F.col("doc_id").cast("string")) % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return docs.select("doc_id", F.when(dealt, F.transform(words, repeated)[0]).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.with_runs(_periodic_texts(read(spark, sf_dir, "documents", "doc_id", "text")))
    runs = F.col(periodic.RUNS)
    # Runs are in order of start and period, so of equal ones the first stays.
    greatest = F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", greatest).select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        *(F.col("best")[c].alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(periodic.COLLAPSED, 256).alias("collapsed_sha256"),
    )


SQL["op13_periodic"] = rf"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {CRC.format('doc_id::VARCHAR')} AS h FROM documents, crc),
s AS (SELECT *, len(w) AS n, (h // 10) % len(w) AS a, 1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8) AS p FROM d),
t AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(w[1:a], list_transform(range(a, n), lambda i: w[a + (i - a) % p + 1])) ELSE w END AS w FROM s),
each AS (SELECT r, n, unnest(w) AS v, unnest(range(n)) AS i FROM t),
same AS (SELECT x.r, x.i, y.i - x.i AS q FROM each x JOIN each y ON x.r = y.r AND x.v = y.v AND y.i > x.i AND y.i - x.i <= x.n // 4),
isles AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS isle FROM same),
found AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM isles GROUP BY r, q, isle HAVING count(*) + q >= greatest({periodic.LEAST}, {periodic.PERIODS} * q)),
runs AS (SELECT r, start, length, min(q) AS period FROM found GROUP BY r, start, length),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length::DECIMAL(18,0) / period DESC, start, period) AS k FROM runs) WHERE k = 1),
told AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(v, ' ' ORDER BY i) AS left_over FROM each ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(left_over, '')) AS collapsed_sha256
FROM t LEFT JOIN told USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""
