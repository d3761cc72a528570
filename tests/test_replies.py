"""Rules over replies and turns on cases whose results are known."""

import json

from pyspark.sql import functions as F

from tessera.functions import replies, text
from tessera.functions.arithmetic import value
from tessera.operators import grouping
from tessera.plans.generators import ORDERS
from tessera.sources import payloads, registry

#: reply, omission, verdict, questions.
REPLIES = [
    ("<think>REFUTED? no</think>It is SUPPORTED.", None, "Supported", "It is SUPPORTED."),
    ("SUPPORTED at first, but then REFUTED", None, "Refuted", "SUPPORTED at first, but then REFUTED"),
    ("Not enough evidence; misleading", "enganosa", "Not Enough Evidence", "Not enough evidence; misleading"),
    ("complete", "completa", None, ""),
    ("<think>never closed SUPPORTED", None, None, ""),
    ("1. **Who built the bridge?** When was it built?\n- Who built the bridge?\nnot a question", None, None, "Who built the bridge?** When was it built?|Who built the bridge?"),
    ('search: "height of the tower"\nsearch "height of the tower"\nshort', None, None, "height of the tower"),
]

ACTIONS = [
    ('<think>look</think>{"a": 1} {"herramienta": "buscar", "argumentos": {"q": "{x}"}} {"herramienta": "b"}', "look", "buscar", '{"q": "{x}"}'),
    ('I read {oops {"herramienta": "leer", "argumentos": 3}', "I read", "leer", "{}"),
    ("no action", None, None, None),
    (None, None, None, None),
    ('He said "go {now" and then {"x": {"herramienta": "inner"}, "herramienta": 5} {"herramienta": "t", "argumentos": {"a": "\\"}{", "b": {"c": [1, {}]}}}', "He said \"go", "inner", "{}"),
    ('{"k": "\\"argumentos\\": {}", "argumentos": {"z": 1}, "herramienta": "t"} rest', "", "t", '{"z": 1}'),
    ('{"herramienta": "t", "argumentos": {"a": "}\\"{", "b": {"c": [1, {}]}}}', "", "t", '{"a": "}\\"{", "b": {"c": [1, {}]}}'),
    ('{"herramienta": "never closed"', None, None, None),
]

PASSAGES = [
    ("Loops:\nfor x in y:  \n    print(x)\nDone.", "for x in y:\n    print(x)"),
    ("one line\nreturn 1\nno more\nlet a = 1\nlet b = 2", "let a = 1\nlet b = 2"),
    ("no code", None),
]

STATED = "The bridge was built in the year 1900 by hand."

ANSWERS = [
    (f"{STATED} Is that so for everybody here?\n```python\nThis is code and not prose at all.\n```\nSource: a.org — https://a.org/x\nAlso reported by: b.org, a.org, c.org.", STATED, "a.org", "b.org,c.org"),
    ("Short. Source none", "", "", ""),
]

TURNS = [
    ("y en el contexto de machine learning?", "que es lora?", "lora — en el contexto de machine learning?"),
    ("y en Francia", "Poblacion total de Alemania", "Poblacion total Alemania — en Francia"),
    ("Las vacas comen hierba.", "que es lora?", "Las vacas comen hierba."),
    ("y eso?", None, "y eso?"),
]

FACTS = [
    ("El agua es azul", ["el agua ES azul ", "agua azul", "Agua azul"], "negacion:El agua no es azul|reformulacion:agua azul"),
    ("nothing here", ["a", "b", "c", "d"], "reformulacion:a|reformulacion:b|reformulacion:c"),
]

SPELLED = [("la poblacion del pais, segun Poblacion", "la población del país, según Poblacion"), ("nada", "nada"), ("", "")]
NOW = "2026-07-16 09:05:00"

COMPUTED = [
    ("¿Qué día es hoy?", f"Hoy es jueves 16 de julio de 2026. {replies.LOCAL_CLOCK}"),
    ("what time is it", f"Son las 09:05 (hora local de esta máquina). {replies.LOCAL_CLOCK}"),
    ("cuánto es 12,5% de 80", f"El 12.5% de 80 es 10. {replies.LOCAL_SUM}"),
    ("how much is 2 + 3 * 4?", f"2+3*4 = 14. {replies.LOCAL_SUM}"),
    ("what is 7", None),
    ("what is 1/0", None),
    (None, None),
]

SAID = [
    ("mueve el archivo 'a.txt' a docs", "mover", "a.txt", "docs"), ("copy x to y!", "copiar", "x", "y"), ("renombra notas como ideas", "renombrar", "notas", "ideas"),
    ("crea una carpeta llamada fotos", "crear_carpeta", "fotos", None), ("qué hay en docs?", "listar", "docs", None), ("borra la carpeta tmp", "papelera", "tmp", None),
    ("el agua hierve", None, None, None), ("borra " + "x" * 160, None, None, None),
]
LONG = "A passage that is long enough to count as evidence of something."
#: source, query, record, and (text, url, domain) of what it gives.
CASES: list[tuple[str, str, object, list[tuple[str, str, str]]]] = [
    ("web", "", {"href": "https://www.site.org/a", "body": LONG}, [(LONG, "https://www.site.org/a", "site.org")]),
    ("web", "", {"href": "https://site.org/b", "body": "short"}, []),
    ("stackexchange", "", {"question_id": 7, "title": "t", "excerpt": f"<b>{LONG}</b>"}, [(LONG, "https://stackoverflow.com/q/7", "stackoverflow.com")]),
    ("stackexchange-matematicas", "", {"title": "t", "excerpt": LONG}, []),
    ("semantic-scholar", "", {"title": "t", "abstract": " ".join([LONG] * 30)}, [(" ".join([LONG] * 9), "https://www.semanticscholar.org", "semanticscholar.org")] * 2),
    ("openalex", "", {"title": "t", "doi": "https://doi.org/1", "abstract_inverted_index": {w: [k] for k, w in enumerate("these words stand in an inverted index of positions".split())}}, [("these words stand in an inverted index of positions", "https://doi.org/1", "openalex.org")]),
    ("arxiv", "", f"<entry><id> http://arxiv.org/abs/1 </id><title>t</title><summary>{LONG.replace(' ', chr(10))}</summary></entry>", [(LONG, "http://arxiv.org/abs/1", "arxiv.org")]),
    ("crossref", "", {"title": ["t"], "abstract": f"<jats:p>{LONG}</jats:p>", "DOI": "10.1/x"}, [(LONG, "https://doi.org/10.1/x", "crossref.org")]),
    ("europepmc", "", {"id": "9", "title": "t", "abstractText": LONG}, [(LONG, "https://europepmc.org/article/MED/9", "europepmc.org")]),
    ("nvd", "", {"cve": {"id": "CVE-1", "descriptions": [{"lang": "es", "value": "no"}, {"lang": "en", "value": LONG}]}}, [(f"CVE-1: {LONG}", "https://nvd.nist.gov/vuln/detail/CVE-1", "nvd.nist.gov")]),
    ("tribunales", "", {"caseName": "A v. B", "court": "Court", "dateFiled": "2001-02-03", "absolute_url": "/o/1", "opinions": [{"snippet": ""}, {"snippet": "found  for the plaintiff"}]}, [("A v. B. Court, 2001-02-03. found for the plaintiff", "https://www.courtlistener.com/o/1", "courtlistener.com")]),
    ("tribunales", "", {"caseName": "", "court": LONG}, []),
    ("openfda", "", {"openfda": {"brand_name": ["X"]}, "warnings": [LONG, "second"], "indications_and_usage": ["short"]}, [(LONG, "https://open.fda.gov", "fda.gov")]),
    ("clinicaltrials", "", {"protocolSection": {"identificationModule": {"nctId": "N1", "briefTitle": "t"}, "descriptionModule": {"briefSummary": LONG}}}, [(f"{LONG} Status: unknown.", "https://clinicaltrials.gov/study/N1", "clinicaltrials.gov")]),
    ("hackernews", "", {"objectID": "5", "title": "A title of thirty characters or more"}, [("A title of thirty characters or more", "https://news.ycombinator.com/item?id=5", "news.ycombinator.com")]),
    ("reddit", "", {"data": {"title": "Title", "selftext": LONG, "permalink": "/r/x"}}, [(f"Title. {LONG.rstrip('.')}", "https://www.reddit.com/r/x", "reddit.com")]),
    ("openlibrary", "", {"title": "T", "author_name": ["A", "B"], "first_publish_year": 1900, "key": "/w/1"}, [("Registro bibliográfico: «T», de A, B, publicado por primera vez en 1900.", "https://openlibrary.org/w/1", "openlibrary.org")]),
    ("openlibrary", "", {"title": "T", "author_name": []}, []),
    ("musicbrainz", "", {"id": "i", "title": "T", "artist-credit": [{"name": "n", "artist": {"name": "A"}}]}, [("Registro musical: «T», interpretada por A.", "https://musicbrainz.org/recording/i", "musicbrainz.org")]),
    ("letras", "letra de 'Sol' de Luna?", {"lyrics": LONG}, [(f"Letra de «Sol» (Luna): {LONG}", "https://api.lyrics.ovh/v1/Luna/Sol", "lyrics.ovh")]),
    ("letras", "something else", {"lyrics": LONG}, []),
]
EXPECTED = [(n, name, pos, *row) for n, (name, _, _, rows) in enumerate(CASES) for pos, row in enumerate(rows)]
SAYINGS = [("El agua no es azul", "El agua es azul"), ("Water is not blue", "Water is blue"), ("El agua es azul", "El agua no es azul"), ("Water is blue and it is wet", "Water is not blue and it is wet"), ("Nada", None)]


def found(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], f"n int, {schema}").orderBy("n").select(*columns).collect()]


def test_model_replies(spark):
    reply = F.col("reply")
    told = found(spark, [r[:1] for r in REPLIES], "reply string", replies.omission(reply), replies.verdict(reply), F.array_join(replies.questions(reply, 3), "|"))
    assert told == [r[1:] for r in REPLIES]


def test_model_actions(spark):
    assert found(spark, [r[:1] for r in ACTIONS], "reply string", replies.actions("reply").alias("a")) == [(r[1:],) for r in ACTIONS]


def test_code_runs(spark):
    assert found(spark, [r[:1] for r in PASSAGES], "passage string", replies.code_run(F.col("passage"))) == [r[1:] for r in PASSAGES]


def test_answer_citations(spark):
    cited = replies.cited(F.col("answer"))
    told = found(spark, [r[:1] for r in ANSWERS], "answer string", F.array_join(replies.body(F.col("answer")), "|"), F.array_join(cited["primary"], ","), F.array_join(cited["secondary"], ","))
    assert told == [r[1:] for r in ANSWERS]


def test_follow_ups(spark):
    assert found(spark, [r[:2] for r in TURNS], "turn string, before string", replies.follow_up(F.col("turn"), F.col("before"), grouping.key_terms(F.col("before")))) == [r[2:] for r in TURNS]


def test_angles(spark):
    shown = F.array_join(F.transform(replies.angles(F.col("fact"), F.col("others"), 3), lambda a: F.concat(a["kind"], F.lit(":"), a["query"])), "|")
    assert found(spark, [r[:2] for r in FACTS], "fact string, others array<string>", shown) == [r[2:] for r in FACTS]


def test_accents(spark):
    assert found(spark, [r[:1] for r in SPELLED], "text string", replies.accents(F.col("text"))) == [r[1:] for r in SPELLED]


def test_computed_answers(spark):
    assert found(spark, [r[:1] for r in COMPUTED], "question string", replies.computed_answers(F.col("question"), F.lit(NOW))) == [r[1:] for r in COMPUTED]


def test_negations(spark):
    assert found(spark, [r[:1] for r in SAYINGS], "text string", text.negation(F.col("text"))) == [r[1:] for r in SAYINGS]


def test_sums():
    assert [value(x) for x in ("2 + 3 * 4", "-(7 - 10) ** 2", "10 / 4 % 2", "__import__('os')", "1 / 0")] == [14.0, -9.0, 0.5, None, None]


def test_file_orders(spark):
    assert found(spark, [r[:1] for r in SAID], "said string", replies.file_order(F.col("said"), ORDERS).alias("o")) == [(None if r[1] is None else r[1:],) for r in SAID]


def test_wikidata_dates_and_indexes(spark):
    times = [("+1960-10-01T00:00:00Z", 11, "1960-10-01"), ("+1960-10-00T00:00:00Z", 10, "1960-10"), ("+1960-00-00T00:00:00Z", 9, "1960"), ("-0044-03-15T00:00:00Z", 11, "0044-03-15"), ("-0044-00-00T00:00:00Z", 9, "-44"), ("", 11, None)]
    assert found(spark, [r[:2] for r in times], "time string, precision int", registry.wikidata_date(F.col("time"), F.col("precision"))) == [r[2:] for r in times]
    index = [({"hierve": [1], "El": [0], "a": [2], "100": [3], "grados.": [4]},), ({"la": [0, 2], "de": [1], "casa": [3]},)]
    assert found(spark, index, "words map<string,array<int>>", registry.from_inverted_index(F.col("words"))) == [("El hierve a 100 grados.",), ("la de la casa",)]


def test_source_payloads(spark):
    """Records of every source as evidence."""
    rows = [(s, n, asked, "", r if isinstance(r, str) else json.dumps(r)) for n, (s, asked, r, _) in enumerate(CASES)]
    told = payloads.render(spark.createDataFrame(rows, "source string, n int, query string, lang string, payload string"))
    assert {(r.n, r.source, r.pos, r.text, r.url, r.domain) for r in told.collect()} == set(EXPECTED)
