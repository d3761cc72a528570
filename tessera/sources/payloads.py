"""How records of the evidence sources become evidence: one table of expressions, no code for each source.

A payload is a row (source, n, query, lang, payload): a record as the source's interface delivers it, JSON or XML.
With payloads partitioned by source, each branch of render() reads its own partition only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as shaping


@dataclass(frozen=True)
class Record:
    """A source's record: its schema, and SQL over its fields (and _query, _lang) for the parts of evidence."""

    schema: str
    texts: str  # an array
    url: str
    title: str
    domain: str
    family: str
    needed: str = "true"
    least: int = 40
    most: int = 1000
    chunks: int = 0  # an abstract gives its first passages; 0: texts stand whole
    lang: str = "'en'"
    xml: bool = False


def squeezed(field: str) -> str:
    return rf"trim(regexp_replace({field}, '\\s+', ' '))"


def untagged(field: str) -> str:
    return f"regexp_replace(coalesce({field}, ''), '<[^>]+>', ' ')"


def abstract(schema: str, text: str, url: str, title: str, domain: str, **more) -> Record:
    return Record(schema, f"array({text})", url, title, domain, "academica", most=1 << 30, chunks=2, lang="''", **more)


def excerpts(domain: str) -> Record:
    return Record("question_id long, title string, excerpt string", f"array(trim({untagged('excerpt')}))", f"concat('https://{domain}/q/', question_id)", "title", domain, "stackexchange", needed="question_id <> 0")


OLD_INDEX = "array_join(transform(array_sort(flatten(transform(map_entries(abstract_inverted_index), e -> transform(e.value, p -> struct(p AS p, e.key AS w))))), x -> x.w), ' ')"
ENGLISH = "get(filter(cve.descriptions, d -> d.lang = 'en'), 0).value"
OPINION = squeezed("coalesce(get(filter(opinions, o -> o.snippet <> ''), 0).snippet, '')")
ARTISTS = "coalesce(nullif(array_join(filter(transform(`artist-credit`, a -> a.artist.name), x -> x <> ''), ', '), ''), array_join(transform(`artist-credit`, a -> a.name), ', '))"
STUDY = "protocolSection"
# How a query names a song and its singer.
LYRICS = r"""(?i)letra de [\'"«]?(.+?)[\'"»]? de (.+)$|lyrics? (?:of|to) [\'"]?(.+?)[\'"]? by (.+)$"""


def _named(first: int, second: int) -> str:
    pattern = LYRICS.replace("\\", "\\\\").replace("\\\\'", "\\'")
    return f"concat(regexp_extract(_query, '{pattern}', {first}), regexp_extract(_query, '{pattern}', {second}))"


SONG, SINGER = f"trim({_named(1, 3)})", f"trim(BOTH ' ?.' FROM {_named(2, 4)})"

# Schemas, wording, addresses and least lengths of each source's records.
RECORDS: dict[str, Record] = {
    "web": Record("href string, title string, body string", "array(body)", "href", "coalesce(title, href)", "", "web", needed="href <> ''", most=1 << 30, lang="_lang"),
    "stackexchange": excerpts("stackoverflow.com"),
    "stackexchange-matematicas": excerpts("math.stackexchange.com"),
    "semantic-scholar": abstract("title string, abstract string, url string", "abstract", "coalesce(nullif(url, ''), 'https://www.semanticscholar.org')", "title", "semanticscholar.org"),
    "openalex": abstract("title string, doi string, abstract_inverted_index map<string,array<int>>", OLD_INDEX, "coalesce(nullif(doi, ''), 'https://openalex.org')", "title", "openalex.org"),
    "arxiv": abstract("id string, title string, summary string", squeezed("summary"), "coalesce(nullif(trim(id), ''), 'https://arxiv.org')", "trim(title)", "arxiv.org", xml=True),
    "crossref": abstract("title array<string>, abstract string, DOI string", squeezed(untagged("abstract")), "coalesce('https://doi.org/' || nullif(DOI, ''), 'https://www.crossref.org')", "get(title, 0)", "crossref.org"),
    "europepmc": abstract("id string, source string, title string, abstractText string", "abstractText", "concat('https://europepmc.org/article/', coalesce(source, 'MED'), '/', coalesce(id, ''))", "title", "europepmc.org"),
    "nvd": Record("cve struct<id:string,descriptions:array<struct<lang:string,value:string>>>", f"array(concat(cve.id, ': ', {ENGLISH}))", "concat('https://nvd.nist.gov/vuln/detail/', cve.id)", "cve.id", "nvd.nist.gov", "docs-oficiales", needed=f"cve.id <> '' AND length({ENGLISH}) >= 40"),
    "tribunales": Record("caseName string, court string, dateFiled string, absolute_url string, opinions array<struct<snippet:string>>", f"array(trim(concat(caseName, '. ', coalesce(court, ''), ', ', coalesce(dateFiled, ''), '. ', {OPINION})))", "concat('https://www.courtlistener.com', coalesce(absolute_url, ''))", "caseName", "courtlistener.com", "tribunales", needed="caseName <> ''"),
    "openfda": Record("openfda struct<brand_name:array<string>>, indications_and_usage array<string>, warnings array<string>, dosage_and_administration array<string>", "transform(array(indications_and_usage, warnings, dosage_and_administration), f -> get(f, 0))", "'https://open.fda.gov'", "concat('FDA label: ', coalesce(get(openfda.brand_name, 0), '?'))", "fda.gov", "docs-oficiales"),
    "clinicaltrials": Record(f"{STUDY} struct<identificationModule:struct<nctId:string,briefTitle:string>,descriptionModule:struct<briefSummary:string>,statusModule:struct<overallStatus:string>>", f"array(concat({STUDY}.descriptionModule.briefSummary, ' Status: ', coalesce({STUDY}.statusModule.overallStatus, 'unknown'), '.'))", f"concat('https://clinicaltrials.gov/study/', coalesce({STUDY}.identificationModule.nctId, ''))", f"{STUDY}.identificationModule.briefTitle", "clinicaltrials.gov", "docs-oficiales", needed=f"length({STUDY}.descriptionModule.briefSummary) >= 40"),
    "hackernews": Record("objectID string, title string, story_text string", "array(trim(BOTH '. ' FROM concat(coalesce(title, ''), '. ', coalesce(story_text, ''))))", "concat('https://news.ycombinator.com/item?id=', coalesce(objectID, ''))", "left(title, 120)", "news.ycombinator.com", "posts", least=30),
    "reddit": Record("data struct<title:string,selftext:string,permalink:string>", "array(trim(BOTH '. ' FROM concat(coalesce(data.title, ''), '. ', coalesce(data.selftext, ''))))", "concat('https://www.reddit.com', coalesce(data.permalink, ''))", "left(data.title, 120)", "reddit.com", "posts", lang="coalesce(nullif(_lang, ''), 'en')"),
    "openlibrary": Record("title string, author_name array<string>, first_publish_year int, key string", "array(concat('Registro bibliográfico: «', title, '», de ', array_join(author_name, ', '), coalesce(', publicado por primera vez en ' || nullif(first_publish_year, 0), ''), '.'))", "concat('https://openlibrary.org', coalesce(key, ''))", "left(title, 120)", "openlibrary.org", "academica", needed="title <> '' AND array_join(author_name, ', ') <> ''", least=0, most=1 << 30),
    "musicbrainz": Record("id string, title string, `first-release-date` string, `artist-credit` array<struct<name:string,artist:struct<name:string>>>", f"array(concat('Registro musical: «', title, '», interpretada por ', {ARTISTS}, coalesce(', primera publicación ' || nullif(`first-release-date`, ''), ''), '.'))", "concat('https://musicbrainz.org/recording/', coalesce(id, ''))", "left(title, 120)", "musicbrainz.org", "academica", needed=f"title <> '' AND {ARTISTS} <> ''", least=0, most=1 << 30),
    "letras": Record("lyrics string", f"array(concat('Letra de «', {SONG}, '» (', {SINGER}, '): ', left(lyrics, 800)))", f"concat('https://api.lyrics.ovh/v1/', {SINGER}, '/', {SONG})", f"concat('letra: ', {SONG})", "lyrics.ovh", "web", needed=f"{SONG} <> '' AND {SINGER} <> '' AND length(lyrics) >= 40", least=0, most=1 << 30, lang="coalesce(nullif(_lang, ''), 'en')"),
}

#: The suffix of a query that looks for fact checks, by language; another language's is the last one.
# Fixed values.
FACT_CHECK = {"es": "verificación bulo fact check", "fr": "vérification des faits fact check", "de": "Faktencheck fact check", "pt": "verificação de fatos checagem", "it": "verifica dei fatti fact check", "en": "fact check"}
# Official documentation by topic, and how many of a topic's domains a query names.
DOCUMENTATION = {
    "programacion": "docs.python.org developer.mozilla.org docs.aws.amazon.com learn.microsoft.com kubernetes.io man7.org docs.docker.com en.cppreference.com doc.rust-lang.org nodejs.org pkg.go.dev".split(),
    "matematicas": "mathworld.wolfram.com encyclopediaofmath.org proofwiki.org oeis.org dlmf.nist.gov".split(),
}
NAMED = 6


def fact_check_query(query: Column, lang: Column) -> Column:
    out = F.lit(FACT_CHECK["en"])
    for name, suffix in FACT_CHECK.items():
        out = F.when(lang == name, suffix).otherwise(out)
    return F.concat(query, F.lit(" "), out)


def documentation_query(query: Column, topic: Column) -> Column:
    """The query, bound to the topic's documentation; null for a topic without any."""
    out = F.lit(None).cast("string")
    for name, domains in DOCUMENTATION.items():
        sites = " OR ".join(f"site:{d}" for d in domains[:NAMED])
        out = F.when(topic == name, F.concat(query, F.lit(f" ({sites})"))).otherwise(out)
    return out


def _evidence(payloads: DataFrame, name: str, record: Record) -> DataFrame:
    rows = payloads.where(F.col("source") == name)
    parsed = (F.from_xml if record.xml else F.from_json)(F.col("payload"), record.schema)
    rows = rows.select(F.col("n").alias("_n"), F.col("query").alias("_query"), F.coalesce("lang", F.lit("")).alias("_lang"), parsed.alias("_r")).select("_n", "_query", "_lang", "_r.*")
    rows = rows.where(record.needed).select("_n", F.expr(record.texts).alias("texts"), F.expr(record.url).alias("url"), F.expr(record.title).alias("title"), F.expr(record.lang).alias("lang"))
    long = F.filter("texts", lambda t: F.length(t) >= record.least)
    if record.chunks:
        long = F.flatten(F.transform(long, lambda t: F.slice(shaping.pack(t), 1, record.chunks)))
    cut = F.transform(long, lambda t: F.substring(t, 1, record.most))
    domain = F.lit(record.domain) if record.domain else shaping.domain(F.col("url"))
    return rows.select(F.lit(name).alias("source"), F.col("_n").alias("n"), F.posexplode(cut).alias("pos", "text"), "url", F.coalesce("title", F.lit("")).alias("title"), domain.alias("domain"), F.lit(record.family).alias("family"), "lang")


def render(payloads: DataFrame, records: dict[str, Record] | None = None) -> DataFrame:
    """source, n, pos, text, url, title, domain, family and lang; records that lack what their source needs give nothing."""
    return reduce(DataFrame.unionByName, [_evidence(payloads, name, r) for name, r in (RECORDS if records is None else records).items()])


def ranked_passages(query: Column, page: Column, most: int = 3, least: int = 40) -> Column:
    """The page's passages with most of the query's words, best first; short ones among them leave a gap.

    All within a row: no shuffle.
    """
    return F.filter(F.transform(F.slice(scored_passages(query, page), 1, most), lambda x: x["passage"]), lambda p: F.length(p) >= least)


def scored_passages(query: Column, page: Column) -> Column:
    scored = lambda words: F.transform(shaping.pack(page), lambda p, i: F.struct((-shaping.relevance(words, p)).alias("worse"), i.alias("place"), p.alias("passage")))
    return F.array_sort(shaping.let(shaping.content_words(query), scored))


# Properties that are told, in this order.
PROPERTIES = {"P569": "date of birth", "P570": "date of death", "P571": "inception", "P580": "start time", "P582": "end time", "P585": "point in time", "P39": "position held", "P27": "country of citizenship", "P1082": "population"}


def entity_facts(entities: DataFrame, statements: DataFrame, labels: DataFrame) -> DataFrame:
    """qid and text: of each entity (qid, label, description) the first statement of each property.

    statements: qid, property, place, time, precision, amount, target; labels: qid, label of the targets.
    """
    from tessera.sources.registry import wikidata_date

    first = statements.groupBy("qid", "property").agg(F.min_by(F.struct("time", "precision", "amount", "target"), "place").alias("s")).select("qid", "property", "s.*")
    named = first.join(labels.select(F.col("qid").alias("target"), F.col("label").alias("named")), "target", "left")
    value = F.when(F.col("time").isNotNull(), wikidata_date(F.col("time"), F.col("precision"))).when(F.col("amount").isNotNull(), F.regexp_replace("amount", r"^\++", "")).otherwise(F.col("named"))
    place = F.array_position(F.lit(list(PROPERTIES)), F.col("property"))
    words = F.create_map(*(F.lit(x) for pair in PROPERTIES.items() for x in pair))[F.col("property")]
    told = named.select("qid", place.alias("k"), words.alias("words"), value.alias("value")).where("k > 0 AND value <> ''")
    joined = told.join(entities, "qid").withColumn("sentence", F.concat("label", F.lit(" "), "words", F.lit(": "), "value", F.lit(".")))
    grouped = joined.groupBy("qid").agg(F.first("label").alias("label"), F.first("description").alias("d"), F.array_sort(F.collect_list(F.struct("k", "sentence"))).alias("all"))  # nine at most
    body = F.array_join(F.transform("all", lambda x: x["sentence"]), " ")
    return grouped.select("qid", F.when(F.coalesce("d", F.lit("")) != "", F.concat("label", F.lit(" ("), "d", F.lit("). "), body)).otherwise(body).alias("text"))
