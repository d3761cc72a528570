"""Text shaping as Columns: sentences, words, lexical relevance, domains, markup, fingerprints, language."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts of a batch that are Python objects at a time.
ROWS = 256

# What a sentence must have to be a checkable statement.
LEAST_CHARACTERS = 8
OPINION = r"\b(creo|opino|pienso|me parece|deber[íi]a[ns]?|ojal[áa]|quiz[áa]s?|tal vez|i think|i believe|should|maybe|perhaps)\b"

# Topics and their patterns, in order.
TOPICS = {
    "programacion": r"\b(c[oó]digo|software|program|bug|compil|python|javascript|api|framework|servidor|kernel|linux|windows|sql|git|funci[oó]n|variable|libre?r[ií]a|aws|azure|gcp|kubernetes|k8s|docker|terraform|kubectl|bash|shell|comando|command.line|deploy|devops|s3|ec2)\b",
    "matematicas": r"\b(integral|derivad\w*|ecuaci[oó]n|equation|teorema|theorem|matriz|matrix|primo?s? (number|n[uú]mero)|n[uú]mero primo|polinomio|polynomial|algebra|c[aá]lculo|calculus|geometr[ií]a|probabilidad|probability|factorial|logaritmo|logarithm)\b",
    "medicina": r"\b(vacuna|virus|c[aá]ncer|cancer|enfermedad|s[ií]ntoma|medicamento|tratamiento|vaccine|disease|drug|dosis|cl[ií]nic|hospital|salud|health|covid|diabetes|heart|coraz[oó]n|infarto|cardio|aspirin|aspirina|cirug[ií]a|surgery|tumor|terapia|therapy|s[ií]ndrome|syndrome|m[eé]dic\w*|medical|colesterol|cholesterol)\b",
    "ciencia": r"\b(estudio|study|investigaci[oó]n|research|f[ií]sica|qu[ií]mica|biolog|clima|climate|energ[ií]a|planeta|nasa|especie|gen[eé]tic|quantum|cu[aá]ntic)\b",
    "actualidad": r"\b(presidente|president|gobierno|government|elecci[oó]n|election|ministr|congreso|senador|senator|ley|pol[ií]tic|guerra|war|tratado|alcalde|partido)\b",
}

# Frequent function words of each language.
FUNCTION_WORDS = {
    "es": "el la los las es de que y en un una no se del con para por como más pero su al lo está son qué cuál dónde",
    "en": "the is are was were of and to in that it with for on this not have has from by an what which where who does",
    "de": "der die das ist sind und nicht ein eine mit von zu auf für im den dem des steht sich auch wird bei aus nach was wo wer wie",
    "fr": "le la les est sont et de des du un une dans pour pas que qui avec sur au aux ce cette il elle ne en où quoi",
    "pt": "o a os as é são de do da dos das e em um uma não que com para por no na se mais está qual onde",
    "it": "il lo la i gli le è sono di che e in un una non con per del della si più anche questo questa cosa dove",
}

# Words that do not name a topic.
STOPWORDS = (
    "para como cómo donde dónde cuando cuándo cual cuál quien quién sobre entre hasta desde porque aunque según segun sirve funciona "
    "significa contexto what where when which about does mean work bajo baja bajos bajas alto alta altos altas grande grandes largo larga "
    "solo sola nuevo nueva mediante general gran cada otro otra misma mismo"
).split()

# Words of a request that name no topic.
GENERIC = (
    "tienes tendrias dame muestrame ensename ponme hazme puedes podrias sabes muestras ensenas pones haces ejemplo ejemplos codigo muestra "
    "caso casos demo otro otra otros otras have could show give tell example examples code sample another"
).split()

# How questions, requests to the agent, rejections of an answer and follow-ups begin.
ASKS = r"^\s*(¿|qu[eé]\b|qui[eé]n|d[oó]nde|cu[aá]ndo|cu[aá]l|cu[aá]nt[oa]s?\b|c[oó]mo\b|por qu[eé]|para qu[eé]|what\b|who\b|where\b|when\b|which\b|how\b|why\b)"
REQUEST = r"^\s*¿?\s*(tienes|tendr[ií]as|dame|mu[eé]strame|ens[eé][ñn]ame|ponme|hazme|me (das|puedes|podr[ií]as|muestras|ense[ñn]as|pones|haces)|puedes|podr[ií]as|sabes|do you have|can you|could you|show me|give me|tell me)\b"
REJECTION = r"^\s*¿?\s*(no[,.]?\s*(no\s*)?(es|era)\s*(esa?|ese|eso)?|esa? no|ese no|otra( vez)?|dame otra|busca otra|not (that|this) one|another one|wrong)\s*[\.\!\?]*\s*$"
CONNECTOR = r"^\s*¿?\s*(y|pero|entonces|adem[aá]s|o sea|and|but|so|also)\b|^\s*¿?\s*(en|dentro de) (el|ese|este|dicho) (contexto|caso|sentido)\b|^\s*¿?\s*(qu[eé] tal|y si)\b"
DEICTIC = r"\b(eso|esto|aquello|ese|esa|este|esta|[eé]l|ella|ellos|ellas|ah[ií]|that|this|it|there)\b"
SOCIAL = r"^\s*(hola|buenas( noches| tardes| d[ií]as)?|hey|hi|hello|gracias|muchas gracias|thank you|thanks|ty|ok(ay)?|vale|perfecto|genial|entendido|listo|good|great|nice|adi[oó]s|hasta luego|chao|bye|nos vemos)\s*[\.\!]*\s*$"

# Verbs that take a negation.
VERBS_ES = "es|era|fue|son|eran|fueron|está|estaba|están|estaban|tiene|tenía|tienen|hay|existe|existen"
VERBS_EN = "is|was|are|were|has|have|had|does|do|did|can|will"


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value), with value computed once for a row however often fn names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def strip(text: Column) -> Column:
    """text without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentences(text: Column, marks: str = ".!?;") -> Column:
    """Pieces of the stripped text that end with one of marks before white space."""
    return F.split(strip(text), rf"(?<=[{marks}])\s+")


def first_sentence(text: Column, marks: str = ".!?;") -> Column:
    """The first of sentences(); the rest of the text is not cut."""
    return F.get(F.split(strip(text), rf"(?<=[{marks}])\s+", 2), F.lit(0))


def checkable(sentence: Column) -> Column:
    return (F.length(sentence) >= LEAST_CHARACTERS) & ~sentence.startswith("¿") & ~sentence.endswith("?") & ~sentence.rlike(f"(?iu){OPINION}")


def facts(claim: Column) -> Column:
    """Checkable sentences without their final dots; the whole claim if there is none."""
    found = F.transform(F.filter(sentences(claim), checkable), lambda s: F.regexp_replace(s, r"\.+$", ""))
    return F.when(F.size(found) > 0, found).otherwise(F.array(strip(claim)))


def pack(text: Column, most: int = 600) -> Column:
    """Sentences packed greedily into passages of about `most` characters; a longer sentence stays whole."""
    empty = F.struct(F.lit([]).cast("array<string>").alias("out"), F.lit("").alias("now"))

    def step(acc: Column, sentence: Column) -> Column:
        full = (acc["now"] != "") & (F.length(acc["now"]) + F.length(sentence) > most)
        joined = F.when(acc["now"] == "", sentence).otherwise(F.concat(acc["now"], F.lit(" "), sentence))
        return F.struct(F.when(full, F.concat(acc["out"], F.array(acc["now"]))).otherwise(acc["out"]).alias("out"), F.when(full, sentence).otherwise(joined).alias("now"))

    return F.aggregate(sentences(text, ".!?"), empty, step, lambda acc: F.when(acc["now"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["now"]))))


# What a line of code looks like.
CODE_LINE = r"^\s{4,}\S|^\s*(for|while|def|class|import|from|if|print|return|let|const|var)\b|=\s*\[|\.append\(|=>|;\s*$"


def answering(text: Column) -> Column:
    """Sentences of 25 to 300 characters that ask nothing and are no code."""
    return F.filter(sentences(text, ".!?»"), lambda s: F.length(s).between(25, 300) & ~s.endswith("?") & ~s.rlike(CODE_LINE))


def chunks(text: Column, most: int = 1500, tail: int = 400) -> Column:
    """Passages of about `most` characters, without a last one of `tail` or fewer."""
    packed = pack(text, most)
    short = F.length(F.try_element_at(packed, F.lit(-1))) <= tail
    return F.when(short, F.slice(packed, 1, F.size(packed) - 1)).otherwise(packed)


def paragraphs(text: Column, most: int = 800, least: int = 40) -> Column:
    """Paragraphs, white space collapsed, packed into pieces of about `most` characters; pieces under `least` go."""
    each = F.filter(F.transform(F.split(text, "\n\n"), lambda p: strip(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    none = F.lit([]).cast("array<string>")
    start = F.struct(none.alias("out"), none.alias("now"), F.lit(0).alias("size"))

    def step(acc: Column, paragraph: Column) -> Column:
        full = (acc["size"] + F.length(paragraph) > most) & (F.size(acc["now"]) > 0)
        out = F.when(full, F.concat(acc["out"], F.array(F.array_join(acc["now"], "\n")))).otherwise(acc["out"])
        now = F.when(full, F.array(paragraph)).otherwise(F.concat(acc["now"], F.array(paragraph)))
        return F.struct(out.alias("out"), now.alias("now"), (F.when(full, 0).otherwise(acc["size"]) + F.length(paragraph)).alias("size"))

    pieces = F.aggregate(each, start, step, lambda acc: F.concat(acc["out"], F.array(F.array_join(acc["now"], "\n"))))
    return F.filter(pieces, lambda p: F.length(p) >= least)


def composed(claim: Column, text: Column) -> Column:
    """No single sentence of text has all but one of the claim's words of five letters; short claims are not composed."""
    words = content_words(claim, 5)
    copied = F.exists(F.split(F.lower(text), r"(?<=[.!?])\s+"), lambda s: F.size(F.filter(words, lambda w: F.contains(s, w))) >= F.size(words) - 1)
    return (F.size(words) >= 3) & ~copied


def content_words(text: Column, least: int = 4) -> Column:
    """Distinct lower-case words of at least `least` letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"(?U)\w{{{least},}}"), F.lit(0)))


def relevance(words: Column, passage: Column) -> Column:
    """How many of words stand somewhere in passage, within longer words too."""
    return let(F.lower(passage), lambda low: F.size(F.filter(words, lambda w: F.contains(low, w))))


def probative(fact: Column, passage: Column, foreign: Column | None = None) -> Column:
    """A passage says something of a fact if it has two of its content words; short facts and passages in another language need none."""
    found = let(content_words(fact), lambda words: (F.size(words) < 3) | (relevance(words, passage) >= 2))
    return found if foreign is None else foreign | found


def domain(url: Column, default: str = "") -> Column:
    """The authority in lower case, with its port, without one leading www."""
    found = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))), r"^www\.", "")
    return F.when(found == "", F.lit(default)).otherwise(found)


def strip_markup(html: Column) -> Column:
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return strip(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"\s+", " "))


def fingerprint(url: Column, text: Column, digits: int = 24) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", url, text), 256), 1, digits)


def topic(text: Column) -> Column:
    """The first topic whose pattern occurs; general if none."""
    out = F.lit("general")
    for name, pattern in reversed(TOPICS.items()):
        out = F.when(text.rlike(f"(?iu){pattern}"), F.lit(name)).otherwise(out)
    return out


def is_question(text: Column) -> Column:
    clean = strip(text)
    first = F.regexp_extract(clean, r"^\S+", 0)
    acronym = (F.upper(first) == first) & (F.lower(first) != first) & (F.length(first) > 2)
    short = F.length(clean) < 140
    return F.when(clean.endswith("?"), True).when(acronym, False).when(clean.rlike(f"(?iU){REQUEST}") & short, True).otherwise(clean.rlike(f"(?iU){ASKS}") & short & ~clean.endswith("."))


def key_terms(text: Column, most: int = 4) -> Column:
    """The first distinct words of four letters or more that name a topic, as they are written."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)\w{4,}"), F.lit(0))

    def step(kept: Column, word: Column) -> Column:
        # Time in proportion to the text: a word meets the few kept ones, and none once they are enough.
        new = (F.size(kept) < most) & ~F.lower(word).isin(STOPWORDS) & ~F.exists(kept, lambda k: F.lower(k) == F.lower(word))
        return F.when(new, F.concat(kept, F.array(word))).otherwise(kept)

    return F.aggregate(words, F.lit([]).cast("array<string>"), step)


def elliptic(text: Column) -> Column:
    """A short request that names no topic of its own."""
    bare = lambda w: F.translate(F.lower(w), "áéíóúüñ", "aeiouun")
    return (F.length(text) < 60) & text.rlike(f"(?iU){REQUEST}") & F.forall(key_terms(text), lambda w: bare(w).isin(GENERIC))


def dialogue_act(text: Column) -> Column:
    """social, rejection, follow_up, question or claim, in this order."""
    clean = strip(text)
    size = F.length(clean)
    follow = clean.rlike(f"(?iU){CONNECTOR}") | ((size < 60) & clean.rlike(f"(?iU){DEICTIC}")) | elliptic(clean)
    return (
        F.when((size <= 40) & clean.rlike(f"(?iU){SOCIAL}"), "social")
        .when((size < 40) & clean.rlike(f"(?iU){REJECTION}"), "rejection")
        .when(follow, "follow_up")
        .when(is_question(text), "question")
        .otherwise("claim")
    )


# How a request for work begins, and the least length of one.
TASK, TASK_LEAST = (
    r"^\s*(resume|res[uú]meme|analiza|compara|genera|redacta|elabora|prepara|organiza|revisa|corrige|traduce|convierte|extrae|arma|construye"
    r"|dise[ñn]a|programa|implementa|escribe (un|una|el|la)|crea (un|una)|haz (un|una|el|la))(?![\p{L}\p{N}_])"
), 12


def task(text: Column) -> Column:
    """The text if it asks for work, and not for an answer; else null."""
    clean = strip(text)
    asks = (F.length(clean) >= TASK_LEAST) & ~clean.endswith("?") & ~is_question(clean) & clean.rlike(f"(?iu){TASK}")
    return F.when(asks, clean)


def negation(text: Column) -> Column:
    """The claim negated, or affirmed if it was negated, at the first place that fits; null if none fits."""
    out = F.lit(None).cast("string")
    rules = [(rf"\bno\s+({VERBS_ES})\b", "{0}"), (rf"\b({VERBS_EN})\s+not\b", "{0}"), (rf"\b({VERBS_ES})\b", "no {0}"), (rf"\b({VERBS_EN})\b", "{0} not")]
    for pattern, form in reversed(rules):
        whole = rf"(?isU)^(.*?){pattern}(.*)$"
        before, after = form.split("{0}")
        new = F.concat(F.regexp_extract(text, whole, 1), F.lit(before), F.regexp_extract(text, whole, 2), F.lit(after), F.regexp_extract(text, whole, 3))
        out = F.when(text.rlike(f"(?iU){pattern}"), new).otherwise(out)
    return out


def jaccard(a: Column, b: Column) -> Column:
    """Common share of two texts' words."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"(?U)\w+"), F.lit(0)))
    return F.size(F.array_intersect(words(a), words(b))) / F.greatest(F.size(F.array_union(words(a), words(b))), F.lit(1))


def elide(text: Column, most: int = 1500) -> Column:
    """A long text without its middle."""
    half = most // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, half), F.lit(" … "), F.substring(text, -half, half)))


def plain(text: pd.Series) -> pd.Series:
    """Case-folded, without accents, white space collapsed."""
    return text.map(lambda t: None if t is None else " ".join("".join(c for c in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(c)).split()))


@F.arrow_udf(T.StringType())
def plain_key(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """plain() on a column: Spark has no Unicode normal forms. Few of a batch's texts are Python objects at a time."""
    for text in texts:
        parts = [pa.array(plain(pd.Series(text.slice(n, ROWS).to_pylist(), dtype=object)), pa.string()) for n in range(0, len(text), ROWS)]
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())
