"""The registry of evidence sources as a dimension, and how some sources' payloads become text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts of a batch that are Python objects at a time.
ROWS = 256

# Sources with the topics that they are asked for; none: asked for every topic.
SOURCES: list[tuple[str, list[str] | None]] = [
    ("wikipedia", None), ("wikipedia-multilingue", None), ("wikinews", ["actualidad", "general"]), ("wikiquote", ["actualidad", "general"]),
    ("wikidata", None), ("wikisource", ["actualidad", "general"]), ("wiktionary", ["general"]), ("tribunales", ["actualidad"]),
    ("nvd", ["programacion"]), ("gdelt", ["actualidad"]), ("web", None), ("hackernews", ["actualidad", "general", "programacion"]),
    ("reddit", ["actualidad", "general"]), ("openlibrary", ["general"]), ("musicbrainz", ["general", "actualidad"]), ("letras", ["general"]),
    ("desmentidos", None), ("docs-programacion", ["programacion"]), ("docs-matematicas", ["matematicas"]), ("stackexchange", ["programacion"]),
    ("stackexchange-matematicas", ["matematicas"]), ("semantic-scholar", None), ("openalex", None), ("arxiv", ["ciencia", "programacion", "matematicas"]),
    ("crossref", ["ciencia", "medicina", "matematicas"]), ("europepmc", ["medicina", "ciencia"]), ("openfda", ["medicina"]), ("clinicaltrials", ["medicina"]),
]


def frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, c is None, c or []) for n, c in SOURCES], "source string, universal boolean, categories array<string>")


def values_sql() -> str:
    return ", ".join(f"('{n}', {str(c is None).lower()}, {c or []}::VARCHAR[])" for n, c in SOURCES)


@F.arrow_udf(T.MapType(T.StringType(), T.ArrayType(T.IntegerType())))
def inverted_index(words: pa.Array) -> pa.Array:
    """A map from a text's words (an array) to their positions, text by text, so that nothing is shuffled."""

    def of(text: list[str] | None) -> list[tuple[str, list[int]]] | None:
        if text is None:
            return None
        places: dict[str, list[int]] = {}
        for n, w in enumerate(text):
            places.setdefault(w, []).append(n)
        return list(places.items())

    kind = pa.map_(pa.string(), pa.list_(pa.int32()))
    parts = [pa.array([of(t) for t in words.slice(n, ROWS).to_pylist()], kind) for n in range(0, len(words), ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def from_inverted_index(words: Column) -> Column:
    """The text of a map from words to their positions."""
    placed = F.flatten(F.transform(F.map_entries(words), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.sort_array(placed), lambda x: x["w"]), " ")


def wikidata_date(time: Column, precision: Column) -> Column:
    part = lambda n: F.regexp_extract(time, r"^([+-])(\d+)-(\d+)-(\d+)", n)
    year = F.concat(F.when(part(1) == "-", "-").otherwise(""), F.regexp_replace(part(2), r"^0+(?=\d)", ""))
    return F.when(part(2) == "", F.lit(None)).when(precision <= 9, year).when(precision == 10, F.concat_ws("-", part(2), part(3))).otherwise(F.concat_ws("-", part(2), part(3), part(4)))
