"""Which of many words stand in a text, within longer words too: one pass over the text for all words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

try:
    import ahocorasick
except ImportError:
    ahocorasick = None


@lru_cache(maxsize=2)
def finder(words: tuple[str, ...]) -> Callable[[str], list[str]]:
    """A function from a text to those of words that it contains, sorted."""
    if ahocorasick is None or not words:
        return lambda text: [w for w in words if w in text]
    automaton = ahocorasick.Automaton()
    for w in words:
        automaton.add_word(w, w)
    automaton.make_automaton()
    return lambda text: sorted({w for _, w in automaton.iter(text)})


def occurring(df: DataFrame, column: str, words: list[str]) -> DataFrame:
    """df without `column` (a lower-case text), with the array `occurring`. words: a query set, broadcast."""
    seen = df.sparkSession.sparkContext.broadcast(tuple(sorted(w for w in words if w)))
    kept = [f for f in df.schema.fields if f.name != column]
    schema = T.StructType([*kept, T.StructField("occurring", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(seen.value)
        for batch in batches:
            found = [find(t or "") for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(found, pa.list_(pa.string()))], names=[*(f.name for f in kept), "occurring"])

    return df.mapInArrow(run, schema)
