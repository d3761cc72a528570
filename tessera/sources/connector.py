"""Sources behind a connector: queries go to them in tasks, their records come back as payloads.

`records` asks for the queries of a DataFrame. `data_source` makes the same a source of its own for
spark.read, each of whose partitions asks a slice of a list of queries. `polled_source` makes a source that grows
one for spark.readStream.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Takes a query and a language; gives the source's records, as it delivers them.
Fetch = Callable[[str, str], Iterable[dict]]
PAYLOADS = "source string, n long, query string, lang string, payload string"
TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]


def answered(fetch: Fetch, query: str, lang: str, every: float = 0.0) -> list[str]:
    """A source's records as JSON; a source that fails has none. every: seconds that a call takes at least."""
    began = time.monotonic()
    try:
        return [json.dumps(r, ensure_ascii=False) for r in fetch(query, lang)]
    except Exception:  # a source's failure costs its answer, not the job
        return []
    finally:
        time.sleep(max(0.0, began + every - time.monotonic()))


def records(queries: DataFrame, key: str, source: str, fetch: Fetch, every: float = 0.0) -> DataFrame:
    """Payloads of queries (key, query, lang), for payloads.render; n is the query's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, query, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = answered(fetch, query or "", lang or "", every)
                rows = [[x] * len(found) for x in (source, n, query, lang)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*rows, found], TYPES, strict=True)], names=["source", "n", "query", "lang", "payload"])

    return queries.select(F.col(key).cast("long").alias(key), "query", "lang").mapInArrow(run, PAYLOADS)


class Slice(InputPartition):
    def __init__(self, first: int, queries: list[str]) -> None:
        self.first, self.queries = first, queries


def data_source(name: str, fetch: Fetch, slice_size: int = 100) -> type[DataSource]:
    """A source for spark.dataSource.register; options: queries (a JSON array of strings) and lang."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]) -> None:
            self.queries, self.lang = json.loads(options["queries"]), options.get("lang", "")

        def partitions(self) -> list[InputPartition]:
            return [Slice(at, self.queries[at : at + slice_size]) for at in range(0, len(self.queries), slice_size)]

        def read(self, partition: Slice) -> Iterator[tuple]:
            for n, query in enumerate(partition.queries, partition.first):
                for payload in answered(fetch, query, self.lang):
                    yield name, n, query, self.lang, payload

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PAYLOADS

        def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
            return Reader(dict(self.options))

    return Source


class Span(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


def polled_source(name: str, newest: Callable[[], int], fetch: Callable[[int, int], Iterable[dict]], most: int = 10_000, slice_size: int = 100, failures: int = 3, rest: float = 300.0) -> type[DataSource]:
    """A source for spark.dataSource.register and spark.readStream whose records are numbered as they come: n long, payload string.

    newest tells how many there are; fetch gives those from a number up to another, in tasks. A batch has `most`
    at most. A poll that fails finds nothing new; after `failures` in a row the source is left alone for `rest` seconds. Offsets are record
    numbers, so that a batch that is run again asks for the same records, and a failing fetch is tried again by its task.
    """

    class Reader(DataSourceStreamReader):
        def __init__(self) -> None:
            self.known = self.failed = 0
            self.until = 0.0

        def initialOffset(self) -> dict:  # noqa: N802
            return {"n": 0}

        def latestOffset(self) -> dict:  # noqa: N802
            if time.monotonic() >= self.until:
                try:
                    self.known, self.failed = max(self.known, min(newest(), self.known + most)), 0
                except Exception:  # a source's failure costs its poll, not the stream
                    self.failed += 1
                    if self.failed >= failures:
                        self.failed, self.until = 0, time.monotonic() + rest
            return {"n": self.known}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            self.known = max(self.known, end["n"])  # after a restart the stream's own offset counts
            return [Span(at, min(at + slice_size, end["n"])) for at in range(start["n"], end["n"], slice_size)]

        def read(self, partition: Span) -> Iterator[tuple]:
            for n, record in enumerate(fetch(partition.start, partition.end), partition.start):
                yield n, json.dumps(record, ensure_ascii=False)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "n long, payload string"

        def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
            return Reader()

    return Source
