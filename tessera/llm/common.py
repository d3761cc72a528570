"""What the corpus operators share: Arrow batches that gain columns, stable row keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.shared import materialize, shared_path

#: Prefix of working columns, so that columns of the input with common names do not clash.
OWN = "__llm_"


def append_columns(df: DataFrame, column: str, fields: list[tuple[str, T.DataType]], fn: Callable[[list], list[list]], arrow_types: list[pa.DataType]) -> DataFrame:
    """df with the columns that fn(values of `column`) returns for each Arrow batch, in one pass without a shuffle."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t, True) for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = fn(batch.column(batch.schema.get_field_index(column)).to_pylist())
            arrays = [*batch.columns, *(pa.array(v, type=t) for v, t in zip(found, arrow_types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *(n for n, _ in fields)])

    return df.mapInArrow(run, schema)


def keyed(df: DataFrame) -> DataFrame:
    """df with a row key that is the same however often the rows are read: file and place in the file.

    A DataFrame that does not come straight from files is written to the shared folder first. Columns of
    df may have any names, `_metadata` too.
    """
    name = f"{OWN}row"
    try:
        return df.select("*", file_row(df).alias(name))
    except AnalysisException:  # no such column
        written = materialize(df, "rows")
        return written.select("*", file_row(written).alias(name))


def file_row(df: DataFrame) -> Column:
    place = df.metadataColumn("_metadata")  # not df["_metadata"], which a column of that name would hide
    return F.struct(F.xxhash64(place["file_path"]).alias("f"), place["row_index"].alias("r"))


#: Rows of a file that look up the same part of a side table, as a power of two; rows of a part.
SLICE_BITS, PART = 16, 500_000
#: Rows of a batch within tasks. Texts may be long, and Python's own strings stand beside those of the batch.
BATCH = 1000


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH) -> Iterator[pa.RecordBatch]:
    """The rows of batches in smaller batches; Spark's own have its default number of rows and bytes."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


@lru_cache(maxsize=2)
def _part(folder: str, part: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers, ascending, and values by file of one part of a side table."""
    fs, root = pafs.FileSystem.from_uri(folder)
    files = fs.get_file_info(pafs.FileSelector(f"{root}/part={part}", allow_not_found=True))
    tables = [pq.read_table(fs.open_input_file(f.path), columns=["f", "r", "value"]) for f in files if f.path.endswith(".parquet")]
    if not tables:
        return {}
    own = pa.concat_tables(tables)
    f, r, value = (own.column(k).to_numpy() for k in range(3))
    order = np.lexsort((r, f))
    f, r, value = f[order], r[order], value[order]
    edges = np.flatnonzero(np.diff(f, prepend=f[0] - 1, append=f[-1] + 1))
    return {int(f[a]): (r[a:b], value[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)}


def look_up(docs: DataFrame, told: DataFrame, name: str) -> DataFrame:
    """docs (keyed) with `name`: the long that told (the row key, value) has for each row, else null.

    The rows of docs are not moved: told is written in parts by file and slice of its rows, and each task
    reads the parts of the rows that it has. Only the key goes to Python, never the rest of a row.
    """
    key = F.col(f"{OWN}row")
    told = materialize(told.select(key["f"].alias("f"), key["r"].alias("r"), F.col("value").cast("long").alias("value")), "told")
    parts = told.count() // PART + 1
    part = lambda f, r: F.pmod(F.hash(f, F.shiftright(r, SLICE_BITS)), F.lit(parts))
    folder = shared_path(docs.sparkSession, "by-row")
    told.withColumn("part", part(F.col("f"), F.col("r"))).repartition(parts, "part").write.partitionBy("part").parquet(folder)

    @F.arrow_udf("long")
    def value(parts: pa.Array, files: pa.Array, rows: pa.Array) -> pa.Array:
        p, f, r = (x.to_numpy(zero_copy_only=False) for x in (parts, files, rows))
        out, found = np.zeros(len(p), np.int64), np.zeros(len(p), bool)
        for a, b in {*zip(p.tolist(), f.tolist(), strict=True)}:
            if b in (own := _part(folder, a)):
                here = np.flatnonzero((p == a) & (f == b))
                at = np.minimum(np.searchsorted(own[b][0], r[here]), len(own[b][0]) - 1)
                found[here] = own[b][0][at] == r[here]
                out[here] = own[b][1][at]
        return pa.array(out, pa.int64(), mask=~found)

    return docs.withColumn(name, value(part(key["f"], key["r"]), key["f"], key["r"]))
