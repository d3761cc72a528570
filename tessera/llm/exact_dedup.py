"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries of each partition find every digest that may be frequent. The counts and the
winners of those few are verified exactly and broadcast, so that their rows are settled where they
stand; all other digests go through an ordinary shuffle: partial aggregates find their winners, and
a join, which adaptive execution can split, tells each row its winner. No task holds a group.

Edge cases: a null text counts as empty, and all empty texts are one group; ties on length go to the
smallest id (a null id is the largest), and of wholly equal rows exactly one stays; a very long text
is one row like any other, of which only digest and length are kept; an empty table gives no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import OWN, look_up
from tessera.shared import materialize

#: Counters of a summary. A digest with over 2/COUNTERS of all rows is sure to be a candidate.
COUNTERS = 1024


def normalised(text: Column) -> Column:
    """text without white space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Narrow rows, written once: id, digest, length of the original text, and a generated row number."""
    return materialize(
        docs.select(
            F.col(id_column).alias("doc_id"),
            F.sha2(normalised(F.col(text_column)), 256).alias("sha"),
            F.coalesce(F.length(text_column), F.lit(0)).cast("long").alias("length"),
            F.monotonically_increasing_id().alias("row"),
            *keep,
        ),
        "digests",
    )


def misra_gries(values: Iterator[list], counters: int) -> dict[str, int]:
    """A summary in which every value with over 1/(counters+1) of the input has a counter."""
    held: dict[str, int] = {}
    for batch in values:
        for value in batch:
            if value in held:
                held[value] += 1
            elif len(held) < counters:
                held[value] = 1
            else:
                held = {v: n - 1 for v, n in held.items() if n > 1}
    return held


def candidates(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most counters+1 digests, among them each with 2/(counters+1) of the rows.

    Such a digest keeps at least 1/(counters+1) of the rows over the partitions' summaries, and no
    more than counters+1 digests can sum to that much.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = misra_gries((b.column(0).to_pylist() for b in batches), counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["sha", "n"])

    found = rows.select("sha").mapInArrow(run, "sha string, n long")
    summed = found.groupBy("sha").agg(F.sum("n").alias("n"))
    return summed.orderBy(F.desc("n"), "sha").limit(counters + 1).select("sha")


def group_winners(rows: DataFrame) -> DataFrame:
    """Per digest: the row that stays (longest original, then smallest id, then first row) and the size."""
    best = F.min(F.struct((-F.col("length")).alias("l"), F.col("doc_id").isNull().alias("z"), "doc_id", "row"))
    return rows.groupBy("sha").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select("sha", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")


def deduplicate(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """rows of digests() with keep_id, group_size and kept."""
    likely = F.broadcast(candidates(rows, counters))
    # At most counters+1 rows. Written, so that the two uses below agree and the count runs once.
    heavy = F.broadcast(materialize(group_winners(rows.join(likely, "sha", "left_semi")), "heavy"))
    settled = rows.join(heavy, "sha")
    rest = rows.join(heavy, "sha", "left_anti")
    # Written, so that both sides of the join are plain exchanges.
    repeated = materialize(group_winners(rest).where("group_size > 1"), "repeated")
    joined = rest.join(repeated, "sha", "left")
    single = F.col("group_size").isNull()
    shuffled = joined.select(*rows.columns, F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("keep_row", "row").alias("keep_row"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    both = settled.select(*shuffled.columns).unionByName(shuffled)
    return both.withColumn("kept", F.col("row") == F.col("keep_row")).drop("keep_row")


def drop_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns, where they stand: no text is moved.

    Rows are matched by file and place in the file, so docs must be keyed() and still stand on its files.
    """
    key = f"{OWN}row"
    lost = deduplicate(digests(docs, id_column, text_column, (key,))).where(~F.col("kept")).select(key, F.lit(1).alias("value"))
    return look_up(docs, lost, f"{OWN}lost").where(F.col(f"{OWN}lost").isNull()).drop(key, f"{OWN}lost")
