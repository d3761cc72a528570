"""Sharding over fixed virtual slots.

Records hash into a fixed number of slots by their ids. The bytes of each slot are aggregated once,
and a versioned table maps slots to shards: version 1 deals the slots out in turn, the next one is an
edit by the measured bytes. Rebalancing edits the table; it never rehashes records.

An id that more rows have than a slot should hold (a repeated one, or none at all) would fill its slot:
the rows of such ids, of which there are fewer than slots, hash by their place in the files as well.

Edge cases: a null text has no bytes (size is the overhead alone); a null id is an id like any other,
and so hashed by row if it is frequent; an empty table gives an empty map and no rows; repeated rows
each count and each get a place of their own, rows that tie in id and text in any order; a very long
text is one record and stays whole, so that its shard may exceed the others; other columns of the
input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import OWN, keyed
from tessera.shared import materialize, shared_path

#: Virtual slots. A parameter of the data set: fixed once, a few hundred times the number of shards.
SLOTS = 8192
#: Bytes that a record takes besides its text.
OVERHEAD = 16


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: shard_of[slot] for each slot that has records."""

    version: int
    shards: int
    slots: int
    shard_of: dict[int, int]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.shards, self.slots, s, h) for s, h in sorted(self.shard_of.items())]
        return spark.createDataFrame(rows, "version int, shards int, slots int, slot int, shard int")

    def save(self, spark: SparkSession, folder: str) -> None:
        """Add this version to the folder of the map; older versions stay readable."""
        self.frame(spark).coalesce(1).write.parquet(f"{folder}/version={self.version:06d}")


def load(spark: SparkSession, folder: str, version: int) -> SlotMap:
    rows = spark.read.parquet(f"{folder}/version={version:06d}").select("shards", "slots", "slot", "shard").collect()  # at most `slots` rows
    return SlotMap(version, rows[0].shards if rows else 0, rows[0].slots if rows else 0, {r.slot: r.shard for r in rows})


def crowded(docs: DataFrame, slots: int) -> DataFrame:
    """Hashes (of docs) of the ids that more than a slot's share of the rows has: fewer than `slots`, found by partial aggregates."""
    counts = docs.groupBy(f"{OWN}id").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > max(1, docs.count() // slots)).select(f"{OWN}id")


def id_hash(value: Column) -> Column:
    return F.xxhash64(value.cast("string"), value.isNull())


def with_slots(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", slots: int = SLOTS) -> DataFrame:
    """id, size, text_crc32 and virtual_slot of each record, written once."""
    raw = F.coalesce(F.col(text_column).cast("string").cast("binary"), F.lit(b""))
    own = keyed(docs)
    records = materialize(own.select(
        F.col(id_column),
        (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        id_hash(F.col(id_column)).alias(f"{OWN}id"),
        F.xxhash64(F.col(f"{OWN}row")).alias(f"{OWN}by_row"),
    ), "records")
    hot = materialize(crowded(records, slots), "crowded").withColumn(f"{OWN}hot", F.lit(True))
    key = F.when(F.col(f"{OWN}hot"), F.col(f"{OWN}by_row")).otherwise(F.col(f"{OWN}id"))
    slot = F.pmod(key, F.lit(slots)).cast("int").alias("virtual_slot")
    return records.join(F.broadcast(hot), f"{OWN}id", "left").select(id_column, "size", "text_crc32", slot)  # fewer than `slots` rows


def slot_loads(records: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows per slot: as many entries as there are slots at most, whatever the input."""
    stats = records.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return {r.virtual_slot: (r.b, r.n) for r in stats}


def assign(loads: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS) -> SlotMap:
    """Version 1: the slots in turn, whatever they hold."""
    return SlotMap(1, shards, slots, {slot: slot % shards for slot in sorted(loads)})


def rebalance(old: SlotMap, loads: dict[int, tuple[int, int]], shards: int, tolerance: float = 0.001) -> SlotMap:
    """The next version for `shards` shards: moves single slots from the fullest shard to the emptiest.

    Slots of removed shards move first. A slot moves only if the pair's larger load falls; it ends
    when every shard is within `tolerance` of the mean or no move helps.
    """
    shard_of = {s: h for s, h in old.shard_of.items() if h < shards}
    total = {h: 0 for h in range(shards)}
    members: dict[int, list[tuple[int, int]]] = {h: [] for h in range(shards)}
    for slot, shard in shard_of.items():
        size = loads.get(slot, (0, 0))[0]
        total[shard] += size
        members[shard].append((size, slot))
    for size, slot in sorted(((b, s) for s, (b, _) in loads.items() if s not in shard_of), reverse=True):
        shard = min(total, key=lambda h: (total[h], h))
        shard_of[slot] = shard
        total[shard] += size
        members[shard].append((size, slot))
    mean = sum(total.values()) / max(1, shards)
    while total:
        high, low = max(total, key=lambda h: (total[h], -h)), min(total, key=lambda h: (total[h], h))
        gap = total[high] - total[low]
        best = min((m for m in members[high] if 0 < m[0] < gap), key=lambda m: (abs(gap - 2 * m[0]), m[1]), default=None)
        if best is None or (total[high] <= mean * (1 + tolerance) and total[low] >= mean * (1 - tolerance)):
            break
        members[high].remove(best)
        members[low].append(best)
        total[high] -= best[0]
        total[low] += best[0]
        shard_of[best[1]] = low
    return SlotMap(old.version + 1, shards, old.slots, shard_of)


def place(records: DataFrame, slot_map: SlotMap, loads: dict[int, tuple[int, int]], id_column: str = "doc_id") -> DataFrame:
    """records with their shard and their place in it (gapless from 0).

    A place is the rows of the shard's earlier slots (known from the loads) plus the rank within the
    record's own slot, so the ranking runs over thousands of slots and not over the few shards.
    """
    first: dict[int, int] = {}
    filled: dict[int, int] = {}
    for slot, shard in sorted(slot_map.shard_of.items()):
        first[slot] = filled.get(shard, 0)
        filled[shard] = first[slot] + loads.get(slot, (0, 0))[1]
    rows = [(s, h, first[s]) for s, h in slot_map.shard_of.items()]
    known = records.sparkSession.createDataFrame(rows, f"virtual_slot int, shard int, {OWN}first long")  # one row per slot
    order = Window.partitionBy("virtual_slot").orderBy(F.col(id_column).asc_nulls_last(), "text_crc32")
    ranked = records.withColumn(f"{OWN}rank", F.row_number().over(order) - 1)
    return ranked.join(F.broadcast(known), "virtual_slot").withColumn("slot", F.col(f"{OWN}first") + F.col(f"{OWN}rank")).drop(f"{OWN}first", f"{OWN}rank")


def shard(docs: DataFrame, shards: int, id_column: str = "doc_id", text_column: str = "text", slots: int = SLOTS) -> DataFrame:
    """Each record's size, checksum, virtual slot and place; shards are near equal in bytes.

    Both versions of the map are stored in the shared folder; the second one, edited by the measured bytes, is read back and used.
    """
    spark = docs.sparkSession
    records = materialize(with_slots(docs, id_column, text_column, slots), "slots")  # narrow: texts are read once
    loads = slot_loads(records)
    folder = shared_path(spark, "slot-map")
    first = assign(loads, shards, slots)
    first.save(spark, folder)
    rebalance(load(spark, folder, 1), loads, shards, 1e-4).save(spark, folder)
    return place(records, load(spark, folder, 2), loads, id_column)
