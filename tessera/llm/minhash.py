"""Near-duplicates by b-bit MinHash, confirmed on full sets of shingles.

A document's set holds the hashes of its distinct five-word shingles. Documents with equal sets are one
class. Of each of 240 minima of a class's set the low eight bits are kept and packed to a signature; six bytes
are a band, and classes with an equal band are candidates. Candidates count as near if their signatures agree
in so many bytes, by counts of equal bits, that the similarity, corrected for bytes that collide by chance, is
within five standard deviations of the wanted one. What is near falls into families, and within a family links are
confirmed on the full sets, counted over shared shingles. At a similarity of exactly 0.85 a pair has no band in
common once in 10**8, and fails the estimate once in 10**6; more similar pairs less often.

No pairs are listed within buckets or families: a task grows components from one member by comparing what it
reached with what it did not reach yet, so that a group of copies costs one comparison a member, and gives a
spanning forest. Buckets of the same members are one. A group too large for a task is dealt to blocks: first each
block alone, then one member of each component of each block, then only what is outside of the largest
component against all blocks. Texts never move: sets are made where the documents stand, for members of families
alone.

Edge cases: documents without words have no shingles, are linked with nothing, and are components of their own;
null ids count only if a component has no other (its id is then null); repeated rows and ids all come out;
fewer than five words are one shingle; a text of any length is taken whole; an empty table gives no
rows; other columns of the input are ignored, whatever their names. Shingles are told apart by 64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import OWN, keyed, look_up, sliced
from tessera.llm.simhash import components
from tessera.shared import materialize

SHINGLE, PERCENT = 5, 85
#: Minima of a signature, of which BITS low bits are kept; minima of a band.
MINIMA, BITS, BAND = 240, 8, 6
#: Standard deviations by which an estimate may fall short of the wanted similarity.
MARGIN = 5.0
#: Of a block that one task compares: members of a bucket, bytes of a family's sets (each set counts 2 KB more).
MEMBERS, SET_BYTES = 4096, 1 << 24
_RNG = np.random.default_rng(11)
FACTORS = _RNG.integers(0, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)
OFFSETS = _RNG.integers(0, 1 << 32, MINIMA, dtype=np.uint32)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; bytes.lower and bytes.split know ASCII only, as is wanted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)] if words else [], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(0)), np.uint64, len(words))
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = _mixed(out + hashes[k : k + n])
    return np.unique(out)


def signature(own: np.ndarray) -> bytes:
    """The low bits of the minima of a set, one byte each; so many shingles at once that the work stays in the cache."""
    short = (own ^ (own >> np.uint64(32))).astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(short), 256):
        np.minimum(least, (short[start : start + 256, None] * FACTORS + OFFSETS).min(axis=0), out=least)
    least = (least ^ (least >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return ((least ^ (least >> np.uint32(13))) & np.uint32((1 << BITS) - 1)).astype(np.uint8).tobytes()


def agreeing(percent: int = PERCENT, margin: float = MARGIN) -> int:
    """Bytes that signatures of so similar sets have in common at least, but for the margin."""
    chance, j = 2.0**-BITS, percent / 100
    p = chance + (1 - chance) * j
    return int(np.ceil(MINIMA * p - margin * np.sqrt(MINIMA * p * (1 - p))))


def estimate(same: int | np.ndarray) -> float | np.ndarray:
    """The similarity for so many equal bytes, corrected for those that are equal by chance."""
    chance = 2.0**-BITS
    return (same / MINIMA - chance) / (1 - chance)


def _grown(labels: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect what near(member, others) links, as a forest over members that share a label already.

    Each member is compared with those that are not reached when its turn comes, of the other side only if there are sides.
    """
    edges = []
    left = np.arange(len(labels))
    while len(left):
        todo = left[labels[left] == labels[left[0]]].tolist()
        left = left[labels[left] != labels[left[0]]]
        while todo and len(left):
            at = todo.pop()
            others = left if side is None else left[side[left] != side[at]]
            hits = others[near(at, others)] if len(others) else others
            # One edge for each label that is reached, and all its members are.
            found, first = np.unique(labels[hits], return_index=True)
            edges += [(at, int(hits[k])) for k in first]
            reached = np.isin(labels[left], found)
            todo += left[reached].tolist()
            left = left[~reached]
    return edges


def by_signature(payloads: list[bytes], least: int) -> Callable[[int, np.ndarray], np.ndarray]:
    words = np.frombuffer(b"".join(payloads), np.uint64).reshape(len(payloads), -1)
    low = np.uint64(0x0101010101010101)

    def near(at: int, others: np.ndarray) -> np.ndarray:
        x = words[others] ^ words[at]
        for shift in (4, 2, 1):
            x |= x >> np.uint64(shift)
        return MINIMA - np.bitwise_count(x & low).sum(axis=1, dtype=np.int64) >= least

    return near


def by_set(payloads: list[bytes], percent: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """Members meet over the lists of those that have a shingle."""
    sets = [np.frombuffer(p, np.uint64) for p in payloads]
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(codes, kind="stable")
    posted, first = owner[order], np.searchsorted(codes[order], np.arange(codes.max(initial=-1) + 2))
    ends = np.cumsum(sizes)

    def near(at: int, others: np.ndarray) -> np.ndarray:
        own = codes[ends[at] - sizes[at] : ends[at]]
        start, n = first[own], first[own + 1] - first[own]
        shared = np.bincount(posted[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))[others]
        return 100 * shared >= percent * (sizes[at] + sizes[others] - shared)

    return near


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each key, part and chunk, which stand one after another."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                if held and last != tuple(keys[:, a]):
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = tuple(keys[:, a])
    if held:
        yield pa.Table.from_batches(held)


def _compared(batches: Iterator[pa.RecordBatch], near: Callable) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for group in _groups(batches):
        if group.num_rows > 1:
            nodes, labels = (group.column(k).to_numpy() for k in ("node", "label"))
            side = group.column("guest").to_numpy()
            found = _grown(labels, near(group.column("payload").to_pylist()), side if side.any() else None)
            a += [int(nodes[i]) for i, _ in found]
            b += [int(nodes[j]) for _, j in found]
        if len(a) > 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _task_links(rows: DataFrame, near: Callable) -> DataFrame:
    """rows: key, part, chunk, node, label, guest, payload."""
    rows = rows.select("key", "part", "chunk", "node", "label", "guest", "payload")
    return rows.repartition("key", "part", "chunk").sortWithinPartitions("key", "part", "chunk").mapInArrow(partial(_compared, near=near), "a long, b long")


def connected(rows: DataFrame, near: Callable, limit: int) -> DataFrame:
    """Edges a, b that connect, within each key of rows (key, node, weight, payload), the nodes whose payloads are near.

    A task holds payloads of about `limit` in weight, whatever the size of a key.
    """
    of = F.ceil(F.col("weight") / limit).cast("int")
    sizes = materialize(rows.groupBy("key").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", of.alias("parts")), "sizes")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = rows.join(sizes, "key").select("key", "parts", part.alias("part"), "node", "weight", "payload")
    crowded = not sizes.where("parts > 1").isEmpty()
    dealt = materialize(dealt, "dealt") if crowded else dealt
    alone = dealt.select("key", "part", F.lit(0).alias("chunk"), "node", F.col("node").alias("label"), F.lit(False).alias("guest"), "payload")
    edges = materialize(_task_links(alone, near), "block-links")
    if not crowded:
        return edges
    hot = dealt.where("parts > 1")

    def labelled(edges: DataFrame) -> DataFrame:
        roots = components(edges).withColumnRenamed("root", "label")
        return materialize(hot.join(roots, "node", "left").select("key", "parts", "part", "node", "weight", F.coalesce("label", "node").alias("label"), "payload"), "labelled")

    # One member of each component of each block.
    own = labelled(edges)
    heads = own.select("key", "part", "label", "node").groupBy("key", "part", "label").agg(F.min("node").alias("node")).select("key", "node")
    heads = own.join(heads, ["key", "node"])
    counts = heads.groupBy("key").agg(F.ceil(F.sum("weight") / limit).cast("int").alias("of"))
    met = heads.join(counts, "key").select("key", F.pmod(F.xxhash64("label"), F.col("of")).cast("int").alias("part"), F.lit(1).alias("chunk"), "node", "label", F.lit(False).alias("guest"), "payload")
    edges = materialize(edges.unionByName(_task_links(met, near)), "head-links")
    # What is outside of the largest component, against all blocks.
    own = labelled(edges)
    sizes = own.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    major = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"))
    told = materialize(own.join(major.select("key", F.col("most.label").alias("major")), "key").withColumn("minor", F.col("label") != F.col("major")), "told")
    chunks = told.where("minor").groupBy("key").agg(F.ceil(F.sum("weight") / limit).cast("int").alias("chunks"))
    every = told.join(chunks, "key")
    own = every.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("guest", F.lit(False))
    guests = every.where("minor").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("home", F.col("part"))
    guests = guests.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("part <> home").withColumn("guest", F.lit(True)).drop("home")
    return edges.unionByName(_task_links(own.unionByName(guests.select(*own.columns)), near))


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        digests, counts, signatures = [], [], []
        for text in batch.column(2).to_pylist():
            own = shingles(text)
            counts.append(len(own))
            digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
            signatures.append(signature(own) if len(own) else None)
        made = [pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(signatures, pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], names=["doc_id", "row", "digest", "n", "signature"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 100):
        sets = [shingles(text).tobytes() for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) + 2048 for s in sets], pa.int64()), pa.array(sets, pa.binary())], names=["node", "weight", "payload"])


def buckets(classes: DataFrame) -> DataFrame:
    """key and node of the bands that several classes (node, signature) share; of buckets with the same members only one."""
    size = BAND * BITS // 8
    band = lambda k: F.xxhash64(k, F.substring(F.col("signature"), k * size + 1, F.lit(size)))
    bands = classes.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(MINIMA // BAND - 1)), band)).alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("members")).where("n > 1")
    one = materialize(shared.groupBy("n", "least", "members").agg(F.min("key").alias("key")).select("key"), "buckets")
    return bands.join(one, "key").select("key", "node")


def links(docs: DataFrame, classes: DataFrame, percent: int = PERCENT, members: int = MEMBERS, set_bytes: int = SET_BYTES) -> DataFrame:
    """Edges a, b between classes (node, row, signature) of keyed docs (text) that connect all whose sets are so similar."""
    near = partial(by_signature, least=agreeing(percent))
    signed = classes.select("node", F.lit(1).alias("weight"), F.col("signature").alias("payload"))
    families = materialize(components(connected(buckets(classes).join(signed, "node"), near, members)), "families")
    told = classes.join(families, "node").select("row", F.col("node").alias("value"))
    met = look_up(docs, told.select(F.col("row").alias(f"{OWN}row"), "value"), f"{OWN}node").where(F.col(f"{OWN}node").isNotNull())
    sets = materialize(met.select(f"{OWN}node", "text").mapInArrow(_sets, "node long, weight long, payload binary"), "sets")
    return connected(sets.join(families.withColumnRenamed("root", "key"), "node"), partial(by_set, percent=percent), set_bytes)


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT, members: int = MEMBERS, set_bytes: int = SET_BYTES) -> DataFrame:
    """doc_id, row (its place in the files), n_shingles, root (the same for all linked, null without words) and component_id of each row."""
    own = keyed(docs).select(F.col(id_column).alias("doc_id"), F.col(f"{OWN}row"), F.col(text_column).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    prints = materialize(own.mapInArrow(_prints, f"doc_id {kind}, row struct<f:bigint,r:bigint>, digest binary, n long, signature binary"), "prints")
    found = prints.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.first("signature").alias("signature"))
    classes = materialize(found.withColumn("node", F.monotonically_increasing_id()), "classes")
    roots = components(links(own, classes, percent, members, set_bytes))
    rooted = materialize(classes.join(roots, "node", "left").select("digest", "least", F.coalesce("root", "node").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    told = materialize(rooted.join(least, "root").select("digest", "root", "component_id"), "components")
    met = prints.select("doc_id", "row", "digest", F.col("n").alias("n_shingles")).join(told, "digest", "left")
    return met.withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))).drop("digest")


def kept() -> Column:
    """Whether a row of deduplicate() has its component's id."""
    return F.col("doc_id").eqNullSafe(F.col("component_id"))
