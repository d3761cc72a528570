"""SimHash near-duplicates, found exactly with vantage-point trees.

Fingerprints of 64 bits come from the hashes of word shingles. A vantage-point tree, fitted on a
bounded sample of fingerprints, partitions all distinct fingerprints: each node sends those within
its radius of the vantage point to one side and the others to the other. By the triangle inequality
a fingerprint can only link into a side that its distance to the vantage point allows, so it visits
just those shards that its ball overlaps, and pairs are exact. Shards that are still too large get trees
of their own, whatever the number of fingerprints. Within a shard the same bound, on the
distances to a local vantage point, prunes the comparisons. Each shard returns a spanning forest of
its links, never all pairs; the forests are joined to components by rounds of contraction.

Edge cases: null and word-less texts have the fingerprint zero and link like any other; equal
fingerprints are one node, so copies are never compared; null ids count only if a component has no
other (its id is then null, but it stays a component of its own); a very long text is hashed in blocks
of shingles; repeated rows all come out; an empty table gives no rows; other columns
of the input are ignored.
"""

from __future__ import annotations

import pickle
import random
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import OWN, append_columns, look_up
from tessera.shared import materialize

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints that fit a tree at most, fingerprints that a shard should own, and levels of one tree at most.
#: Visits grow with each level, comparisons within a shard are cheap: shards are rather large.
SAMPLE, SHARD, LEVELS = 1 << 16, 2048, 14
#: Trees below each other at most; bits of a leaf's number within its tree (a cell's number has those of all its trees).
ROUNDS, CELL_BITS = 4, 15
#: Rows of a cell that one task holds, and fingerprints that a block of rows is compared with at once.
ROWS, COMPARED = 1 << 20, 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as an unsigned number; bytes.lower and bytes.split know ASCII only, as is wanted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter((b" ".join(words),))
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    total, n = np.zeros(64, np.int64), 0
    hashes = map(xxhash.xxh64_intdigest, grams, repeat(seed))
    while len(block := np.fromiter(_take(hashes, 1 << 15), np.uint64)):
        total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(block)
    bits = np.packbits(2 * total > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def _take(values: Iterator[int], n: int) -> Iterator[int]:
    for _, value in zip(range(n), values, strict=False):
        yield value


def with_fingerprints(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with fp, the fingerprint as a signed long."""

    def fn(texts: list) -> list[list]:
        return [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64).tolist()]

    return append_columns(docs, text_column, [(f"{OWN}fp", T.LongType())], fn, [pa.int64()])


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


@dataclass
class Tree:
    """Vantage points, radii and children; a child below zero is the leaf -1 - child."""

    points: list[int] = field(default_factory=list)
    radii: list[int] = field(default_factory=list)
    children: list[tuple[int, int]] = field(default_factory=list)
    root: int = -1
    leaves: int = 0


def fit(sample: np.ndarray, levels: int, seed: int = 0) -> Tree:
    """A tree of so many levels. Of a few points each, the one whose distances spread most becomes the vantage point."""
    tree, rng = Tree(), random.Random(seed)

    def build(own: np.ndarray, level: int) -> int:
        best = None
        if level and len(own) >= 8:
            for _ in range(6):
                point = own[rng.randrange(len(own))]
                d = distance(own, point)
                radius = int(np.median(d))
                if radius == d.max():
                    radius -= 1
                inner = int((d <= radius).sum())
                near = int(((d > radius - RADIUS) & (d <= radius + RADIUS)).sum())
                if 0 < inner < len(own) and (best is None or near + abs(2 * inner - len(own)) < best[0]):
                    best = near + abs(2 * inner - len(own)), point, radius, d
        if best is None:
            tree.leaves += 1
            return -tree.leaves
        _, point, radius, d = best
        at = len(tree.points)
        tree.points.append(int(point))
        tree.radii.append(radius)
        tree.children.append((0, 0))
        tree.children[at] = build(own[d <= radius], level - 1), build(own[d > radius], level - 1)
        return at

    tree.root = build(sample, levels)
    return tree


def route(tree: Tree, fps: np.ndarray, visiting: np.ndarray, reach: int = RADIUS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each leaf: which of fps it owns and which visit it; fps that visit the tree's whole cell are owned by no leaf.

    Of two linked fingerprints on either side of a radius, the outer one visits the inner side; that
    is enough to meet. Visitors go on to every side that their ball overlaps.
    """
    todo = [(tree.root, fps[~visiting], fps[visiting])]
    while todo:
        node, own, guests = todo.pop()
        if not len(own) and not len(guests):
            continue
        if node < 0:
            yield -1 - node, own, guests
            continue
        point, radius = np.uint64(tree.points[node]), tree.radii[node]
        d, g = distance(own, point), distance(guests, point)
        inner, outer = tree.children[node]
        in_guests = np.concatenate([guests[g <= radius + reach], own[(d > radius) & (d <= radius + reach)]])
        out_guests = guests[g.astype(np.int16) > radius - reach]
        todo += [(inner, own[d <= radius], in_guests), (outer, own[d > radius], out_guests)]


DEALT = "cell long, fp long, owned boolean"


def _dealt(cell: int, fps: np.ndarray, owned: np.ndarray, tree: Tree) -> dict[str, np.ndarray]:
    """DEALT rows: fps of a cell in the cells of its tree's leaves."""
    parts = list(route(tree, fps.view(np.uint64), ~owned))
    sizes = [len(own) + len(guests) for _, own, guests in parts]
    return {
        "cell": np.repeat(np.array([(cell << CELL_BITS) + leaf for leaf, _, _ in parts], np.int64), sizes),
        "fp": np.concatenate([x for p in parts for x in p[1:]] or [fps[:0].view(np.uint64)]).view(np.int64),
        "owned": np.concatenate([np.arange(n) < len(p[1]) for p, n in zip(parts, sizes, strict=True)] or [np.zeros(0, bool)]),
    }


def _first(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        found = _dealt(1, fps, np.ones(len(fps), bool), tree)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in found.values()], names=list(found))


def _refit(group: pa.Table) -> pa.Table:
    """The tree of one cell, from the cell's sample."""
    cell, levels, parts = (group.column(k)[0].as_py() for k in ("cell", "levels", "parts"))
    tree = fit(np.sort(group.column("fp").to_numpy()).view(np.uint64), levels, seed=cell)
    return pa.table({"cell": [cell], "parts": pa.array([parts], pa.int32()), "tree": [pickle.dumps(tree)], "leaves": pa.array([tree.leaves], pa.int32())})


def _again(key: tuple, rows: pa.Table, tree: pa.Table) -> pa.Table:
    """DEALT rows of a part of a cell that is too large, in the cells of the cell's own tree."""
    return pa.table(_dealt(key[0].as_py(), rows.column("fp").to_numpy(), rows.column("owned").to_numpy(), pickle.loads(tree.column("tree")[0].as_py())))


def forest(owned: np.ndarray, guests: np.ndarray, reach: int = RADIUS, among: bool = True) -> np.ndarray:
    """For each of owned and guests: the place of its component's first member, over all links to owned.

    Both are compared in the order of their distances to one of owned, so that each block of rows
    meets only the slice whose distances allow a link, in steps of bounded size. Without `among`
    the links among owned are left to another call.
    """
    everyone = np.concatenate([owned, guests])
    label = np.arange(len(everyone))
    if not len(owned):
        return label
    point = owned[len(owned) // 2]
    d_own, d_all = distance(owned, point).astype(np.int16), distance(everyone, point).astype(np.int16)
    own_order, all_order = np.argsort(d_own, kind="stable"), np.argsort(d_all, kind="stable")
    if not among:
        all_order = all_order[all_order >= len(owned)]
    sorted_own, sorted_d = owned[own_order], d_own[own_order]
    for start in range(0, len(all_order), 256):
        rows = all_order[start : start + 256]
        low, high = np.searchsorted(sorted_d, d_all[rows[0]] - reach, "left"), np.searchsorted(sorted_d, d_all[rows[-1]] + reach, "right")
        for left in range(low, high, COMPARED):
            i, j = np.nonzero(distance(everyone[rows][:, None], sorted_own[None, left : min(high, left + COMPARED)]) <= reach)
            a, b = label[rows[i]], label[own_order[left + j]]
            while (apart := a != b).any():
                a, b = a[apart], b[apart]
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (label[label] != label).any():
                    label = label[label]
                a, b = label[a], label[b]
    return label


def _links(key: tuple, group: pa.Table) -> pa.Table:
    fps = group.column("fp").to_numpy().view(np.uint64)
    owned = group.column("owned").to_numpy()
    everyone = np.concatenate([fps[owned], fps[~owned]])
    label = forest(fps[owned], fps[~owned], among=key[1].as_py() == 0)
    apart = label != np.arange(len(label))
    return pa.table({"a": everyone[apart].view(np.int64), "b": everyone[label[apart]].view(np.int64)})


def _hashed(part: Column | int, of: int) -> Column:
    return F.pmod(F.xxhash64("fp"), F.lit(of)) < part


def cells(classes: DataFrame, sample: int = SAMPLE, shard: int = SHARD, levels: int = LEVELS, rounds: int = ROUNDS) -> DataFrame:
    """DEALT rows: the distinct fingerprints fp of classes in shards that own about `shard` of them, with all that visit.

    A first tree deals all fingerprints. Shards that still own more than twice `shard` get a tree each,
    fitted in a task from the shard's own sample, and are dealt again, as often as it takes. A shard that
    `rounds` rounds did not part (fingerprints at one distance from each other) stays whole: slower, not less exact.
    """
    spark = classes.sparkSession
    count = classes.count()
    # Fingerprints whose hash is small: a sample of the wanted size, bounded at twice that.
    share = min(1 << 20, (sample << 20) // max(1, count) + 1)
    drawn = classes.where(_hashed(share, 1 << 20)).select("fp").limit(2 * sample).toArrow()
    tree = fit(np.sort(drawn.column(0).to_numpy()).view(np.uint64), min(levels, max(0, (count // shard).bit_length())))
    seen = spark.sparkContext.broadcast(tree)  # at most 2**levels nodes
    dealt = materialize(classes.select("fp").mapInArrow(lambda it: _first(it, seen.value), DEALT), "dealt")
    done = None
    for _ in range(rounds - 1):
        counts = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("owned").cast("long")).alias("n")).where(F.col("n") > 2 * shard)
        # Twice the wanted number of leaves, as samples do not part evenly.
        wanted = F.least(F.lit(levels), F.ceil(F.log2(F.col("n") / shard)) + 1).cast("int")
        large = materialize(counts.select("cell", "n", F.ceil(F.col("m") / ROWS).cast("int").alias("parts"), wanted.alias("levels")), "large")
        if large.isEmpty():
            break
        held = dealt.join(large, "cell")
        drawn = held.where(F.col("owned") & _hashed(F.greatest(F.lit(1), (F.lit(sample) * (1 << 20) / F.col("n")).cast("long")), 1 << 20))
        trees = materialize(drawn.select("cell", "fp", "levels", "parts").groupBy("cell").applyInArrow(_refit, "cell long, parts int, tree binary, leaves int").where("leaves > 1"), "trees")
        # A large cell goes on in parts of bounded size, each with a copy of the cell's tree.
        copies = trees.select("cell", "tree", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        parts = dealt.join(trees.select("cell", "parts"), "cell").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        further = parts.groupBy("cell", "part").cogroup(copies.groupBy("cell", "part")).applyInArrow(_again, DEALT)
        whole = dealt.join(trees.select("cell"), "cell", "left_anti")
        done = whole if done is None else done.unionByName(whole)
        dealt = materialize(further, "dealt")
    return dealt if done is None else materialize(done.unionByName(dealt), "cells")


def links(classes: DataFrame, sample: int = SAMPLE, shard: int = SHARD, levels: int = LEVELS, rows: int = ROWS) -> DataFrame:
    """Links a, b between the distinct fingerprints fp of classes that keep every component whole."""
    dealt = cells(classes, sample, shard, levels)
    # A shard with very many visitors meets them in parts, each beside a copy of what it owns.
    crowded = materialize(dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > rows).select("cell", F.ceil(F.col("m") / rows).cast("int").alias("parts")), "crowded")
    part = F.when(F.col("owned"), F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).otherwise(F.array(F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")))
    met = dealt.join(crowded, "cell", "left").select("cell", F.explode(part).alias("part"), "fp", "owned")
    return met.groupBy("cell", "part").applyInArrow(_links, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: root is the same for all nodes that edges (a, b) connect. Nodes without edges are left out.

    In each round every node joins its smallest neighbour and the edges are drawn between what they
    joined, until none is left; written after each round. Only minima are aggregated, so that a node
    with many edges costs a partial aggregate, and both sides of each join can be split.
    """
    edges = materialize(edges, "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        step = materialize(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")), "step")
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("far"))
        step = materialize(step.join(jump, "to").select("node", F.col("far").alias("to")), "jump")
        if labels is None:
            labels = step.withColumnRenamed("to", "root")
        else:
            labels = labels.join(step.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        labels = materialize(labels, "labels")
        a, b = step.select(F.col("node").alias("a"), F.col("to").alias("ra")), step.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        drawn = edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges = materialize(drawn.distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(prints: DataFrame) -> DataFrame:
    """fp, root (the same fingerprint for all that are linked) and component_id (the smallest doc_id of all linked
    documents) for each distinct fp of prints (doc_id, fp). Only root names a component: ids may be null or repeated."""
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes))
    rooted = materialize(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialize(rooted.select("fp", "root").join(least, "root").select("fp", "root", "component_id"), "components")


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp, root and component_id for each row of docs, and the columns in keep."""
    prints = with_fingerprints(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), *keep), "text")
    prints = materialize(prints.select("doc_id", F.col(f"{OWN}fp").alias("fp"), *keep), "prints")
    return prints.join(near_duplicates(prints), "fp")


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each component: that of the smallest id, and of its rows the first in the files; docs must be keyed()."""
    key = f"{OWN}row"
    found = materialize(deduplicate(docs, id_column, text_column, (key,)), "near")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", key))
    # Components may be large, so the row that stays comes from an aggregate, not from a window.
    stays = found.groupBy("root").agg(first.alias("first")).select(F.col(f"first.{key}").alias(key), F.lit(1).alias("value"))
    return look_up(docs, stays, f"{OWN}stays").where(F.col(f"{OWN}stays").isNotNull()).drop(key, f"{OWN}stays")
