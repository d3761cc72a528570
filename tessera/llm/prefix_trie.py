"""A trie of conversation prefixes, built level by level.

A node is a distinct sequence of first turns and bears the smallest id of the conversations that begin with it.
Conversations of the same turns are one class, with a weight. At each depth the classes that are still with others
are grouped by their node and their next turn; a group is a node of the next depth and its smallest id the
node's. A class that is alone leaves: the rest of its turns is a chain, known without going down. Then, from the
deepest level up, a join of each level with the nodes below rolls up leaves and savings. So there are as many
levels as the longest prefix that two different conversations share.

Turns are ordered by ranges of (conversation, turn) and numbered within each range; only conversations that lie
across ranges need an offset, one a range at most. No conversation and no group of conversations has to fit in a task: groups
are aggregated, and told back by joins whose hot keys can be split. The hash of a node's ends needs all their ids in
order, which is a sequence by nature: a class's ids are sorted outside of memory and stream through one task.

Edge cases: null roles and texts are empty ones; null turns come first; turns of one number go by role, then by a
hash of role and text, and repeated turns all count; rows without conversation id are left out; a conversation may be
without turns and is then a member of the root alone; long texts and long conversations are rows like others; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.shared import materialize

EMPTY = hashlib.sha256(b"").hexdigest()
SORTED = "conv long, digest binary, chars long, part int, place long, before long"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their place in the conversation's rows of this range, and the characters before them there."""
    last, place, before = None, 0, 0
    for batch in batches:
        conv, chars = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        if not len(conv):
            continue
        starts = np.flatnonzero(np.diff(conv, prepend=conv[0] - 1))
        run = np.cumsum(np.diff(conv, prepend=conv[0] - 1) != 0) - 1
        sums = np.cumsum(chars) - chars
        places, sums = np.arange(len(conv)) - starts[run], sums - sums[starts][run]
        if conv[0] == last:
            places[run == 0] += place
            sums[run == 0] += before
        last, place, before = conv[-1], int(places[-1]) + 1, int(sums[-1] + chars[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places), pa.array(sums)], names=[*batch.schema.names, "place", "before"])


def ordered(turns: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """conv, digest and chars of each turn with pos, its place in its conversation from 0, and before, the characters of the turns before it."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # The role's length tells where it ends, so that different turns give different strings.
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = turns.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("conv"), F.col("turn").alias("turn"), role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    order = ["conv", F.asc_nulls_first("turn"), "role", "digest"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "digest", "chars", F.spark_partition_id().alias("part"))
    placed = materialize(ranged.mapInArrow(_placed, SORTED), "placed")
    parts = placed.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("c"))
    across = parts.groupBy("conv").agg(F.count(F.lit(1)).alias("k"), F.sort_array(F.collect_list(F.struct("part", "n", "c"))).alias("all")).where("k > 1")  # a row for each range of a conversation
    summed = lambda name: F.aggregate(F.filter("all", lambda x: x["part"] < F.col("own.part")), F.lit(0).cast("long"), lambda s, x: s + x[name])
    earlier = across.select("conv", F.explode("all").alias("own"), "all").select(
        "conv",
        F.col("own.part").alias("part"),
        summed("n").alias("more_n"),
        summed("c").alias("more_c"),
    )
    met = placed.join(F.broadcast(earlier), ["conv", "part"], "left")  # no more rows than twice the ranges
    return met.select("conv", "digest", "chars", (F.col("place") + F.coalesce("more_n", F.lit(0))).alias("pos"), (F.col("before") + F.coalesce("more_c", F.lit(0))).alias("before"))


def sequences(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ordered() turns: conversations (conv, len, total) and their turns (conv, depth from 1, digest, chars, before)."""
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("len"), F.sum("chars").alias("total"))
    return convs, turns.select("conv", (F.col("pos") + 1).alias("depth"), "digest", "chars", "before")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of the comma-joined ids of each class; its rows stand one after another, in order."""
    last, state, done = None, None, []
    for batch in batches:
        rep, conv = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(rep)) + 1).tolist(), len(rep)] if len(rep) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            data = ",".join(map(str, conv[a:b].tolist())).encode()
            if state is not None and rep[a] == last:
                state.update(b"," + data)
                continue
            if state is not None:
                done.append((int(last), state.hexdigest()))
            last, state = rep[a], hashlib.sha256(data)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.string()))], names=["conv", "ends"])
            done = []
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([int(last)], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["conv", "ends"])


def classes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv (the smallest id), len, total, weight and ends (the hash of the ids) of the conversations with the same turns."""
    twice = [F.bit_xor(F.xxhash64(F.lit(salt), "depth", "digest")).alias(f"x{salt}") for salt in (1, 2)]  # each depth is there once, so that nothing cancels
    marks = turns.groupBy("conv").agg(*twice)
    marked = materialize(convs.join(marks, "conv", "left").select("conv", "len", "total", F.coalesce("x1", F.lit(0)).alias("x1"), F.coalesce("x2", F.lit(0)).alias("x2")), "marked")
    found = materialize(marked.groupBy("len", "x1", "x2").agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("weight"), F.min("total").alias("total")), "classes")
    several = marked.join(found.where("weight > 1").select("len", "x1", "x2", "rep"), ["len", "x1", "x2"]).select("rep", "conv")
    hashed = several.repartition("rep").sortWithinPartitions("rep", "conv").mapInArrow(_hashed, "conv long, ends string")
    one = F.sha2(F.col("rep").cast("string"), 256)
    return materialize(found.join(hashed.withColumnRenamed("conv", "rep"), "rep", "left").select(F.col("rep").alias("conv"), "len", "total", "weight", F.coalesce("ends", one).alias("ends")), "ends")


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """NODE rows of the trie of conversations (conv, len, total) with their turns (conv, depth, digest, chars, before)."""
    own = classes(convs, turns)
    single = own.agg(F.count(F.lit(1)).alias("k"), F.min("conv").alias("node"), F.sum("weight").alias("n")).where("k > 0")  # one row
    turns = materialize(turns.join(own.select("conv"), "conv", "left_semi").repartitionByRange("depth", "conv"), "trie-turns")
    live = own.join(F.broadcast(single.select("node"))).select("conv", "len", "total", "weight", "ends", "node")  # one row
    # Levels of nodes that several classes share, chains of those that are alone, and who ends where.
    levels = [materialize(single.select("node", F.lit(None).cast("long").alias("parent"), "n", F.lit(0).cast("long").alias("chars")), "root")]
    chains, ends = [], []
    while True:
        depth = len(levels)
        ends.append(live.where(F.col("len") == depth - 1).select("node", F.lit(depth - 1).cast("long").alias("depth"), "ends"))
        step = live.where(F.col("len") >= depth).join(turns.where(F.col("depth") == depth).select("conv", "digest", "chars"), "conv")
        step = materialize(step.withColumnRenamed("node", "parent"), "step")
        groups = materialize(step.groupBy("parent", "digest").agg(F.min("conv").alias("node"), F.sum("weight").alias("n"), F.count(F.lit(1)).alias("k"), F.min("chars").alias("chars")), "groups")
        alone = groups.where("k = 1").select(F.col("node").alias("conv"), F.lit(depth).cast("long").alias("top"), "parent")
        chains.append(alone)
        if groups.where("k > 1").isEmpty():
            break
        levels.append(groups.where("k > 1").select("node", "parent", "n", "chars"))
        shared = groups.where("k > 1").select("parent", "digest", "node")
        live = materialize(step.join(shared, ["parent", "digest"]).select("conv", "len", "total", "weight", "ends", "node"), "live")
    tops = materialize(reduce(DataFrame.unionByName, chains).join(own, "conv"), "tops")
    ended = materialize(reduce(DataFrame.unionByName, ends), "ended")

    chain = tops.join(turns, "conv").where("depth >= top")
    within = chain.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("weight").alias("n_convs"),
        (F.col("depth") < F.col("len")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("weight") - 1) * (F.col("total") - F.col("before"))).alias("saved_tokens"),
        F.when(F.col("depth") == F.col("len"), F.col("ends")).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )
    first = tops.join(turns.select("conv", F.col("depth").alias("top"), "before"), ["conv", "top"])
    below = materialize(first.select("parent", F.col("top").alias("depth"), F.lit(1).cast("long").alias("leaves"), ((F.col("weight") - 1) * (F.col("total") - F.col("before"))).alias("saved")), "below")
    done, upper = [], None
    for depth in reversed(range(len(levels))):
        children = below.where(F.col("depth") == depth + 1).select("parent", "leaves", "saved")
        if upper is not None:
            children = children.unionByName(upper.select("parent", "leaves", "saved"))
        summed = children.groupBy("parent").agg(F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("below")).withColumnRenamed("parent", "node")
        none = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
        rolled = levels[depth].join(summed, "node", "left")
        saved = (F.col("n") - 1) * F.col("chars") + none("below")
        upper = materialize(rolled.select("node", "parent", "n", F.lit(depth).cast("long").alias("depth"), none("children").alias("children"), F.coalesce("leaves", F.lit(1).cast("long")).alias("leaves"), saved.alias("saved")), "rolled")
        done.append(upper)
    nodes = reduce(DataFrame.unionByName, done).join(ended, ["node", "depth"], "left")
    inner = nodes.select(
        F.col("node").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
    )
    return inner.unionByName(within)


def from_heads(turns: DataFrame, own_after: Column, group: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """As sequences(), of conversations that are rebuilt: the first own_after turns of conversation `group`, then what comes after as many of their own.

    Both are expressions of conv; own_after is at most `most`.
    """
    each = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("all"))
    head = turns.where(F.col("pos") < most)
    firsts = materialize(head.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "chars", "before"))).alias("head")), "heads")  # `most` turns each
    told = each.select("conv", "n", "all", own_after.alias("h"), group.alias("source"))
    source = firsts.select(F.col("conv").alias("source"), F.col("head").alias("theirs"))
    met = told.join(source, "source", "left").join(firsts, "conv")
    chars = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x["chars"])
    met = met.withColumn("theirs", F.slice(F.coalesce("theirs", F.array().cast(firsts.schema["head"].dataType)), 1, F.col("h"))).withColumn("k", F.size("theirs").cast("long"))
    met = met.withColumn("lead", chars("theirs")).withColumn("cut", chars(F.slice("head", 1, F.col("h"))))
    rebuilt = materialize(met.select("conv", "h", "k", "lead", "cut", "theirs", (F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("len"), (F.col("lead") + F.col("all") - F.col("cut")).alias("total")), "rebuilt")
    taken = rebuilt.select("conv", F.explode("theirs").alias("t")).select("conv", (F.col("t.pos") + 1).alias("depth"), "t.digest", "t.chars", "t.before")
    rest = turns.join(rebuilt.select("conv", "h", "k", "lead", "cut"), "conv").where(F.col("pos") >= F.col("h"))
    rest = rest.select("conv", (F.col("k") + F.col("pos") - F.col("h") + 1).alias("depth"), "digest", "chars", (F.col("lead") + F.col("before") - F.col("cut")).alias("before"))
    return rebuilt.select("conv", "len", "total"), taken.unionByName(rest)
