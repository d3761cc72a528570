"""Sequence packing as a cutting-stock problem solved by column generation.

Documents become tokens, cut at whole sequences; what is left of each falls into a histogram of
lengths in units of UNIT tokens. A linear program chooses how often to use each pattern (a multiset
of lengths that fits one sequence). Patterns are generated: the program's prices go to a knapsack
dynamic program that finds the pattern worth most, until none is worth its sequence. Rounded-down
patterns and a first-fit remainder are assigned to the pieces ranked within their length.

Ranks come from counts per (length, bucket) and an order within each, so that a length that a third
of all pieces have is still ranked by as many tasks as its rows need. The driver holds the histogram alone, whose
size does not depend on the input.

Edge cases: a null or empty text has the end token alone; texts longer than a sequence are cut;
repeated rows are packed each, and pieces that tie in length rank in any order; ids are whole numbers
(others fail on the cast to long); an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import sliced
from tessera.shared import materialize

#: Tokens of a sequence, the token that ends a document, tokens of a histogram unit.
LENGTH, END, UNIT = 4096, 2, 16
#: Rows that one task ranks, about.
RANKED = 1024
#: Words that a worker remembers of each generation, and the longest that it does.
REMEMBERED, LONGEST = 200_000, 48
# The vocabulary's pre-tokenizer, for lower-case texts of code points below LATIN.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\t-\r \x85\xa0]|_)+")
#: Below this code point texts are their own normal form.
LATIN = "\u0250"
BEYOND = re.compile(f"[{LATIN}-\U0010ffff]")
PIECES = "doc_id long, doc_tokens long, start long, length long, ids_crc32 long, ids array<int>"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    rank = {b: n for n, b in enumerate(others)}
    return [chr(b) if b in printable else chr(256 + rank[b]) for b in range(256)]


class Remembered(dict):
    """A dictionary in two generations: what is used stays, and its size is bounded."""

    def __init__(self) -> None:
        self.old: dict = {}

    def lacks(self, keys: set) -> list:
        """Those of keys that are new; the others are made ready."""
        keys = keys - self.keys()
        if self.old:
            self.update((k, self.old[k]) for k in keys & self.old.keys())
            keys -= self.old.keys()
        return list(keys)

    def age(self, long: list) -> None:
        """After a batch: long keys go, and a full generation becomes the old one."""
        for key in long:
            del self[key]
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Token ids of texts as little-endian bytes, equal to the tokenizer's.

    Its pre-tokenizer splits texts to words, whose ids do not depend on their neighbours. A worker
    remembers words; new ones go to the tokenizer's model. Texts with special tokens or letters
    beyond Latin go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Remembered()
        self.letters = dict(enumerate(byte_letters()))
        self.special = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()})

    def learn(self, split: list[list[str]]) -> list[bytes]:
        """The ids of each list of words."""
        new = self.words.lacks(set(chain.from_iterable(split)))
        tokenize, letters, words = self.tokenizer.model.tokenize, self.letters, self.words
        for word in new:
            spelled = word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(letters)
            words[word] = array("I", [t.id for t in tokenize(spelled)]).tobytes()
        known = words.__getitem__
        out = [b"".join(map(known, s)) for s in split]
        words.age([w for w in new if len(w) > LONGEST])
        return out

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        whole = [k for k, t in enumerate(texts) if (not t.isascii() and BEYOND.search(t)) or any(s in t for s in self.special)]
        if not whole:
            return self.learn([SPLIT.findall(t.lower()) for t in texts])
        out = self.learn([[] if k in set(whole) else SPLIT.findall(t.lower()) for k, t in enumerate(texts)])
        for k, found in zip(whole, self.tokenizer.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False), strict=True):
            out[k] = array("I", found.ids).tobytes()
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _cut(batches: Iterator[pa.RecordBatch], path: str, length: int, end: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode, last = encoder(path), np.array([end], "<u4").tobytes()
    for batch in sliced(batches):
        ids_column, text_column = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at in range(0, len(text_column), 1024):
            out: list[tuple] = []
            for doc_id, ids in zip(ids_column[at : at + 1024], encode(text_column[at : at + 1024]), strict=True):
                ids += last
                tokens = len(ids) // 4
                for start in range(0, tokens, length):
                    piece = ids[4 * start : 4 * (start + length)]
                    out.append((doc_id, tokens, start, len(piece) // 4, zlib.crc32(piece), np.frombuffer(piece, "<u4").astype(np.int32) if with_ids else None))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["doc_id", "doc_tokens", "start", "length", "ids_crc32", "ids"])


def pieces(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents, written once, with generated row numbers; their ids only if asked for."""
    source = docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string"))
    cut = source.mapInArrow(partial(_cut, path=tokenizer, length=length, end=end, with_ids=with_ids), PIECES)
    cut = cut if with_ids else cut.drop("ids")
    return materialize(cut.select("*", F.monotonically_increasing_id().alias("row"), F.ceil(F.col("length") / UNIT).cast("int").alias("units")), "pieces")


def best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within capacity that is worth most: an unbounded knapsack by dynamic programming."""
    worth, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fits = sizes[: np.searchsorted(sizes, c, "right")]
        worth[c] = worth[c - 1]
        if len(fits):
            gains = worth[c - fits] + prices[: len(fits)]
            k = int(gains.argmax())
            if gains[k] > worth[c] + 1e-12:
                worth[c], chosen[c] = gains[k], k
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if chosen[c] < 0:
            c -= 1
        else:
            pattern[chosen[c]] += 1
            c -= sizes[chosen[c]]
    return float(worth[capacity]), pattern


def invert(matrix: np.ndarray) -> np.ndarray:
    """The inverse, by Gauss-Jordan steps in plain array operations.

    The driver forks to start Spark, after which a threaded linear-algebra library may wait for
    threads that are gone; nothing here calls one.
    """
    n = len(matrix)
    both = np.concatenate([matrix, np.eye(n)], axis=1)
    for k in range(n):
        pivot = k + int(np.abs(both[k:, k]).argmax())
        both[[k, pivot]] = both[[pivot, k]]
        both[k] /= both[k, k]
        factors = both[:, k].copy()
        factors[k] = 0
        both -= factors[:, None] * both[k]
    return both[:, n:]


def program(sizes: np.ndarray, need: np.ndarray, capacity: int, within: float = 5e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Patterns (a column each), their uses and the sizes' prices: the linear program by the revised simplex method on generated columns.

    It ends when no pattern is worth more than 1 + within of a sequence, so that prices * need / (1 + within) bounds every packing from below.
    """
    basis = np.diag(capacity // sizes).astype(float)
    inverse, x = np.diag(1 / np.diag(basis)), need / np.diag(basis)
    for turn in range(1, 50 * len(sizes) + 1):
        prices = inverse.sum(axis=0)
        worth, pattern = best_pattern(sizes, np.maximum(prices, 0), capacity)
        if worth <= 1 + within:
            break
        d = (inverse * pattern).sum(axis=1)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = pattern
        step = ratio[out]
        x = np.maximum(x - step * d, 0)
        x[out] = step
        if turn % 100:
            row = inverse[out] / d[out]
            inverse -= d[:, None] * row
            inverse[out] = row
        else:
            inverse = invert(basis)
            x = np.maximum((inverse * need).sum(axis=1), 0)
    return basis, x, np.maximum(inverse.sum(axis=0), 0)


def solve(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (copies of each size) and how often to use each, so that all demand is met exactly.

    Uses of the linear program's patterns are rounded down and the rest goes first-fit.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n), np.int64)
    left = {int(s): demand[int(s)] for s in sizes}
    used: list[tuple[dict[int, int], int]] = []
    if len(sizes):
        basis, x, _ = program(sizes, np.array([demand[int(s)] for s in sizes], float), capacity)
        for k in range(len(sizes)):
            pattern = {int(s): int(a) for s, a in zip(sizes, basis[:, k], strict=True) if a}
            times = min([int(x[k] + 1e-9), *(left[s] // a for s, a in pattern.items())])
            if times > 0:
                used.append((pattern, times))
                for s, a in pattern.items():
                    left[s] -= a * times
    while left := {s: n for s, n in left.items() if n}:
        pattern, room = {}, capacity
        for s in sorted(left, reverse=True):
            if a := min(left[s], room // s):
                pattern[s], room = a, room - a * s
        times = min(left[s] // a for s, a in pattern.items())
        used.append((pattern, times))
        for s, a in pattern.items():
            left[s] -= a * times
    return used


def plan_rows(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """units, first rank, end rank, copies in a sequence, first sequence: which ranks each pattern takes."""
    rows, taken, sequence = [], {}, 0
    for pattern, times in patterns:
        for units, copies in pattern.items():
            first = taken.get(units, 0)
            taken[units] = first + copies * times
            rows.append((units, first, taken[units], copies, sequence))
        sequence += times
    return rows


def ranked(rows: DataFrame, counts: dict[int, int], most: int = RANKED) -> DataFrame:
    """rows with their rank among those of the same units, from 0; counts: how many each number of units has.

    A length has as many buckets as it takes for none to exceed about `most` rows.
    """
    # One row for each length.
    split = F.broadcast(rows.sparkSession.createDataFrame([(u, n // most + 1) for u, n in counts.items()], "units int, buckets int"))
    rows = rows.join(split, "units").withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("buckets")).cast("int")).drop("buckets")
    counts = rows.groupBy("units", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("units").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a `most`-th of a length's rows
    first = materialize(counts.select("units", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "buckets")
    within = F.row_number().over(Window.partitionBy("units", "bucket").orderBy(F.desc("length"), "row")) - 1
    return rows.withColumn("within", within).join(first, ["units", "bucket"]).withColumn("rank", F.col("first") + F.col("within")).drop("bucket", "first", "within")


def pack(rows: DataFrame, length: int = LENGTH, solver: Callable = solve, most: int = RANKED) -> DataFrame:
    """rows of pieces() with sequence_id and offset."""
    demand = {r.units: r.n for r in rows.groupBy("units").agg(F.count(F.lit(1)).alias("n")).collect()}  # LENGTH/UNIT rows at most
    plan = rows.sparkSession.createDataFrame(plan_rows(solver(demand, length // UNIT)), "plan_units int, low long, high long, copies int, sequence long")
    fits = (F.col("units") == F.col("plan_units")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    # The plan's rows are bounded by the number of lengths and of patterns, not by the input.
    placed = ranked(rows, demand, most).join(F.broadcast(plan), fits).withColumn("sequence_id", F.col("sequence") + F.floor((F.col("rank") - F.col("low")) / F.col("copies")))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("units"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("plan_units", "low", "high", "copies", "sequence", "rank", "units", "row")
