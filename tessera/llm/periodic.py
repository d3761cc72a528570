"""Periodic runs of words, by block matching.

A run is a stretch of consecutive words with smallest period q and at least max(6, 4q) words that no
neighbouring word extends keeping period q. For each scale B, a power of two, the aligned blocks (B words
at multiples of B/2) are searched across the document with an Aho-Corasick automaton over sequences of
numbers: those of single words, or in larger blocks those of their eighths, equal where all words are. A block whose next occurrence is at a distance q with B/2 < q <= B seeds an exact extension to both
sides.

Nothing is lost: a run with B/2 < q <= B has at least 4q >= 2B + 2 words, so that an aligned block stands in
its first 3q words together with its occurrence q words on; as the block is as long as the period, which has no
smaller one, it occurs nowhere in between. For the same reason what grows from a seed has no smaller period
than q. Each seed that lies in a stretch already extended with its period is passed over, so that a stretch
is compared once.

Words that cannot be in a run of a scale are left out before: such a word has an equal one within B words on
either side, and so do enough words around it. What is left is searched whole.

Edge cases: a null or wordless text has no runs and an empty collapsed text; a text of any length is searched
whole, in time that grows with its words and the logarithm of their number; ties among equal stretches cannot be,
as start and period name a run; rows that are repeated and null ids come out as they are; an empty table gives
no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import OWN, append_columns

#: A run has that many words at least, and that many periods.
LEAST, PERIODS = 6, 4
#: Parts of a block that the automaton sees as one number each, at most.
PARTS = 8
N_WORDS, RUNS, COLLAPSED = f"{OWN}n_words", f"{OWN}runs", f"{OWN}collapsed"
RUN = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = defaultdict(lambda: len(seen))
    return np.fromiter(map(seen.__getitem__, words), np.int32, len(words))


def stretches(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Start and end of each row of true values that is so long."""
    edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def segments(codes: np.ndarray, before: np.ndarray, after: np.ndarray, block: int, least: int) -> list[tuple[int, int]]:
    """Stretches outside which no run of the scale is: each word has an equal one within `block` words of the stretch.

    before and after are the places of the same word's last and next occurrence. A stretch that loses words is
    looked at again, as others may have been near only those.
    """
    place = np.arange(len(codes))
    near_before, near_after = place - before <= block, after - place <= block
    found, todo = [], stretches(near_before | near_after, least)
    while todo:
        start, end = todo.pop()
        here = slice(start, end)
        alive = (near_before[here] & (before[here] >= start)) | (near_after[here] & (after[here] < end))
        if alive.all():
            found.append((start, end))
        else:
            todo += [(start + a, start + b) for a, b in stretches(alive, least)]
    return sorted(found)


class Names:
    """Numbers for the words at each place of a document, u of them at a time: equal where the words are."""

    def __init__(self, codes: np.ndarray) -> None:
        self.units, self.names = 1, codes

    def of(self, units: int) -> np.ndarray:
        """For a power of two that does not fall from call to call; a name of 2u words comes from the names of its halves."""
        while self.units < units:
            left, right = self.names[: -self.units].astype(np.int64), self.names[self.units :]
            _, self.names = np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)
            self.units *= 2
        return self.names


def seeds(names: np.ndarray, units: int, start: int, end: int, block: int) -> list[tuple[int, int]]:
    """Places of aligned blocks within the segment whose next occurrence is at a distance over block/2 and up to block; and that distance.

    A block is the sequence of the names of its parts, eight at most, so that the automaton stays shallow; it is
    searched in the names at each `units`-th place, from each of the first `units` places.
    """
    step, parts = max(1, block // 2), block // units
    keys: dict[tuple[int, ...], int] = {}
    for at in range(-(-start // step) * step, end - block + 1, step):
        keys.setdefault(tuple(names[at : at + block : units].tolist()), len(keys))
    matcher = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for key, number in keys.items():
        matcher.add_word(key, number)
    matcher.make_automaton()
    met: list[tuple[int, int]] = []
    for first in range(start, min(start + units, end - block + 1)):
        met += ((number, first + (stop - parts + 1) * units) for stop, number in matcher.iter(tuple(names[first : end - units + 1 : units].tolist())))
    if len(met) < 2:
        return []
    number, at = np.array(met, np.int64).T
    order = np.lexsort((at, number))
    number, at = number[order], at[order]
    apart = np.diff(at)
    good = (np.diff(number) == 0) & (at[:-1] % step == 0) & (2 * apart > block) & (apart <= block)
    return sorted(zip(at[:-1][good].tolist(), apart[good].tolist(), strict=True))


def reach(codes: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The stretch of that period around the words at `at` and `at + period`, which are equal; compared in growing slices."""
    right, width = at, 64
    while right + period < len(codes):
        stop = min(len(codes) - period, right + width)
        differ = codes[right:stop] != codes[right + period : stop + period]
        if differ.any():
            right += int(differ.argmax())
            break
        right, width = stop, 2 * width
    left, width = at, 64
    while left > 0:
        stop = max(0, left - width)
        differ = (codes[stop:left] != codes[stop + period : left + period])[::-1]
        if differ.any():
            left -= int(differ.argmax())
            break
        left, width = stop, 2 * width
    return left, right + period


def runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """start, length and period of each run, in that order."""
    n = len(words)
    if n < LEAST:
        return []
    codes = numbered(words)
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    before, after = np.full(n, -n - 1), np.full(n, 2 * n + 1)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    names = Names(codes)
    found, block = [], 1
    while max(LEAST, PERIODS * (block // 2 + 1)) <= n:
        ends: dict[int, int] = {}  # of the last stretch, by period
        for start, end in segments(codes, before, after, block, max(LEAST, PERIODS * (block // 2 + 1))):
            units = max(1, block // PARTS)
            for at, period in seeds(names.of(units), units, start, end, block):
                if at + period < ends.get(period, 0):
                    continue
                left, right = reach(codes, at, period)
                ends[period] = right
                if right - left >= max(LEAST, PERIODS * period):
                    found.append((left, right - left, period))
        block *= 2
    return sorted(found)


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run has after its first period."""
    if not found:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int32)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    kept = np.append(np.flatnonzero(np.cumsum(edges[:-1]) == 0), len(words))
    jumps = np.flatnonzero(np.diff(kept, prepend=-2) != 1).tolist()
    parts = [words[int(kept[a]) : int(kept[b - 1]) + 1] for a, b in pairwise([*jumps, len(kept)]) if kept[a] < len(words)]
    return b" ".join(word for part in parts for word in part)


def _columns(texts: list[str | None]) -> list[list]:
    counts, found, left = [], [], []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").split()  # of bytes: ASCII white space alone parts words
        own = runs(words)
        counts.append(len(words))
        found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
        left.append(collapsed(words, own).decode("utf-8", "surrogatepass"))
    return [counts, found, left]


def with_runs(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with the number of words, the runs (start, length and period, in words) in order, and the text without repeated periods."""
    of = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
    fields = [(N_WORDS, T.LongType()), (RUNS, RUN), (COLLAPSED, T.StringType())]
    return append_columns(docs, text_column, fields, _columns, [pa.int64(), of, pa.string()])
