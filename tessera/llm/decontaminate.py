"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded run of documents in one task. Its FM-index holds the documents as sequences of
word numbers; the benchmark's windows are searched backward, all at once, through the ranks of a
wavelet tree over the Burrows-Wheeler transform, occurrences are located by walking to sampled
suffix positions, and overlapping occurrences merge into removal spans.

Words that no benchmark text has cannot lie inside an occurrence, so the index holds only the runs
of benchmark words that are as long as the shortest window; nothing is lost by that.

Tasks turn the benchmark into blocks of a bounded number of windows and write them to the shared
folder; the driver knows their paths alone. A shard is read and indexed once, over the words of all blocks,
and each block after the other is searched in it, so that a larger benchmark costs time and not memory.

Edge cases: null and word-less texts have no words and no hits; a benchmark text without words gives
no window, one with a null id marks words but is no item; equal windows of several items count for
each; a very long text is split to words in slices and is a shard of its own, a very long benchmark
text is cut into blocks that share the words at their ends; an empty table on either side gives no
rows or no hits; other columns pass through untouched.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import OWN, sliced
from tessera.shared import materialize, shared_path

#: Words of a window.
WINDOW = 13
#: Bytes of text in a shard, windows in a block of the benchmark, and bytes of a text split to words at once.
SHARD_BYTES, BLOCK_WINDOWS, SLICE = 16 << 20, 200_000, 1 << 20
#: Every so many text positions the suffix array is kept.
SAMPLED = 8
#: A word is a run of letters and digits, and of anything outside ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Maps A-Z to a-z and every ASCII character outside words to a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

N_WORDS, N_HIT, ITEMS, SPANS = f"{OWN}n_words", f"{OWN}n_hit", f"{OWN}items", f"{OWN}spans"
FIELDS = [(N_WORDS, T.LongType()), (N_HIT, T.LongType()), (ITEMS, T.ArrayType(T.StringType())), (SPANS, T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]
ARROW = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def numbers(text: str | None, number: Callable[[bytes], int]) -> np.ndarray:
    """The number of each word."""
    data, parts, at = (text or "").encode("utf-8", "surrogatepass").translate(FOLD), [], 0
    while at < len(data) or not parts:
        end = data.find(b" ", at + SLICE)
        own = data[at : end if end >= 0 else len(data)].split()
        parts.append(np.fromiter(map(number, own), np.int32, len(own)))
        at = end if end >= 0 else len(data)
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def numbering() -> defaultdict[bytes, int]:
    """Numbers words from 1 as they come."""
    return defaultdict(count(1).__next__)


@dataclass
class Block:
    """Windows of some benchmark texts: their words (numbered from 1), windows by length, and each window's items.

    items has, by length, the places in `numbers` at which each window's items begin, and the items' numbers.
    """

    words: list[bytes] = field(default_factory=list)
    windows: dict[int, np.ndarray] = field(default_factory=dict)
    items: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)


def _block(texts: list[tuple[str | None, np.ndarray]], words: list[bytes], window: int) -> Block:
    block = Block(words, names=sorted({item for item, _ in texts if item is not None}))
    known = {name: n for n, name in enumerate(block.names)}
    by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
    for item, own in texts:
        n = min(window, len(own))
        by_length.setdefault(n, []).append((known.get(item, -1), np.lib.stride_tricks.sliding_window_view(own, n)))
    for n, found in sorted(by_length.items()):
        every = np.concatenate([w for _, w in found])
        items = np.repeat([item for item, _ in found], [len(w) for _, w in found])
        order = np.lexsort((items, *every.T))
        every, items = every[order], items[order]
        new = np.concatenate([[True], (every[1:] != every[:-1]).any(axis=1)])
        number = np.cumsum(new) - 1
        told = (items >= 0) & (new | np.concatenate([[True], items[1:] != items[:-1]]))
        block.windows[n] = every[new].astype(np.int64)
        block.items[n] = np.searchsorted(number[told], np.arange(number[-1] + 2)), items[told]
    return block


def _write_blocks(batches: Iterator[pa.RecordBatch], folder: str, window: int, most: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    paths: list[str] = []
    texts, numbered, size = [], numbering(), 0

    def flush() -> None:
        nonlocal texts, numbered, size
        name = f"{task.partitionId():06d}-{len(paths):04d}-{task.taskAttemptId()}"
        with fs.open_output_stream(f"{root}/{name}") as out:
            block = _block(texts, list(numbered), window)
            out.write(pickle.dumps((block.words, min(block.windows))) + pickle.dumps(block))
        paths.append(f"{folder}/{name}")
        texts, numbered, size = [], numbering(), 0

    for batch in sliced(batches):
        for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = words(text)
            windows = max(1, len(own) - window + 1) if own else 0
            for first in range(0, windows, most):
                here = own[first : first + min(most, windows - first) + window - 1]
                texts.append((item, np.fromiter(map(numbered.__getitem__, here), np.int32, len(here))))
                size += len(here)
                if size >= most:
                    flush()
    if texts:
        flush()
    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])


def blocks(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text", window: int = WINDOW, most: int = BLOCK_WINDOWS) -> list[str]:
    """Paths of the benchmark's blocks, of fewer than twice `most` windows each, in the shared folder."""
    rows = benchmark.select(F.col(id_column).cast("string"), F.col(text_column).cast("string"))
    folder = shared_path(benchmark.sparkSession, "benchmark")
    made = materialize(rows.mapInArrow(partial(_write_blocks, folder=folder, window=window, most=most), "path string"), "blocks")
    return sorted(r.path for r in made.collect())  # a path for each `most` windows


@lru_cache(maxsize=1)
def load(path: str) -> Block:
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as file:
        pickle.load(file)
        return pickle.load(file)


def vocabulary(path: str) -> tuple[list[bytes], int]:
    """The words of a block and its shortest window; no more of it is read."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as file:
        return pickle.load(file)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling. The last symbol must be smaller than all others."""
    rank, n, k = np.unique(text, return_inverse=True)[1].astype(np.int64), len(text), 1
    while True:
        second = np.zeros(n, np.int64)
        second[:-k or None] = rank[k:] + 1 if k < n else 0
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank, k = new, 2 * k
        if rank[order[-1]] == n - 1 or k >= 2 * n:
            return order


class WaveletTree:
    """Ranks of symbols: for each binary digit a level of packed bits, with the ones before every 64 of them."""

    def __init__(self, symbols: np.ndarray, largest: int) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        for digit in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            bits = (symbols >> digit & 1).astype(bool)
            packed = np.packbits(np.concatenate([bits, np.zeros(64 - len(bits) % 64, bool)]), bitorder="little").view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]).astype(np.int32)
            self.levels.append((digit, packed, ones, int((~bits).sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        first = np.zeros_like(place)
        for digit, packed, before, zeros in self.levels:
            one = (symbol >> digit) & 1 == 1
            ones = lambda at: before[at >> 6] + np.bitwise_count(packed[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)  # noqa: B023, E731
            in_place, in_first = ones(place), ones(first)
            place = np.where(one, zeros + in_place, place - in_place)
            first = np.where(one, zeros + in_first, first - in_first)
        return place - first


class FMIndex:
    """An index of `text`, numbers from 1 with 0 for breaks."""

    def __init__(self, text: np.ndarray, largest: int, sampled: int = SAMPLED) -> None:
        text = np.concatenate([text + 1, [0]])  # breaks are 1, the end is 0
        order = suffix_array(text)
        self.n, self.bwt = len(text), text[order - 1]
        self.tree = WaveletTree(self.bwt, largest + 1)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=largest + 3))]).astype(np.int64)
        self.kept = order % sampled == 0
        self.kept_rank = np.cumsum(self.kept) - 1
        self.samples = order[self.kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end row of the suffixes that start with each pattern."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, j] + 1
            low[alive] = self.before[c] + self.tree.rank(c, low[alive])
            high[alive] = self.before[c] + self.tree.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
        found = np.zeros(len(patterns), bool)
        found[alive] = True
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row's suffix: steps back to a sampled one, plus the steps."""
        out, at, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        rows = rows.copy()
        while len(at):
            done = self.kept[rows]
            out[at[done]] = self.samples[self.kept_rank[rows[done]]] + steps
            at, rows = at[~done], rows[~done]
            c = self.bwt[rows]
            rows = self.before[c] + self.tree.rank(c, rows)
            steps += 1
        return out


@dataclass
class Shard:
    """The index of a shard's runs of benchmark words, the place in the shard of each of its symbols, and the number there of each of the shard's words."""

    index: FMIndex
    place: np.ndarray
    number: np.ndarray

    def occurrences(self, block: Block, known: dict[bytes, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Window length, window numbers and places of all occurrences of a block's windows."""
        number = np.concatenate([[0], self.number[_numbers_of(block.words, known)]])
        for n, windows in block.windows.items():
            patterns = number[windows]
            there = np.flatnonzero((patterns > 0).all(axis=1))  # windows with words that the shard lacks are nowhere in it
            low, high = self.index.search(patterns[there])
            counts = high - low
            rows = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            yield n, np.repeat(there, counts), self.place[self.index.locate(rows)]


def _numbers_of(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(known.get, words, repeat(0)), np.int64, len(words))


def indexed(symbols: np.ndarray, known: dict[bytes, int], paths: tuple[str, ...]) -> Shard | None:
    """One index of the shard for all blocks: of the runs of words of any block that are as long as the shortest window of all. None without such runs."""
    wanted, least = np.zeros(len(known) + 1, bool), WINDOW
    for path in paths:
        words, shortest = vocabulary(path)
        wanted[_numbers_of(words, known)] = True
        least = min(least, shortest)
    wanted[0] = False
    number = np.cumsum(wanted) * wanted
    own = number[symbols]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], own > 0, [0]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return None
    lengths = ends - starts + 1  # with the break that follows
    first = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) + np.repeat(starts - first, lengths)
    text = np.concatenate([own, [0]])[place]
    text[first + lengths - 1] = 0
    return Shard(FMIndex(text, int(number.max())), place, number)


def _marked(symbols: np.ndarray, ends: np.ndarray, known: dict[bytes, int], paths: tuple[str, ...]) -> tuple[np.ndarray, list, list]:
    """Hit words, item lists and spans of each document; documents end at `ends` in symbols, whose words are `known`."""
    edge = np.zeros(len(symbols) + 1, np.int64)
    items: list[set[str]] = [set() for _ in ends]
    starts = np.concatenate([[0], ends[:-1]])
    shard = indexed(symbols, known, paths)
    for path in paths if shard else ():
        block = load(path)
        for n, window, place in shard.occurrences(block, known):
            np.add.at(edge, place, 1)
            np.add.at(edge, place + n, -1)
            first, told = block.items[n]
            pairs = np.unique(np.searchsorted(ends, place, "right") * np.int64(len(first)) + window)
            for doc, w in zip((pairs // len(first)).tolist(), (pairs % len(first)).tolist(), strict=True):
                items[doc].update(block.names[k] for k in told[first[w] : first[w + 1]])
    hit = np.cumsum(edge)[:-1] > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[ends] - total[starts]
    spans: list[list[dict[str, int]]] = [[] for _ in ends]
    for doc in np.flatnonzero(n_hit).tolist():
        turns = np.flatnonzero(np.diff(np.concatenate([[0], hit[starts[doc] : ends[doc]], [0]]).astype(np.int8))).tolist()
        spans[doc] = [{"start": a, "end": b} for a, b in zip(turns[::2], turns[1::2], strict=True)]
    return n_hit, [sorted(x) for x in items], spans


def _search(batches: Iterator[pa.RecordBatch], paths: tuple[str, ...], column: str, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []
    size, known, stop = 0, numbering(), np.zeros(1, np.int32)

    def flush() -> Iterator[pa.RecordBatch]:
        # A break after each document, so that no occurrence crosses from one into the next.
        counts = np.array([len(x) for _, own in held for x in own], np.int64)
        symbols = np.concatenate([x for _, own in held for s in own for x in (s, stop)])
        n_hit, items, spans = _marked(symbols, np.cumsum(counts + 1), known, paths)
        at = 0
        for batch, own in held:
            here = slice(at, at + len(own))
            arrays = [pa.array(v, t) for v, t in zip((counts[here], n_hit[here], items[here], spans[here]), ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *(f for f, _ in FIELDS)])
            at += len(own)

    for batch in sliced(batches):
        if batch.num_rows:
            texts = batch.column(batch.schema.get_field_index(column))
            held.append((batch, [numbers(t.as_py(), known.__getitem__) for t in texts]))
            size += batch.nbytes
        if size >= shard_bytes:
            yield from flush()
            held, size, known = [], 0, numbering()
    if held:
        yield from flush()


def find(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs with the words, hit words, items and merged removal spans (in words, end exclusive) of each text."""
    paths = tuple(blocks(benchmark, window=window, most=block_windows))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in FIELDS)])
    return docs.mapInArrow(partial(_search, paths=paths, column=text_column, shard_bytes=shard_bytes), schema)


def contaminated() -> Column:
    """At least a twentieth of the words is hit."""
    return (F.col(N_HIT) > 0) & (20 * F.col(N_HIT) >= F.col(N_WORDS))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of spans and what stands between them."""
    places = [m.span() for m in WORD.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return "".join([*out, text[at:]])
