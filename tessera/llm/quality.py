"""Quality scores by compression: zstandard dictionaries of good and of bad labelled text.

A text is cut into blocks; each is compressed with both dictionaries. The difference of the
compressed sizes over their sum, calibrated by a logistic curve, is the score: the better dictionary
explains the text. Dictionaries and curve are fitted on the driver from a bounded sample of labelled
rows, in which texts that are too long stand by blocks from all over them; every text is scored whole, block by block.

Edge cases: null and empty texts score as a difference of zero; with one class of labels or none the
score is that class's share everywhere (a half without labels); repeated rows each get their score, and equal texts equal ones; a very long text is scored whole;
an empty table gives no rows; other columns pass through untouched.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import OWN, append_columns
from tessera.shared import materialize

#: Bytes of a compressed block and of a dictionary; zstandard's level.
BLOCK, DICTIONARY, LEVEL = 512, 256 << 10, 3
#: The training sample: labelled rows of each class, and bytes of all of them, at most. If their texts have more bytes, the longest
#: stand in the sample by blocks evenly spread over the whole text; rows of a repeated id beyond the bound are not in it.
ROWS, BYTES = 3000, 64 << 20
#: Blocks that one dictionary is trained from at most, drawn from all blocks of the sample alike.
BLOCKS = 40_000
#: From this score on a text counts as good.
THRESHOLD = 0.3
SCORE = f"{OWN}score"


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    base: float


def held_out(doc_id: Column) -> Column:
    """A fifth of the ids, never used for fitting; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def blocks(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


@lru_cache(maxsize=4)
def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


def difference(text: str | None, model: Model) -> float:
    """(compressed with bad - compressed with good) / (their sum), over all blocks."""
    good, bad = compressor(model.good), compressor(model.bad)
    own = blocks(text)
    g, b = sum(len(good.compress(x)) for x in own), sum(len(bad.compress(x)) for x in own)
    return (b - g) / (b + g) if own else 0.0


def score(text: str | None, model: Model) -> float:
    x = model.slope * (difference(text, model) if model.good else 0.0) + model.base
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def sample(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, rows: int = ROWS, most: int = BYTES) -> list[tuple[str, int]]:
    """(text, label) of the labelled rows whose ids hash lowest, outside the held-out fifth."""
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).where(~held_out(F.col("id")) & F.col("label").isin(0, 1))
    known = known.withColumn("order", F.xxhash64(F.col("id").cast("string")))
    chosen = known.where("label = 1").orderBy("order", "id").limit(rows).unionByName(known.where("label = 0").orderBy("order", "id").limit(rows))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    # 2 * rows ids are broadcast, and as many rows come back, the longest as spread blocks so that the bytes of all fit the bound.
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    found = materialize(texts.join(F.broadcast(chosen), "id").select("order", "id", data.alias("data"), "label"), "labelled")
    sizes = found.groupBy(F.length(F.bin(F.octet_length("data").cast("long"))).alias("bits")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("data")).alias("bytes"))
    share = cut([(r.bits, r.n, r.bytes) for r in sizes.collect()], most)  # one row for each power of two
    out, size = [], 0
    for row in found.orderBy("order", "id").select(spread_blocks(F.col("data"), share).alias("parts"), "label").toLocalIterator():
        data = b"".join(row.parts)
        if (size := size + len(data)) > most:  # only where rows of one repeated id are more than the bound has blocks
            break
        out.append((data.decode("utf-8", "ignore"), row.label))
    return out


def spread_blocks(data: Column, share: int) -> Column:
    """data in parts: whole if it has no more than `share` bytes, else so many blocks of it, the first, the last and others at even distances."""
    length, n = F.octet_length(data), max(1, share // BLOCK)
    at = lambda i: F.lit(1) + (i.cast("long") * (length - BLOCK) / max(1, n - 1)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.lit(min(n, BLOCKS) - 1)), lambda i: F.substring(data, at(i), F.lit(BLOCK)))
    return F.when(length <= share, F.array(data)).otherwise(blocks)


def cut(sizes: list[tuple[int, int, int]], most: int) -> int:
    """The bytes that a text may have at most so that all fit in most; sizes: bits of a length, how many texts, their bytes."""
    above, below = 0, sum(b for *_, b in sizes)
    if below <= most:
        return (1 << 31) - 1
    ordered = sorted(sizes, reverse=True)
    for (_, n, own), shorter in zip(ordered, [*(b for b, *_ in ordered[1:]), 0], strict=True):
        above, below = above + n, below - own
        if (head := (most - below) // above) >= 1 << shorter:  # the others are shorter than that
            return max(BLOCK, head)
    return BLOCK


def train(rows: list[tuple[str, int]], share: float, seed: int = 7) -> Model:
    """Dictionaries from four fifths of rows, the curve from the others; share: the share of good labels of all."""
    rng = random.Random(seed)
    rows = sorted(set(rows))
    rng.shuffle(rows)
    fit, rest = [r for k, r in enumerate(rows) if k % 5], [r for k, r in enumerate(rows) if k % 5 == 0]
    prior = math.log(max(share, 1e-3) / max(1 - share, 1e-3))
    dictionaries = []
    for label in (1, 0):
        own = [b for text, l in fit if l == label for b in blocks(text)]
        rng.shuffle(own)
        try:
            dictionaries.append(zstandard.train_dictionary(min(DICTIONARY, max(256, sum(map(len, own)) // 4)), own[:BLOCKS]).as_bytes())
        except zstandard.ZstdError:  # too little text to train from
            return Model(b"", b"", 0.0, prior)
    model = Model(*dictionaries, 1.0, 0.0)
    x, y = np.array([difference(t, model) for t, _ in rest]), np.array([l for _, l in rest], float)
    if len(set(y)) < 2:
        return Model(b"", b"", 0.0, prior)
    # Weighted so that the classes count as in all labelled rows, however many of each were sampled.
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    scale = float(np.abs(x).max()) or 1.0
    design, beta = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):  # Newton's method, with a small ridge on the slope
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - np.array([1e-2 * beta[0], 0])
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return Model(*dictionaries, float(beta[0] / scale), float(beta[1]))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Model:
    own = labels.where(~held_out(F.col(id_column)) & F.col(label_column).isin(0, 1))
    share = own.agg(F.avg(F.col(label_column).cast("double"))).first()[0]
    return train(sample(docs, labels, id_column, text_column, label_column), 0.5 if share is None else share)


def with_scores(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """docs with each text's score."""
    seen = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size
    return append_columns(docs, text_column, [(SCORE, T.DoubleType())], lambda texts: [[score(t, seen.value) for t in texts]], [pa.float64()])
