"""Seams for models: embedders, generators, a topic classifier, question search. Rules stand in where there is none.

A model comes as a loader, which runs once in each Python worker task and gives a function on batches.
A generator writes questions and wordings; it is never a judge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import replies, text

Embed = Callable[[list[str]], np.ndarray]
#: Prefixes of what is embedded.
QUERY, PASSAGE = "query: ", "passage: "
#: Dimensions of the vectors that words are hashed to.
SIZE = 256


def hashed(texts: list[str], size: int = SIZE) -> np.ndarray:
    """Words' hashes as vectors of length one: no model, but texts of like words are near each other."""
    out = np.zeros((len(texts), size))
    for n, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = xxhash.xxh64_intdigest(w.encode())
            out[n, h % size] += 1 if h >> 63 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embedded(rows: DataFrame, column: str, name: str, load: Callable[[], Embed] = lambda: hashed, prefix: str = PASSAGE, batch: int = 64) -> DataFrame:
    """rows with `name`, the vector (of length one) of each text; a null text has none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = load()
        for part in parts:
            texts = part[column]
            some = texts.notna().to_numpy()
            own = [prefix + t for t in texts[some]]
            found = [np.asarray(embed(own[i : i + batch]), float) for i in range(0, len(own), batch)]
            vectors = np.concatenate(found) if found else np.zeros((0, 1))
            vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
            own_vectors = iter(vectors)
            yield part.assign(**{name: pd.Series([next(own_vectors).tolist() if s else None for s in some], index=part.index, dtype=object)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, {name} array<double>")


def completed(rows: DataFrame, prompt: Column, name: str, load: Callable[[], Callable[[list[str]], list[str | None]]], batch: int = 16) -> DataFrame:
    """rows with `name`, what a generator writes for each prompt; a generator that fails on a batch gives nulls for it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        write = load()
        for part in parts:
            out: list[str | None] = []
            for i in range(0, len(part), batch):
                asked = part["_prompt"].iloc[i : i + batch].tolist()
                try:
                    out += write(asked)
                except Exception:  # a model's failure costs its batch, not the job
                    out += [None] * len(asked)
            yield part.drop(columns="_prompt").assign(**{name: pd.Series(out, index=part.index, dtype=object)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.withColumn("_prompt", prompt).mapInPandas(run, f"{schema}, {name} string")


def questions(rows: DataFrame, key: str, reply: str, most: int = 3) -> DataFrame:
    """key, n, question: the questions that a generator's reply asks, to search with."""
    return rows.select(key, F.posexplode(replies.questions(F.col(reply), most)).alias("n", "question"))


def refined_topic(claim: Column, label: Column, score: Column, least: float = 0.5) -> Column:
    """The topic by patterns; where these tell none, a classifier's label if it is sure enough and a topic at all."""
    known = label.isin([*text.TOPICS]) & (score >= least)
    return text.let(text.topic(claim), lambda plain: F.when((plain == "general") & known, label).otherwise(plain))
