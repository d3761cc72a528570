"""Judges of pairs: a rule for tests and work without models, and the seam for a model in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.verdict import NEUTRAL, REFUTES, SUPPORTS

#: Takes rows with hypothesis and premise; gives them back with label and prob.
Judge = Callable[[DataFrame], DataFrame]


def rule(rows: DataFrame) -> DataFrame:
    """Neutral to a premise that calls itself inconclusive; a hypothesis with a negation is refuted, another one supported."""
    label = F.when(F.lower("premise").contains("inconcluso"), NEUTRAL).when(F.col("hypothesis").contains(" no "), REFUTES).otherwise(SUPPORTS)
    return rows.withColumn("label", label).withColumn("prob", F.lit(0.9))


def softmax(logits: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    scaled = logits / temperature
    shifted = np.exp(scaled - scaled.max(axis=1, keepdims=True))
    return shifted / shifted.sum(axis=1, keepdims=True)


def model(load: Callable[[], Callable[[list[str], list[str]], np.ndarray]], labels: tuple[str, ...] = (SUPPORTS, NEUTRAL, REFUTES), temperature: float = 1.0, batch: int = 8) -> Judge:
    """A judge from a loader of a model: (premises, hypotheses) -> logits, one column for each of labels.

    load runs once in each Python worker task; rows keep their order within a batch.
    """

    def judge(rows: DataFrame) -> DataFrame:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            predict = load()
            for part in parts:
                found = [softmax(np.asarray(predict(part["premise"].iloc[i : i + batch].tolist(), part["hypothesis"].iloc[i : i + batch].tolist()), float), temperature) for i in range(0, len(part), batch)]
                mass = np.concatenate(found) if found else np.zeros((0, len(labels)))
                yield part.assign(label=[labels[k] for k in mass.argmax(axis=1)], prob=mass.max(axis=1, initial=0.0))

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.mapInPandas(run, f"{schema}, label string, prob double")

    return judge
