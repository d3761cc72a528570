"""Search in rounds: what is found asks on, and what the further questions find joins it, each passage once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.shared import materialize

#: From queries (item_id, text) to passages (item_id, doc_id, score, rank), and from passages that are new to further queries.
Retrieve = Callable[[DataFrame], DataFrame]
Ask = Callable[[DataFrame], DataFrame]


def in_rounds(asked: DataFrame, retrieve: Retrieve, ask: Ask, rounds: int = 2) -> DataFrame:
    """item_id, doc_id and round of all passages, by the round that found them first.

    A fixed number of joins: each round retrieves for the questions of the last one's new passages, and leaves out what
    an item has already. An item without new passages asks nothing, so that further rounds cost nothing for it.
    """
    seen = None
    for step in range(1, rounds + 1):
        found = retrieve(asked).select("item_id", "doc_id", "score", "rank").withColumn("round", F.lit(step))
        if seen is not None:
            found = found.join(seen.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_anti")
        found = materialize(found, f"round-{step}")
        seen = found if seen is None else seen.unionByName(found)
        if step < rounds:
            asked = materialize(ask(found).select("item_id", "text"), f"questions-{step}")
    return seen.select("item_id", "doc_id", "round")
