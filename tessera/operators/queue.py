"""A work queue as an append-only log of states: what is pending, what a worker takes, what a dead worker left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import logs

# The states of a task.
PENDING, RUNNING, DONE, FAILED = "pendiente", "en_curso", "hecha", "fallida"


def current(log: DataFrame) -> DataFrame:
    """The last state of each task of log (task, kind, state, at)."""
    return logs.latest(log, ["task"], ["at"])


def _told(tasks: DataFrame, state: str, at: int) -> DataFrame:
    return tasks.select("task", "kind", F.lit(state).alias("state"), F.lit(at).cast("long").alias("at"))


def taken(log: DataFrame, most: int, at: int, kind: str | None = None) -> DataFrame:
    """Rows to append: the oldest pending tasks (of a kind, if one is named) are running from now on."""
    pending = current(log).where(F.col("state") == PENDING)
    pending = pending if kind is None else pending.where(F.col("kind") == kind)
    return _told(pending.orderBy("task").limit(most), RUNNING, at)


def finished(log: DataFrame, results: DataFrame, at: int) -> DataFrame:
    """Rows to append: tasks of results (task, ok) are done or have failed."""
    known = current(log).join(results, "task")
    return known.select("task", "kind", F.when(F.col("ok"), DONE).otherwise(FAILED).alias("state"), F.lit(at).cast("long").alias("at"))


def requeued(log: DataFrame, at: int) -> DataFrame:
    """Rows to append: what a dead worker left running is pending again."""
    return _told(current(log).where(F.col("state") == RUNNING), PENDING, at)
