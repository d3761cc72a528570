"""Streams with state of their own: sources that rest after failures, and the latest turns of conversations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Failures in a row after which a source rests, and for how many seconds; turns that are remembered.
FAILURES, REST, TURNS = 3, 300.0, 20
#: Seconds of the stream's own time by which records may be late, and twice which without one a source's state is dropped, or
#: a conversation's: more than a rest, and a day.
QUIET, FORGOTTEN = 3600.0, 86_400.0
#: Watermarks begin at zero, and what is not later counts as late: so much is added to times, which may begin at zero too.
SHIFT = 86_400.0


def tried(seconds: list[float], ok: list[bool], failed: int = 0, until: float = 0.0, failures: int = FAILURES, rest: float = REST) -> tuple[list[bool], int, float]:
    """Which of a source's calls are made, with the failures in a row and the end of its rest afterwards."""
    made = []
    for at, fine in zip(seconds, ok, strict=True):
        made.append(at >= until)
        if not made[-1]:
            continue
        failed = 0 if fine else failed + 1
        if failed >= failures:
            failed, until = 0, at + rest
    return made, failed, until


def cooldown(rows: DataFrame, failures: int = FAILURES, rest: float = REST, quiet: float = QUIET) -> DataFrame:
    """source, at, made of a stream (source string, at double in seconds, ok boolean).

    A batch's calls are taken in order of time, calls of earlier batches before them. A source that is not heard of
    for twice `quiet` seconds of the stream starts anew, so that the state holds live sources alone; calls that are
    later than `quiet` are dropped.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = pd.concat(list(parts)).sort_values("at", kind="stable")
        failed, until = state.get if state.exists else (0, 0.0)
        made, failed, until = tried(own["at"].tolist(), own["ok"].tolist(), failed, until, failures, rest)
        state.update((failed, until))
        _expires(state, own["at"].max() + quiet)
        yield pd.DataFrame({"source": key[0], "at": own["at"].tolist(), "made": made})

    timed = rows.withColumn("when", F.timestamp_seconds(F.col("at") + SHIFT)).withWatermark("when", f"{int(quiet * 1000)} milliseconds")
    return timed.groupBy("source").applyInPandasWithState(run, "source string, at double, made boolean", "failed int, until double", "append", GroupStateTimeout.EventTimeTimeout)


def recent(rows: DataFrame, most: int = TURNS, forgotten: float = FORGOTTEN) -> DataFrame:
    """conv_id and the last `most` turns, after each batch, of a stream (conv_id long, turn long, text string).

    If it tells when turns were said (at double, in seconds), a conversation without one for twice `forgotten` seconds of the
    stream is forgotten; without that, each conversation is kept.
    """
    timed = "at" in rows.columns

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        turns, texts = state.get if state.exists else ([], [])
        kept, last = list(zip(turns, texts, strict=True)), 0.0
        for part in parts:  # no more than `most` turns beside one part are held at a time
            kept = sorted([*kept, *((int(t), x or "") for t, x in zip(part["turn"], part["text"], strict=True))])[-most:]
            last = max(last, part["at"].max()) if timed else last
        state.update(([t for t, _ in kept], [x for _, x in kept]))
        if timed:
            _expires(state, last + forgotten)
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [[t for t, _ in kept]], "texts": [[x for _, x in kept]]})

    if timed:
        rows = rows.withColumn("when", F.timestamp_seconds(F.col("at") + SHIFT)).withWatermark("when", f"{int(forgotten * 1000)} milliseconds")
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return rows.groupBy("conv_id").applyInPandasWithState(run, "conv_id long, turns array<long>, texts array<string>", "turns array<long>, texts array<string>", "update", timeout)


def _expires(state: GroupState, at: float) -> None:
    """The state goes once the stream's time has passed `at`; a time that it has passed already is moved behind it."""
    state.setTimeoutTimestamp(max(int((at + SHIFT) * 1000), state.getCurrentWatermarkMs() + 1))
