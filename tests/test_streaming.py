"""Streams whose state outlives a batch, against the same rule over all rows at once."""

import random

from tessera.streaming import state


def streamed(spark, folder, schema, batches, transform, name, mode):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / "in" / str(k)))
        stream = transform(spark.readStream.schema(schema).parquet(str(folder / "in" / "*")))
        running = stream.writeStream.format("parquet" if mode == "append" else "memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder / "c"))
        running = running.option("path", str(folder / "out")) if mode == "append" else running
        running.trigger(availableNow=True).start().awaitTermination(90)
    return spark.read.parquet(str(folder / "out")).collect() if mode == "append" else None


def test_a_source_rests_after_three_failures():
    made, failed, until = state.tried([0, 1, 2, 3, 301, 303, 304], [False] * 3 + [True, True, False, True])
    assert made == [True, True, True, False, False, True, True] and (failed, until) == (0, 302.0)
    assert state.tried([0, 1, 2, 3], [False, False, True, False])[1:] == (1, 0.0)
    assert state.tried([], []) == ([], 0, 0.0)


def test_cooldown_carries_over_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), float(at), rng.random() < 0.3) for at in range(0, 4000, 20)]
    found = streamed(spark, tmp_path, "source string, at double, ok boolean", [rows[:90], rows[90:]], state.cooldown, "cooldown", "append")
    for source in "ab":
        own = [r for r in rows if r[0] == source]
        expected, _, _ = state.tried([r[1] for r in own], [r[2] for r in own])
        assert [r.made for r in sorted(found, key=lambda r: r.at) if r.source == source] == expected and not all(expected)


def test_recent_turns(spark, tmp_path):
    folder = tmp_path / "in"
    schema = "conv_id long, turn long, text string"
    for k in range(2):
        spark.createDataFrame([(c, t, None if t == 3 else f"{c}-{t}") for c in (1, 2) for t in range(k * 4, k * 4 + 4)], schema).coalesce(1).write.parquet(str(folder / str(k)))
    stream = state.recent(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*")), 5)
    seen = []
    running = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend((n, r.conv_id, r.turns, r.texts) for r in df.collect()))
    running.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(90)
    last = {c: (turns, texts) for _, c, turns, texts in sorted(seen)}
    assert last[1] == ([3, 4, 5, 6, 7], ["", "1-4", "1-5", "1-6", "1-7"]) and last[2][0] == [3, 4, 5, 6, 7]


def test_quiet_sources_and_conversations_leave_no_state(spark, tmp_path):
    """What is not heard of for twice the quiet time of the stream is dropped, with its failures; others stay."""

    def run(name, schema, transform, mode, rows):
        folder = tmp_path / name
        (folder / "in").mkdir(parents=True, exist_ok=True)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / "in" / str(len(list((folder / "in").iterdir())))))
        stream = transform(spark.readStream.schema(schema).parquet(str(folder / "in" / "*")))
        seen = []
        running = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", str(folder / "c")).trigger(availableNow=True).start()
        assert running.awaitTermination(120)
        return seen, running.lastProgress["stateOperators"][0]["numRowsTotal"]

    calls = lambda rows: run("calls", "source string, at double, ok boolean", lambda s: state.cooldown(s, quiet=100.0), "append", rows)
    assert calls([("a", 0.0, False), ("a", 1.0, False), ("b", 0.0, True)])[1] == 2
    assert calls([("c", 1000.0, True)])[1] == 1
    found, _ = calls([("a", 1001.0, False), ("a", 1002.0, True)])
    assert [r.made for r in found] == [True, True]
    turns = lambda rows: run("turns", "conv_id long, turn long, text string, at double", lambda s: state.recent(s, 2, forgotten=10.0), "update", rows)
    assert turns([(1, 0, "x", 0.0), (1, 1, "y", 1.0), (2, 0, "z", 2.0)])[1] == 2
    assert turns([(3, 0, "w", 500.0)])[1] == 1
    assert [r.turns for r in turns([(1, 2, "v", 501.0)])[0]] == [[2]]
