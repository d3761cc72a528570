"""Sources behind a connector, as rows and as a source of its own; archives that tasks write."""

import io
import json
import time
import zipfile

from tessera.sources import archives, connector


def source():
    """A function of this call, so that it goes to workers whole."""

    def fetch(query, lang):
        if query == "down":
            raise OSError(query)
        return [] if query == "none" else [{"q": query, "lang": lang}, {"q": "é"}]

    return fetch


def test_records_of_queries(spark):
    queries = spark.createDataFrame([(1, "one", "es"), (2, "down", "es"), (3, "none", None), (4, None, None)], "k int, query string, lang string")
    found = sorted((r.n, r.query, r.payload) for r in connector.records(queries, "k", "s", source()).collect() if r.n < 4)
    assert found == [(1, "one", '{"q": "one", "lang": "es"}'), (1, "one", '{"q": "é"}')]


def test_a_source_of_its_own(spark):
    spark.dataSource.register(connector.data_source("asked", source(), 2))
    rows = spark.read.format("asked").option("queries", json.dumps(["a", "down", "b", "none", "c"])).option("lang", "en").load()
    assert rows.rdd.getNumPartitions() == 3
    assert sorted((r.n, r.query, json.loads(r.payload).get("lang")) for r in rows.collect() if "lang" in r.payload) == [(0, "a", "en"), (2, "b", "en"), (4, "c", "en")]


def test_a_source_that_grows_is_polled(spark, tmp_path):
    """Each record once, over polls that fail, batches of bounded size and a restart of the stream."""
    count = str(tmp_path / "count")

    def newest():
        with open(count) as file:
            return int(file.read())  # fails where the file says "down"

    def fetch(start, end):
        return [{"v": n * n} for n in range(start, end)]

    spark.dataSource.register(connector.polled_source("growing", newest, fetch, most=40, slice_size=15, rest=0.2))

    def run(steps):
        rows = spark.readStream.format("growing").load()
        running = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()
        for said, until in steps:
            with open(count, "w") as file:
                file.write(said)
            for _ in range(300):
                time.sleep(0.2)
                if running.exception() is None and sum(p["numInputRows"] for p in running.recentProgress) >= until:
                    break
        time.sleep(0.5)
        running.stop()

    run([("100", 100), ("down", 100), ("130", 130)])
    run([("150", 20)])
    found = sorted((r.n, json.loads(r.payload)["v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == [(n, n * n) for n in range(150)]


def test_archives_that_are_written_again(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x/1.txt", b"one"), ("a", "2.json", b"{}"), ("b", "x/3.txt", b"")], "archive string, name string, content binary")
    for _ in range(2):
        archives.write(rows, str(tmp_path / "z"))
    assert sorted(p.name for p in (tmp_path / "z").iterdir()) == ["a.zip", "b.zip"]
    assert zipfile.ZipFile(io.BytesIO((tmp_path / "z" / "a.zip").read_bytes())).namelist() == ["2.json", "x/1.txt"]
    assert sorted((r.name, r.content) for r in archives.members(spark, str(tmp_path / "z"), "x/*").collect()) == [("x/1.txt", b"one"), ("x/3.txt", b"")]
