"""Seams for models, archives, the audit stream, permissions and answers."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import models, text, wording
from tessera.operators import permissions, verdict
from tessera.sources import archives
from tessera.streaming import events


def test_embedder_takes_prefixes_and_nulls(spark):
    rows = spark.createDataFrame([(1, "the red house"), (2, "the red houses"), (3, None), (4, "quite other things")], "id long, text string").coalesce(1)
    found = {r.id: r.v for r in models.embedded(rows, "text", "v").collect()}
    assert found[3] is None and all(abs(np.linalg.norm(found[n]) - 1) < 1e-9 for n in (1, 2, 4))
    assert np.dot(found[1], found[2]) > np.dot(found[1], found[4])

    def load():
        return lambda texts: np.array([[len(t), 0.0] for t in texts])

    assert {tuple(r.v) for r in models.embedded(rows.where("id < 3"), "text", "v", load, models.QUERY).collect()} == {(1.0, 0.0)}
    assert models.embedded(rows.where("false"), "text", "v").count() == 0


def test_generator_failures_cost_their_batch(spark):
    rows = spark.createDataFrame([(n, f"t{n}") for n in range(6)], "id long, text string").coalesce(1).sortWithinPartitions("id")

    def load():
        def write(prompts):
            if any("t3" in p for p in prompts):
                raise ValueError
            return [f"1. Who wrote {p}, in truth? 2. {p}" for p in prompts]

        return write

    found = models.completed(rows, F.concat(F.lit("ask "), "text"), "reply", load, batch=2)
    told = {r.id: r.reply for r in found.collect()}
    assert told[2] is told[3] is None and told[0].startswith("1. Who wrote ask t0")
    assert [r.question for r in models.questions(found.where("id = 0"), "id", "reply").collect()] == ["Who wrote ask t0, in truth?"]


def test_refined_topics(spark):
    rows = [("Algo pasa aquí", "medicina", 0.7), ("Algo pasa aquí", "medicina", 0.4), ("Algo pasa aquí", "other", 0.9), ("La vacuna sirve", "ciencia", 0.9)]
    found = spark.createDataFrame(rows, "c string, l string, s double").select(models.refined_topic(F.col("c"), F.col("l"), F.col("s")).alias("t"))
    assert [r.t for r in found.collect()] == ["medicina", "general", "general", "medicina"]


def test_members_of_archives(spark, tmp_path):
    for n in range(2):
        with zipfile.ZipFile(tmp_path / f"{n}.zip", "w") as z:
            z.writestr(f"data/{n}.json", "x" * n)
            z.writestr("readme.md", "no")
    found = archives.members(spark, str(tmp_path), "data/*.json").collect()
    assert sorted((r["name"], r["size"], bytes(r["content"])) for r in found) == [("data/0.json", 0, b""), ("data/1.json", 1, b"x")]


def test_audit_stream_counts_decisions(spark, tmp_path):
    rows = [{"ts": f"2024-01-01T0{n % 3}:10:00Z", "herramienta": "Leer", "argumento": "a", "decision": "permitir" if n % 2 else "denegar", "modo": "plan"} for n in range(12)]
    for n in range(3):
        (tmp_path / f"{n}.json").write_text("\n".join([*(json.dumps(r) for r in rows[n * 4 : n * 4 + 4]), "{broken"]) + "\n")
    running = events.decisions(events.audit(spark, str(tmp_path))).writeStream.format("memory").queryName("audit_counts").outputMode("complete").trigger(availableNow=True).start()
    running.awaitTermination(60)
    found = spark.table("audit_counts").collect()
    assert sum(r.n for r in found) == 12 and len(found) == 6 and {r.n for r in found} == {2}


def test_bounded_shuffle_keeps_rows_near(spark):
    rows = spark.range(0, 5000, 1, 1)
    found = [r.id for r in events.shuffled(rows, 300, 5).collect()]
    assert sorted(found) == list(range(5000)) and found != sorted(found)
    assert found == [r.id for r in events.shuffled(rows, 300, 5).collect()]


def test_rules_of_permissions(spark):
    for broken in ("Ejecutar git", "Volar(x)", ""):
        with pytest.raises(ValueError):
            permissions.rule("permitir", broken)
    told = {"src/**": ["/w/src/a/b.py"], "src/*": ["/w/src/a"], "./a?c": ["/w/abc"], "//etc/*": ["/etc/x"], "~/n": ["/root/n"]}
    paths = ["/w/src/a/b.py", "/w/src/a", "/w/abc", "/etc/x", "/root/n", "/w/other"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    for pattern, fits in told.items():
        found = [r.p for r in rows.where(F.col("p").rlike(permissions.glob(pattern, "/w"))).collect()]
        assert set(fits) <= set(found) and "/w/other" not in found, pattern
    parts = spark.createDataFrame([("a 'x;y' && b | c; d & e || f",), ("a \"b",), ("  ",)], "c string").select(permissions.commands(F.col("c")).alias("p"))
    assert [r.p for r in parts.collect()] == [["a 'x;y'", "b", "c", "d", "e", "f"], ['a "b'], []]


def test_answers_say_what_the_verdict_is(spark):
    rows = spark.createDataFrame([("es", verdict.REFUTED, 0.667, 3), ("xx", verdict.INSUFFICIENT, 0.0, 4)], "lang string, v string, c double, n int")
    voice = F.struct(F.lit("a.org").alias("domain"), F.lit(" text ").alias("text"), F.lit("https://a.org").alias("url"))
    none = F.lit(None).cast("struct<domain:string,text:string,url:string>")
    found = [r.a for r in rows.select(wording.concise(F.col("lang"), F.col("v"), F.col("c"), F.col("n"), none, voice).alias("a")).collect()]
    assert found[0] == "No — la evidencia lo refuta: a.org señala que «text…» (confianza 67%; https://a.org)"
    assert found[1].startswith("There is not enough evidence") and "(4 passage(s)" in found[1]


def test_passages_in_other_languages_pass(spark):
    rows = spark.createDataFrame([("the moon landing happened in july", "unrelated words entirely", True), ("the moon landing happened in july", "unrelated words entirely", False)], "f string, p string, o boolean")
    assert [r.k for r in rows.select(text.probative(F.col("f"), F.col("p"), F.col("o")).alias("k")).collect()] == [True, False]


def test_permissions_of_long_commands_and_odd_paths(spark):
    """A megabyte of command with and without quotes; a line end is part of a path."""
    long = ["ls " + "a" * 1_000_000, "ls " + "'x;y' " * 200_000, "ls; " * 100_000 + "rm -rf /", 'ls "' + "a;" * 300_000, "ls && " * 100_000 + "ls"]
    sizes = [len(r.p) for r in spark.createDataFrame([(c,) for c in long], "c string").select(permissions.commands(F.col("c")).alias("p")).collect()]
    assert sizes == [1, 1, 100_001, 1, 100_001]
    rules = [permissions.rule("permitir", "Leer(docs/*.txt)"), permissions.rule("denegar", "Escribir(a/**)"), permissions.rule("permitir", "Ejecutar(ls *)")]
    asked = [("Ejecutar", long[0], "permitir"), ("Ejecutar", long[2], "denegar"), ("Escribir", "/w/docs/a.txt\n", "preguntar"), ("Escribir", "/w/a/b", "denegar"), ("Escribir", "/w/a/b\n", "preguntar"), ("Escribir", "/w/a/b\r", "denegar")]
    rows = spark.createDataFrame(asked, "t string, a string, want string")
    for r in rows.select("want", permissions.decision(F.col("t"), F.col("a"), F.lit("preguntar"), rules, "/w").alias("d")).collect():
        assert r.d == r.want
    assert spark.createDataFrame([("/w/docs/a.txt\n",), ("/w/docs/a.txt",)], "p string").where(F.col("p").rlike(permissions.glob("docs/*.txt", "/w"))).count() == 1
