"""Steps that must not grow faster than their input: what a plan computes, how often, and how much of it at once."""

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import models, text
from tessera.operators import sampling
from tessera.plans import audits, flows, retrieval
from tessera.sources import registry


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def texts(spark, folder, rows, schema, name):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return f"{folder}"


def test_inverted_indexes_are_made_text_by_text(spark, tmp_path):
    folder = texts(spark, tmp_path, [(1, " b a\nb  c "), (2, " \n"), (3, None), (4, "a")], "doc_id long, text string", "documents")
    found = retrieval.openalex_rebuild(spark, folder)
    plan = optimized(found)
    assert "Aggregate" not in plan and "Generate" not in plan
    sha = lambda t: spark.range(1).select(F.sha2(F.lit(t), 256)).first()[0]
    assert {tuple(r) for r in found.collect()} == {(1, sha("b a b c")), (4, sha("a"))}
    index = registry.inverted_index(F.split("t", " "))
    assert [r[0] for r in spark.createDataFrame([("x y x",), (None,)], "t string").select(index).collect()] == [{"x": [0, 2], "y": [1]}, None]


def test_turns_of_many_files_come_in_two_batches(spark, tmp_path, monkeypatch):
    rows = [(c, t, f"{c}:{t}") for c in range(12) for t in range(25)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(9).write.parquet(f"{tmp_path}/conversations.parquet")
    seen = []
    run = flows.run_stream
    monkeypatch.setattr(flows, "run_stream", lambda *args: seen.append(run(*args)) or seen[-1])
    found = flows.rolling_turns(spark, str(tmp_path)).collect()
    assert [(r.turns, r.first_turn, r.last_turn) for r in found] == [(20, 5, 24)] * 12
    assert sorted(r.batch for r in seen[0].select("batch").distinct().collect()) == [0, 1]


def test_few_texts_of_a_batch_are_objects_at_a_time(monkeypatch):
    given = [None if n % 7 == 0 else f" Straße  É{n}\n" for n in range(1000)]
    sizes = []
    plain = text.plain
    monkeypatch.setattr(text, "plain", lambda x: sizes.append(len(x)) or plain(x))
    (found,) = text.plain_key.func(iter([pa.array(given, pa.string())]))
    assert found.to_pylist() == [None if n % 7 == 0 else f"strasse e{n}" for n in range(1000)]
    assert max(sizes) <= text.ROWS
    assert [len(x) for x in text.plain_key.func(iter([pa.array([], pa.string())]))] == [0]


def test_topics_are_looked_for_once(spark):
    rows = spark.createDataFrame([("a bug in it", "ciencia", 0.9), ("nothing", "ciencia", 0.9), ("nothing", "weather", 0.9), ("nothing", "ciencia", 0.4), (None, "ciencia", 0.9)], "t string, label string, score double")
    found = rows.select(models.refined_topic(F.col("t"), F.col("label"), F.col("score")).alias("topic"))
    assert [r.topic for r in found.collect()] == ["programacion", "ciencia", "general", "general", "ciencia"]
    assert optimized(found).count("kubectl") == 1


def test_key_terms_cut_a_text_into_words_once(spark):
    rows = spark.createDataFrame([("Para Motor motor der Diésel, MOTOR Turbina turbina eje Carga",), ("de",), (None,)], "t string")
    found = rows.select(text.key_terms(F.col("t"), 3).alias("k"))
    assert [r.k for r in found.collect()] == [["Motor", "Diésel", "Turbina"], [], None]
    assert optimized(found).count("regexp_extract_all") == 1


def test_edited_claims_are_made_once(spark, tmp_path, monkeypatch):
    texts(spark, tmp_path, [(n, f" Claim number {n} stands here. More of it! ") for n in range(12)], "doc_id long, text string", "documents")
    texts(spark, tmp_path, [(n, 1) for n in range(12)], "doc_id long, quality int", "labels")
    plans = []
    numbered = sampling.numbered
    monkeypatch.setattr(sampling, "numbered", lambda rows, key: plans.append(optimized(rows)) or numbered(rows, key))
    found = audits.synthetic_edits(spark, str(tmp_path))
    assert sorted(r.doc_id for r in found.collect()) == [0, 1, 2, 6, 7, 8]
    assert plans[0].count("split(") == 1
