"""Claims to verdicts end to end, the cascade, judges, and stores."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import judges, replies
from tessera.operators import answers, scores, verdict
from tessera.sources import payloads, sinks
from tessera.verify import disagreement, from_store, investigate, verify

STORE = [
    ("El agua hierve a cien grados", "El agua hierve a cien grados al nivel del mar.", "a.org"),
    ("El agua hierve a cien grados", "Con presión normal el agua hierve a cien grados.", "b.org"),
    ("El agua hierve a cien grados", "Con presión normal el agua hierve a cien grados.", "b.org"),
    ("El agua hierve a cien grados", "Nada que ver con ello.", "c.org"),
    ("El sol es una estrella fría", "El sol, una estrella: inconcluso si es fría.", "d.org"),
    ("El sol no es una estrella fría", "La estrella llamada sol está fría.", "e.org"),
]


def setup(spark):
    store = spark.createDataFrame([(q, k, t, d, "web") for k, (q, t, d) in enumerate(STORE)], "query string, pos int, text string, domain string, source string")
    claims = spark.createDataFrame([(1, "El agua hierve a cien grados. El sol es una estrella fría."), (2, "Nadie sabe de esto")], "claim_id long, text string")
    return claims, lambda asked: asked.join(store, "query").drop("query")


def test_verify(spark):
    claims, retrieve = setup(spark)
    report = verify(claims, retrieve)
    facts = {(r.claim_id, r.n): (r.verdict, r.confidence, r.voices) for r in report.fact_verdicts.collect()}
    assert facts[1, 0] == (verdict.SUPPORTED, 0.667, 2) and facts[1, 1][0] == facts[2, 0][0] == verdict.INSUFFICIENT
    assert {r.claim_id: r.verdict for r in report.claim_verdicts.collect()} == {1: verdict.INSUFFICIENT, 2: verdict.INSUFFICIENT}


def test_investigate_judges_the_negation_of_weak_facts(spark):
    claims, retrieve = setup(spark)
    report = investigate(claims, retrieve)
    facts = {(r.claim_id, r.n): r for r in report.fact_verdicts.collect()}
    # The judge refutes the negation, which speaks for the fact; the supported fact was not looked at again.
    assert facts[1, 1].verdict == verdict.SUPPORTED and facts[1, 0].voices == 2 and report.level == 1
    assert [(r.claim_id, r.n, r.disagreement) for r in disagreement(report).collect()] == [(1, 1, 0.0)]
    assert verify(claims, retrieve).pairs.count() == 3


def test_store_of_each_claim(spark):
    claims, _ = setup(spark)
    rows = [(1, k, t, d) for k, (_, t, d) in enumerate(STORE)] + [(1, 90, "corto agua hierve", "x.org"), (3, 0, STORE[0][1], "other.org"), (1, 91, None, "y.org")]
    passages = spark.createDataFrame(rows, "claim_id long, pos int, text string, domain string")
    asked = spark.createDataFrame([(1, 0, 0, "El agua hierve a cien grados")], "claim_id long, n int, angle int, query string")
    found = from_store(passages, most=3)(asked).orderBy("pos").collect()
    assert [(r.pos, r.domain, r.source) for r in found] == [(0, "a.org", "knowledge-store"), (1, "b.org", "knowledge-store"), (3, "c.org", "knowledge-store")]
    report = verify(claims, from_store(passages), gate=False)
    assert {(r.claim_id, r.n): r.verdict for r in report.fact_verdicts.collect()}[1, 0] == verdict.SUPPORTED


def test_verify_without_claims_or_evidence(spark):
    claims, retrieve = setup(spark)
    none = verify(claims.limit(0), retrieve)
    assert none.claim_verdicts.count() == 0
    assert verify(claims, lambda asked: retrieve(asked).where("false")).claim_verdicts.where(F.col("verdict") == verdict.INSUFFICIENT).count() == 2


def test_model_judge(spark):
    def load():
        return lambda premises, hypotheses: np.array([[float(len(p)), 0.0, float(len(h))] for p, h in zip(premises, hypotheses)])

    rows = spark.createDataFrame([(k, "x" * (k % 3), "xx") for k in range(20)], "id int, premise string, hypothesis string").coalesce(1)
    found = judges.model(load, temperature=2.0)(rows).orderBy("id").collect()
    assert [r.label for r in found[:3]] == [verdict.REFUTES, verdict.REFUTES, verdict.SUPPORTS] and len(found) == 20
    assert abs(found[0].prob - np.exp(1) / (np.exp(1) + 2)) < 1e-9


def test_stores(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "m"), ("b", 1, "m"), ("a", 2, "m")], "key string, at int, model string")
    path = str(tmp_path / "store")
    sinks.append_absent(rows.where("at = 1"), path, ["key"], ["model"])
    sinks.append_absent(rows, path, ["key"], ["model"])
    assert spark.read.parquet(path).count() == 2
    sinks.append(rows, str(tmp_path / "log"))
    assert {(r.key, r.at) for r in sinks.latest(spark, str(tmp_path / "log"), ["key"], ["at"]).collect()} == {("a", 2), ("b", 1)}
    sinks.append_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    assert sinks.reports(rows.limit(1), "key").first().report == '{"key":"a","at":1,"model":"m"}'


def test_payloads_that_lack_parts_give_nothing(spark):
    rows = [(name, k, "", None, p) for name, record in payloads.RECORDS.items() for k, p in enumerate(["<entry></entry>"] if record.xml else ["{}", "not json", None])]
    assert payloads.render(spark.createDataFrame(rows, "source string, n int, query string, lang string, payload string")).count() == 0


def test_fold_keeps_the_last_turns():
    turns = [("user", f"{k} " * 200) for k in range(8)]
    assert answers.fold(turns, 10**6) == turns
    for budget in (3000, 2000, 500):
        left = answers.fold(turns, budget)
        assert left[-4:] == turns[-4:] and (len(left) == 4 or sum(len(answers.rendered(*t)) for t in left) <= budget)


def test_actions_and_null_replies(spark):
    rows = spark.createDataFrame([(None,), ("",)], "t string")
    t = F.col("t")
    for r in rows.select(replies.verdict(t).alias("v"), replies.questions(t, 3).alias("q"), replies.code_run(t).alias("c"), replies.actions(t).alias("a"), replies.accents(t).alias("s")).collect():
        assert r.v is None and not r.q and r.c is None and r.a.tool is None and not r.s


def test_checked_join_fails_on_another_label(spark):
    import pytest

    a, b = (spark.createDataFrame([(1, x)], "k int, label int") for x in (0, 1))
    with pytest.raises(Exception, match="label differs at 1"):
        scores.joined_checked(a, b, "k", "label").collect()
