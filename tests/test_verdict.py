"""The decision table, case by case: label, probability, domain -> verdict and confidence."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import verdict

S, R, N = verdict.SUPPORTS, verdict.REFUTES, verdict.NEUTRAL
NINE = "alpha bravo charlie delta echoes foxtrot golfing hotels indian"
CASES = {
    "no evidence": ([], verdict.INSUFFICIENT, 0.0),
    "only neutral": ([(N, 0.9, f"d{i}.org") for i in range(4)], verdict.INSUFFICIENT, 0.0),
    "unanimous": ([(S, 0.9, f"d{i}.org") for i in range(3)], verdict.SUPPORTED, 1.0),
    "weak signal": ([(S, 0.55, "d1.org")], verdict.INSUFFICIENT, 0.0),
    "dominance": ([(R, 0.95, "d1.org"), (R, 0.90, "d2.org"), (S, 0.65, "d3.org")], verdict.REFUTED, 0.74),
    "real conflict": ([(S, 0.85, "es.wikipedia.org"), (R, 0.80, "politifact.com"), (S, 0.9, "viral1.com"), (S, 0.9, "viral2.com")], verdict.CONFLICTING, 1.0),
    "web noise": ([(S, p, f"viral{i}.com") for i, p in enumerate((0.97, 0.96, 0.95, 0.95, 0.94))] + [(R, 0.95, "politifact.com")], verdict.REFUTED, 0.614),
    "weak tie": ([(S, 0.85, "d1.org"), (S, 0.7, "d3.org"), (R, 0.80, "d2.org")], verdict.SUPPORTED, 0.66),
    "copies": ([(S, 0.9, "copiaspam.com")] * 100 + [(R, 0.9, "fuente1.org"), (R, 0.9, "fuente2.org")], verdict.REFUTED, 0.667),
    "one voice": ([(S, 0.78, "chequeado.com"), (R, 0.95, "chequeado.com")], verdict.REFUTED, 0.333),
    "equal sides": ([(S, 0.8, "a.org"), (R, 0.8, "b.org")], verdict.REFUTED, 0.333),
    "encyclopedia": ([(S, 0.9, "es.wikipedia.org"), (S, 0.9, "detallada.org"), (R, 0.7, "confuso.com")], verdict.SUPPORTED, 0.818),
}


def decided(spark, cases):
    rows = [(n, k, label, float(prob), domain, "web", text, fact) for n, (pairs, fact) in enumerate(cases) for k, (label, prob, domain, text) in enumerate(pairs)]
    pairs = spark.createDataFrame(rows, "fact_id int, pos int, label string, prob double, domain string, source string, ev_text string, fact_text string")
    facts = spark.createDataFrame([(n,) for n in range(len(cases))], "fact_id int")
    return {r.fact_id: r for r in verdict.decide(facts, verdict.voices(verdict.weighted(pairs))).collect()}


def test_decision_table(spark):
    found = decided(spark, [([(*p, "plain") for p in pairs], "A short fact") for pairs, _, _ in CASES.values()])
    for n, (name, (_, expected, confidence)) in enumerate(CASES.items()):
        assert found[n].verdict == expected, name
        assert found[n].confidence == pytest.approx(confidence, abs=6e-4), name


def test_echo_and_debunk_discounts(spark):
    cases = [
        ([(S, 0.95, "viral.com", NINE), (R, 0.75, "museo.org", "plain")], NINE),
        ([(S, 0.95, "tutorial.org", "python lists mutable")], "Python lists mutable"),
        ([(S, 0.95, "x.com", "purportedly misleading"), (R, 0.8, "otra.org", "plain")], "A short fact"),
    ]
    found = decided(spark, cases)
    assert (found[0].verdict, round(found[0].confidence, 3)) == (verdict.REFUTED, 0.483)
    assert (found[1].verdict, round(found[1].confidence, 3)) == (verdict.SUPPORTED, 0.333)
    assert (found[2].verdict, round(found[2].confidence, 3)) == (verdict.REFUTED, 0.514)


def test_roll_up(spark):
    rows = [(1, verdict.SUPPORTED, 0.8), (1, verdict.REFUTED, 0.7), (2, verdict.SUPPORTED, 0.8), (2, verdict.INSUFFICIENT, 0.0), (3, verdict.SUPPORTED, 0.9), (3, verdict.SUPPORTED, 0.6)]
    found = {r.claim_id: (r.verdict, r.confidence) for r in verdict.roll_up(spark.createDataFrame(rows, "claim_id int, verdict string, confidence double")).collect()}
    assert found == {1: (verdict.REFUTED, 0.7), 2: (verdict.INSUFFICIENT, 0.0), 3: (verdict.SUPPORTED, 0.6)}


def test_priors(spark):
    rows = [("politifact.com", "web", 8.0), ("x.org", "docs-oficiales", 8.0), ("es.wikipedia.org", "web", 2.5), ("wikidata.org", "web", 2.5), ("x.org", "tribunales", 2.0), ("x.org", "academica", 2.5), ("a.gov", "web", 2.0), ("a.gov.uk", "web", 2.0), ("x.org", "wikinews", 1.5), ("x.org", "web", 1.0)]
    found = spark.createDataFrame(rows, "domain string, source string, w double").select("w", verdict.prior(F.col("domain"), F.col("source")).alias("p"))
    assert all(r.w == r.p for r in found.collect())
