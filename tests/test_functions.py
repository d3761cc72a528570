"""Text, quantity and source functions on the cases that define them."""

import json

from pyspark.sql import functions as F

from tessera.functions import quantities, substrings, text
from tessera.functions.arithmetic import value
from tessera.sources import knowledge_store
from tessera.streaming import events


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def test_facts(spark):
    assert one(spark, text.facts(F.col("t")), t="El agua hierve a 100 grados al nivel del mar. El sol es una estrella.") == ["El agua hierve a 100 grados al nivel del mar", "El sol es una estrella"]
    assert one(spark, text.facts(F.col("t")), t="¿Es verdad esto? El sol es una estrella.") == ["El sol es una estrella"]
    assert one(spark, text.facts(F.col("t")), t="Creo que es bonito. El sol es una estrella.") == ["El sol es una estrella"]
    assert one(spark, text.facts(F.col("t")), t="¿Es verdad esto?") == ["¿Es verdad esto?"]


def test_pack(spark):
    found = one(spark, text.pack(F.col("t"), 100), t="Primera frase. " * 30)
    assert all(len(p) <= 115 and p.endswith(".") for p in found) and sum(p.count("Primera") for p in found) == 30
    assert one(spark, text.pack(F.col("t"), 100), t="") == []


def test_domain_and_markup(spark):
    assert one(spark, text.domain(F.col("u")), u="https://www.politifact.com/x") == "politifact.com"
    assert one(spark, text.domain(F.col("u"), "knowledge-store"), u="") == "knowledge-store"
    assert one(spark, text.strip_markup(F.col("h")), h="<p>a <b>b</b></p><script>x()</script>") == "a b"


def test_substring_relevance_is_not_token_relevance(spark):
    assert one(spark, text.relevance(text.content_words(F.col("f")), F.col("p")), f="arte", p="una parte") == 1


def test_quantities_and_periods(spark):
    assert one(spark, quantities.quantities(F.col("t")), t="45 million") == [45e6]
    assert one(spark, quantities.quantities(F.col("t")), t="2.5 billion") == [2.5e9]
    assert one(spark, quantities.quantities(F.col("t")), t="4 senators") == []
    for said, expected in (("In 1960 it", "1960"), ("At independence", "past"), ("It is now", "present"), ("nothing", None)):
        assert one(spark, quantities.period(F.col("t")), t=said) == expected


def test_arithmetic():
    assert value("2 + 3 * 4") == 14 and value("2 ** 3 ** 2") == 512
    assert all(value(x) is None for x in ("__import__('os')", "1/0", "a + 1", "9 ** 9999", "", None))


def test_substrings_without_and_with_automaton(spark, monkeypatch):
    words = ("a", "bc", "abc", "zz")
    assert substrings.finder(words)("xabcx") == ["a", "abc", "bc"]
    monkeypatch.setattr(substrings, "ahocorasick", None)
    substrings.finder.cache_clear()
    assert sorted(substrings.finder(words)("xabcx")) == ["a", "abc", "bc"]
    substrings.finder.cache_clear()


def test_dialogue_acts(spark):
    for said, act in (("hola", "social"), ("no, no es esa", "rejection"), ("¿y eso?", "follow_up"), ("what is water made of, in plain words and with a source to read more about the matter?", "question"), ("WHO approved the vaccine.", "claim")):
        assert one(spark, text.dialogue_act(F.col("t")), t=said) == act, said


def test_knowledge_store(spark, tmp_path):
    (tmp_path / "0.json").write_text(json.dumps({"url": "https://www.a.org/x", "url2text": ["one", " ", "two"]}) + '{"url": "", "url2text": ["raw\nbreak"]}\n{"url": "cut", "url2')
    rows = knowledge_store.passages(spark, str(tmp_path)).orderBy("n").collect()
    assert [(r.passage, r.domain) for r in rows] == [("one", "a.org"), ("two", "a.org"), ("raw\nbreak", "knowledge-store")]


def test_stream_matches_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i // 6:02d}:{i % 6}0:00", "a" if i % 2 else "b", float(i)) for i in range(60)] + [(99, "2024-01-03 00:00:00", "a", 1.0)]
    spark.createDataFrame(rows, "event_id int, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.hourly(events.read(spark, str(tmp_path / "in"), "event_id int, ts timestamp_ntz, event_type string, value double"))
    running = stream.writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    running.awaitTermination(60)
    assert spark.table("hours").where("hour < '2024-01-02'").agg(F.sum("n")).first()[0] == 60


DOWNGRADES = [
    (1, "refuta", "At independence, Nigeria had a population of 45 million.", "Nigeria currently has a population of 200 million people."),
    (2, "refuta", "In 2020 it had 45 million people.", "In 2020 it had 200 million people."),
    (3, "refuta", "It had 45 million people.", "It has 200 million people."),
    (4, "refuta", "At independence it had 45 million.", "In 1960 it had 200 million."),
    (5, "refuta", "In 1990 it had 100 thousand.", "It currently has 110 thousand."),
    (6, "sustenta", "At independence it had 45 million.", "It currently has 200 million."),
    (7, "refuta", "In 1990, 45 million", "In 1960, 200 million"),
]


def test_downgrades(spark):
    """Written cases against the SQL of the rule."""
    import duckdb

    from tessera.functions import quantities
    from tessera.plans.verdicts import downgrade_sql, q

    values = ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in c) + ")" for c in DOWNGRADES)
    want = duckdb.sql(f"WITH cases AS (SELECT * FROM (VALUES {values}) t(case_id, label, claim, evidence)), {downgrade_sql('cases', 'case_id')}").fetchall()
    c = F.col
    cases = spark.createDataFrame(DOWNGRADES, "case_id int, label string, claim string, evidence string")
    found = cases.select("case_id", quantities.downgraded(c("label"), c("claim"), c("evidence")), quantities.period(c("claim")), quantities.period(c("evidence"))).collect()
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str) and len(want) == len(DOWNGRADES)


def test_main_words(spark):
    """The article between menus; nulls, pages without tags or words; scripts and comments are no text."""
    from tessera.functions import pages

    menu = "<ul>" + "<li><a>one</a></li>" * 9 + "</ul>"
    html = f"<html><head><title>no</title></head><body>{menu}<p>the long text of the page that people came for</p><p>goes on here with very many more words <b>and</b> there again at the very end of it all</p>{menu}<script>var a = 'many words of code here and more of it';</script></body>"
    rows = [(0, html), (1, None), (2, ""), (3, "<p></p>"), (4, "only words here"), (5, "<!-- a b c d e --><i>x</i>"), (6, "a " * 100_000)]
    found = {r.n: r.w for r in spark.createDataFrame(rows, "n int, html string").select("n", pages.main_words(F.col("html")).alias("w")).collect()}
    assert " ".join(found[0]) == "the long text of the page that people came for goes on here with very many more words and there again at the very end of it all"
    assert [found[n] for n in (1, 2, 3)] == [[], [], []] and found[4] == ["only", "words", "here"] and found[5] == ["x"] and len(found[6]) == 100_000
