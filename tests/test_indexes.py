"""Indexes (cells of vectors, spelling, trigrams) against brute force, with what they pass over; stores, mixes and remembered turns."""

import random

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.operators import cells, grouping, lexical, mixing, spelling, trigrams
from tessera.sources import snapshots


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8)) * 10
    rows = centres[np.arange(900) % 12] + rng.normal(size=(900, 8))
    rows[5] = rows[17]
    frame = spark.createDataFrame([(n, r.tolist()) for n, r in enumerate(rows)], "vec_id long, embedding array<float>")
    return frame, frame.where("vec_id % 50 = 0")


def key(rows):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in rows.collect())


def test_cells_give_the_exact_nearest_and_skip_most(clustered):
    rows, asked = clustered
    index = cells.append(cells.build(rows.where("vec_id < 600"), cells=24), rows.where("vec_id >= 600"))
    want = key(vectors.top_k(rows, asked, 7))
    assert key(cells.top_k(index, asked, 7)) == want
    held = [r for r in asked.collect()]
    least = {q: s for q, r, _, s in want if r == 7}
    goes = cells.visited(index, np.array([r.embedding for r in held], float), np.array([least[r.vec_id] for r in held]))
    assert goes.mean() < 0.35


def test_cells_of_few_rows_and_loose_vectors(spark, clustered):
    """More wanted than there are, vectors of any length, null rows, empty cells; the index is read back from its folder."""
    rng = np.random.default_rng(1)
    rows = [(n, (rng.normal(size=4) * rng.integers(1, 9)).tolist()) for n in range(30)] + [(30, None), (None, [1.0] * 4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = cells.load(spark, cells.build(frame, cells=9).folder)
    for k in (3, 100):
        assert key(cells.top_k(index, frame.where("vec_id < 5"), k)) == key(vectors.top_k(frame.where("vec_id IS NOT NULL"), frame.where("vec_id < 5"), k))


def test_spelling_within_one_edit(spark):
    """A letter lost, added or changed; the frequent word first; names, short words, marks alone and words two edits away stay."""
    known = spark.createDataFrame([("galaxy galaxy planet planet planets planets canción canción pingüe pingüe stars stars starts starts starts",)], "text string")
    found = spelling.vocabulary(known)
    assert {r.word: r.n for r in found.collect()}["starts"] == 3
    texts = [(1, "the galxy, planeet; gulaxy!"), (2, "Galxy galx cancion pingue"), (3, None), (4, "starrs planetx"), (5, ""), (1, "galaxy plamet"), (None, "galxy")]
    rows = spelling.corrected(spark.createDataFrame([(i, n, t) for n, (i, t) in enumerate(texts)], "id long, n long, text string"), spelling.index(found), ["id", "n"])
    got = {r.n: (r.text, r.changed) for r in rows.collect()}
    # starrs is one edit from stars and from starts, which is more frequent; planetx from planet and planets, equally frequent.
    assert got == {0: ("the galaxy, planet; galaxy!", 3), 1: ("Galxy galx cancion pingue", 0), 2: (None, 0), 3: ("starts planet", 2), 4: ("", 0), 5: ("galaxy planet", 1), 6: ("galaxy", 1)}


def test_spelling_index_equals_all_pairs(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(5, 9))) for _ in range(400)]
    known = spark.createDataFrame([(w, rng.randrange(1, 9)) for w in sorted(set(words[:250]))], "word string, n long")
    counts = {r.word: r.n for r in known.collect()}

    def one_edit(a, b):
        short, long = sorted((a, b), key=len)
        return sum(x != y for x, y in zip(a, b)) == 1 if len(a) == len(b) else len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    want = {}
    for w in set(words) - set(counts):
        if near := [v for v in counts if one_edit(w, v)]:
            want[w] = min(near, key=lambda v: (-counts[v], v))
    found = spelling.corrections(spark.createDataFrame([(w,) for w in words], "word string"), spelling.index(known))
    assert {r.word: r.best for r in found.collect()} == want and "CartesianProduct" not in found._jdf.queryExecution().toString()


def test_trigrams_find_every_text_and_read_few_folders(spark):
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(["Abcdef ghij", "xxabcdyy", "abc def", "", None, "zz top", "İstanbul zürich", "ab"])], "doc_id long, text string")
    index = trigrams.build(docs, 0)
    words = spark.createDataFrame([(w,) for w in ("abcd", "zürich", "ghij", "none", "def")], "word string")
    found = trigrams.containing(spark, index, words)
    assert {(r.doc_id, r.word) for r in found.collect()} == {(0, "abcd"), (1, "abcd"), (6, "zürich"), (0, "ghij"), (0, "def"), (2, "def")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan.replace("isnotnull(", "") or "folder#" in plan.split("PartitionFilters:")[1][:80]
    assert len({r.folder for r in trigrams.chosen(spark, index, words).select(trigrams.folder(F.col("gram")).alias("folder")).collect()}) <= 4 < trigrams.FOLDERS


def test_trigrams_keep_a_list_a_trigram_and_score_as_a_scan_does(spark):
    """One row for each trigram of a task's texts, however many texts have it; long texts of any letters; words looked for one by one or in one pass."""
    texts = [f"ähnlich wort{n % 7} {'wörter überall ' * (n % 5)}kopf{n}" for n in range(400)] + ["é€" * 150_000 + "zuletzt", "\U0001f600\U0001f601x zuletzt"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    index = trigrams.build(docs, 0)
    rows = spark.read.parquet(index.postings)
    assert rows.count() == rows.select("gram").distinct().count() == spark.read.parquet(index.frequencies).count()
    many = " ".join(f"kopf{n}" for n in range(400)) + " " + " ".join(t[:4] + str(n) for n, t in enumerate(["wort"] * 90))
    asked = spark.createDataFrame([(1, "ähnlich überall zuletzt"), (2, many), (3, "nirgends"), (4, None)], "item_id long, text string")
    key = lambda df: sorted(map(tuple, df.collect()))
    found = key(trigrams.top_k(spark, index, asked, 9))
    assert found == key(lexical.top_k(docs, asked, 9, 0)) and {r[0] for r in found} == {1, 2}


def test_store_versions_and_lost_writers(spark, tmp_path):
    """What is not committed is not read; the second of two writers of one version fails; compaction changes no row; a null deletes."""
    store = snapshots.Store(spark, f"file://{tmp_path}/s", "k")
    assert store.manifest() == []
    with pytest.raises(ValueError):
        store.read()
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "k long, v string")
    store.overwrite(rows((1, "a"), (2, "b"), (None, "n")))
    store.upsert(rows((2, "c"), (3, "d")))
    path = store.stage(rows((9, "lost")), "other")
    with pytest.raises(AnalysisException):
        store.commit(2, snapshots.CHANGES, path)
    store.upsert(rows((1, None), (3, "e")))
    seen = lambda v=None: sorted(((r.k, r.v) for r in store.read(v).collect()), key=str)
    assert seen(1) == [(1, "a"), (2, "b"), (None, "n")] and seen(2) == [(1, "a"), (2, "c"), (3, "d"), (None, "n")]
    assert seen() == [(2, "c"), (3, "e"), (None, "n")]
    assert store.compact() == 4 and seen(4) == seen(3) and [k for _, k, _ in store.manifest()].count(snapshots.SNAPSHOT) == 2
    assert store.commit(5, snapshots.CHANGES, path) == 5 and (9, "lost") in seen() and (9, "lost") not in seen(4)


def test_mix_caps_copies_and_skips(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 2 AS l").write.parquet(f"{tmp_path}/a")
    spark.range(5).selectExpr("id").write.parquet(f"{tmp_path}/b")
    sources = [mixing.Source("a", f"{tmp_path}/a", "id", "l", cap=30), mixing.Source("b", f"{tmp_path}/b", "id", "'x'", copies=3), mixing.Source("c", f"{tmp_path}/c", "id", "l")]
    found = mixing.mix(spark, sources, 1).collect()
    assert sorted(r.place for r in found) == list(range(1, 76)) and [sum(r.origin == o for r in found) for o in "abc"] == [60, 15, 0]
    assert {r.label for r in found if r.origin == "a"} == {"0", "1"} and [r.place for r in found if r.origin == "b"] != list(range(61, 76))
    assert found != mixing.mix(spark, sources, 2).collect() and mixing.mix(spark, sources[2:], 1).count() == 0


def test_remembered_turns(spark):
    """Rare words first, then likeness, then the last turn; nothing before what is remembered."""
    said = {0: "volcano lava", 1: "weather today", 2: "the lava there", 3: "nothing shared", 300: "volcano lava weather", 301: "other words"}
    words = spark.createDataFrame([("c", t, w) for t, x in said.items() for w in x.split()], "g string, t long, w string")
    got = {r.t: (r.antecedent, r.how) for r in grouping.remembered(words, "g", "t", "w", 0.4, sure=0.6).collect()}
    assert got[2] == (0, "meaning") and got[3] == (2, "last") and got[301] == (300, "last")
    assert got[300] == (0, "words")  # by words over any distance
    far = grouping.remembered(words.where("w <> 'weather'"), "g", "t", "w", 0.4, sure=9.0).collect()
    assert {r.t: r.how for r in far}[300] == "last"  # too far back to be remembered by meaning
