"""MinHash near-duplicates, the prefix trie and periodic runs against brute force, on tables with every awkward row."""

import collections
import hashlib
import itertools
import random
import time
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import decontaminate, exact_dedup, licenses, minhash, periodic, prefix_trie, quality, queries, sharding, simhash, warc
from tessera.llm.common import OWN, keyed

CLASH = ("_metadata", "row", "path", "value", "node", "key", "n", "label", "digest", "root", OWN + "x")


def clashing(frame):
    return frame.select("*", *(F.lit("clash").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)

    def near(words, changes):
        words = list(words)
        for _ in range(changes):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        return " ".join(words)

    base, short = [f"w{rng.randrange(5000)}" for _ in range(200)], [f"z{rng.randrange(5000)}" for _ in range(30)]
    made = [(n, near(base, rng.choice([0, 1, 2, 3, 4, 5, 6, 8]))) for n in range(120)]
    made += [(n, " ".join(f"v{rng.randrange(5000)}" for _ in range(60))) for n in range(120, 160)]
    made += [(n, near(short, rng.choice([0, 1, 1, 2]))) for n in range(160, 200)]
    made += [(200, None), (201, " \t"), (202, "a b"), (203, "A\u000bB"), (None, "a b"), (None, None), (3, made[3][1]), (3, made[3][1]), (204, "a b c d e"), (205, "É a b c d"), (206, "é a b c d")]
    return [*made, (207, "many words " * 60_000 + "end"), (208, "many words " * 60_001 + "end"), (209, " ".join(f"u{n}" for n in range(50_000)))]


def grams(text):
    words = (text or "").encode().lower().split()
    return frozenset([tuple(words)] if 0 < len(words) < 5 else zip(*(words[k:] for k in range(5)), strict=False))


def components_by_sets(rows):
    sets, parent = [grams(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        if a and b and min(len(a), len(b)) >= 0.85 * max(len(a), len(b)) and 100 * len(a & b) >= 85 * len(a | b):
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return collections.Counter((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_op11_query(spark, rows, tmp_path):
    clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op11_minhash"](spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == components_by_sets(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_minhash_of_crowded_groups(spark, rows):
    """With blocks of a few members and bytes, groups go through many blocks, and every link is still found."""
    found = minhash.deduplicate(spark.createDataFrame(rows[:-3], "doc_id long, text string"), members=16, set_bytes=40_000)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == components_by_sets(rows[:-3])


def test_minhash_of_an_empty_table(spark):
    assert minhash.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_estimate_similarity():
    """Corrected for chance, estimates are unbiased and as near as their margin says; bands of pairs at the threshold meet."""
    rng = np.random.default_rng(5)
    off = []
    for j in (0.0, 0.3, 0.6, 0.85, 0.95):
        for _ in range(60):
            both = rng.integers(0, 1 << 63, round(1000 * j), dtype=np.uint64)
            a, b = (np.concatenate([both, rng.integers(0, 1 << 63, (1000 - len(both)) // 2, dtype=np.uint64)]) for _ in range(2))
            x, y = (np.frombuffer(minhash.signature(np.unique(s)), np.uint8) for s in (a, b))
            same = int((x == y).sum())
            off.append(minhash.estimate(same) - j)
            if j >= 0.85:
                assert same >= minhash.agreeing() and any((x[k : k + 6] == y[k : k + 6]).all() for k in range(0, 240, 6))
    assert abs(np.mean(off)) < 0.005 and np.std(off) < 0.035


def test_a_group_of_copies_costs_one_comparison_a_member():
    asked = []

    def near(at, others):
        asked.append(len(others))
        return np.ones(len(others), bool)

    assert len(minhash._grown(np.arange(5000), near)) == 4999 and sum(asked) == 4999


# The trie.


def trie_by_hand(rows, rebuilt=True):
    """NODE rows, from all prefixes of all conversations."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (*t[:3], t[3]))] for c, ts in own.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuilt else 0
        made[c] = tuple(own.get(c - c % 100, [])[:h] + ts[h:])
    members = collections.defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(cs) - 1) * (len(p[-1][1]) if p else 0)
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if made[c] == p).encode()).hexdigest()
    return collections.Counter((cs[0], len(p), members[p[:-1]][0] if p else None, len(cs), children[p], leaves[p], saved[p], ends(p)) for p, cs in members.items())


def conversations():
    rng = random.Random(4)
    made = []
    for c in [*range(0, 60), 100, 105, *range(201, 230), 1000]:
        for turn in range(rng.choice([1, 1, 2, 3, 4, 7])):
            made.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["hi", "hello é", "", None, f"text {c}"])))
    made += [(100, None, "system", "first"), (100, 0, "user", "tie b"), (105, 1, None, None), (None, 0, "user", "lost"), (300, 5, "user", "x" * 200_000)]
    made += [(c, t, "user", f"same {t}") for c in (400, 401, 402) for t in range(40)]
    return made + [(500, t, "user", f"long {t % 7}") for t in range(150)] + [(501, t, "user", f"long {t % 7}") for t in range(150)]


def test_op12_query(spark, tmp_path):
    made = conversations()
    clashing(spark.createDataFrame(made, "conv_id long, turn long, role string, text string")).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.QUERIES["op12_prefix_trie"](spark, str(tmp_path)).collect()
    assert collections.Counter(map(tuple, found)) == trie_by_hand(made)


def test_trie_of_whole_conversations(spark):
    """As they stand; a shared prefix that is one conversation's whole; hot first turns; the ends of many conversations that are alike."""
    made = [(c, 0, "user", "hello") for c in range(700)] + [(c, 1, "assistant", f"reply {c % 3}") for c in range(0, 700, 2)] + [(2, 2, "user", "more")]
    turns = prefix_trie.ordered(spark.createDataFrame(made, "conv_id long, turn long, role string, text string"))
    found = prefix_trie.trie(*prefix_trie.sequences(turns)).select(*prefix_trie.NODE).collect()
    assert collections.Counter(map(tuple, found)) == trie_by_hand(made, rebuilt=False)


def test_trie_of_an_empty_table(spark):
    turns = prefix_trie.ordered(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert prefix_trie.trie(*prefix_trie.sequences(turns)).count() == 0


def test_turns_are_numbered_across_ranges(spark):
    made = [(7, t, "user", "x" * (t % 5)) for t in range(4000)] + [(c, t, "user", "y") for c in (1, 9) for t in range(10)]
    found = {(r.conv, r.pos): r for r in prefix_trie.ordered(spark.createDataFrame(made, "conv_id long, turn long, role string, text string").repartition(6)).collect()}
    assert len(found) == len(made) and all(found[7, t].chars == t % 5 and found[7, t].before == sum(k % 5 for k in range(t)) for t in range(0, 4000, 37))


# Periodic runs.


def runs_by_hand(words):
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length, own = i - start + q, words[start : i + q]
            if i > start and length >= max(6, 4 * q) and all(any(own[k] != own[k + p] for k in range(length - p)) for p in range(1, q)):
                found.add((start, length, q))
            i += i == start
    return sorted(found)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=24), st.integers(1, 7), st.integers(0, 3)), max_size=5))
def test_runs(parts):
    words = [w for unit, times, less in parts for w in (unit * times)[: max(1, len(unit) * times - less)]]
    found = periodic.runs(words)
    assert found == runs_by_hand(words)
    gone = {i for start, length, period in found for i in range(start + period, start + length)}
    assert periodic.collapsed(words, found) == b" ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_take_little_more_than_linear_time():
    rng, start = random.Random(2), time.monotonic()
    unit = [f"w{rng.randrange(10**6)}".encode() for _ in range(30_000)]
    assert periodic.runs(unit * 5 + unit[:7]) == [(0, 150_007, 30_000)]
    assert periodic.runs([b"a"] * 200_000) == [(0, 200_000, 1)]
    assert periodic.runs([b"x"] + [b"a", b"b"] * 50_000 + [b"c"]) == [(1, 100_000, 2)]
    assert periodic.runs([str(rng.randrange(300)).encode() for _ in range(100_000)]) == []
    assert time.monotonic() - start < 60


def test_op13_query(spark, tmp_path):
    rng = random.Random(6)
    texts = [None, "", " \n", "a", "a a a a a a", "b a  a\ta a a a c", "x y z " * 4, "É é " * 6, "word " * 50_000, "A a " * 9]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 90))) for _ in range(120)]
    made = [*enumerate(texts), (5, texts[5]), (5, texts[5]), (None, texts[6]), (None, None)]
    clashing(spark.createDataFrame(made, "doc_id long, text string")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = collections.Counter()
    for doc, text in made:
        words = (text or "").encode().split()
        n, h = len(words), None if doc is None else zlib.crc32(str(doc).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = runs_by_hand(words) if n < 1000 else [(0, n, 1)]
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        gone = {i for start, length, period in found for i in range(start + period, start + length)}
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in found)
        left = b" ".join(w for i, w in enumerate(words) if i not in gone)
        want[doc, len(found), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest()] += 1
    assert collections.Counter(map(tuple, queries.QUERIES["op13_periodic"](spark, str(tmp_path)).collect())) == want


def test_runs_of_an_empty_table(spark):
    assert periodic.with_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Every operator.


def test_a_column_named_metadata_and_the_sessions_settings(spark, tmp_path):
    """Row keys come from the files, not from a column of that name; no operator changes the session."""
    before = spark.conf.getAll
    docs = clashing(spark.createDataFrame([(1, "one two three"), (2, "one  two three"), (3, None)], "doc_id long, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    clashing(spark.createDataFrame([(1, "http://h/1", "<p>x</p>")], "page_id long, url string, html string")).write.parquet(f"{tmp_path}/pages.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert sharding.shard(docs, 4).count() == 3 and warc.round_trip(spark.read.parquet(f"{tmp_path}/pages.parquet")).count() == 1
    assert {r.doc_id for r in simhash.drop_near_duplicates(keyed(exact_dedup.drop_duplicates(keyed(docs)))).collect()} == {2, 3}
    for name in ("op2_sharding", "op3_secrets", "op4_packing", "op6_exact_dedup", "op7_simhash", "op9_licenses", "op11_minhash", "op13_periodic"):
        if name != "op3_secrets":
            assert queries.QUERIES[name](spark, str(tmp_path)).where("doc_id = 3").count() == 1, name
    assert queries.QUERIES["op10_html"](spark, str(tmp_path)).first().text == "x"
    assert spark.conf.getAll == before


def test_one_index_serves_all_blocks(spark):
    """The suffixes of a shard are sorted once: six blocks take little more time than two, and find the same."""
    rng = np.random.default_rng(7)
    vocabulary = [f"w{n}" for n in range(20_000)]
    docs = [" ".join(rng.choice(vocabulary, 400)) for _ in range(1000)]
    items = [(n, docs[n][:2000]) for n in range(0, 1000, 2)]
    frame = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    found, took, built = [], [], []
    inner = decontaminate.FMIndex
    for most in (60_000, 20_000):
        paths = tuple(decontaminate.blocks(frame, most=most))
        known = decontaminate.numbering()
        own = [np.append(decontaminate.numbers(t, known.__getitem__), 0) for t in docs]
        calls = []
        decontaminate.FMIndex = lambda *a: calls.append(1) or inner(*a)  # noqa: B023
        try:
            start = time.monotonic()
            found.append(decontaminate._marked(np.concatenate(own), np.cumsum([len(x) for x in own]), known, paths))
            took.append(time.monotonic() - start)
        finally:
            decontaminate.FMIndex = inner
        built.append((len(calls), len(paths)))
    assert [b[0] for b in built] == [1, 1] and built[0][1] < built[1][1] >= 6
    assert (found[0][0] == found[1][0]).all() and found[0][1:] == found[1][1:] and found[0][0].sum() > 100_000
    assert took[1] < 1.5 * took[0] + 1


def test_quality_sample_spreads_over_long_texts(spark):
    """What of a long text is in the sample comes from all of it, its last words too; other texts are whole."""
    docs = spark.createDataFrame([(n, f"text {n} " * 20 if n != 7 else " ".join(f"word{k:05d}" for k in range(20_000))) for n in range(60)], "doc_id long, text string")
    taken = quality.sample(docs, docs.selectExpr("doc_id", "doc_id % 2 AS quality"), "doc_id", "text", "quality", most=40_000)
    assert sum(len(t) for t, _ in taken) <= 40_000 and len([t for t, _ in taken if t.startswith("text")]) == len(taken) - 1
    (long,) = (t for t, _ in taken if t.startswith("word"))
    seen = sorted(int(w[4:]) for w in long.split() if len(w) == 9 and w.startswith("word") and w[4:].isdigit())
    assert seen[0] == 0 and seen[-1] == 19_999 and max(b - a for a, b in zip(seen, seen[1:], strict=False)) < 1500


def test_licenses_by_sql_where_notices_wrap(spark, tmp_path):
    """The SQL states lines and windows: notices that wrap anywhere, with marks, words lost, twice over, beside whole lines."""
    rng = random.Random(9)
    texts = [None, "", "cc by\nAll rights\nreserved"]
    for label, template in licenses.TEMPLATES:
        words = template.split()
        for _ in range(12):
            own = [w for w in words if rng.random() > rng.choice([0, 0, 0.1, 0.25])]
            parts = "".join(w + rng.choice([" ", " ", "\n", " \n * ", "\r\n", "  "]) for w in own)
            texts.append(rng.choice(["", "before ", template + "\n"]) + parts + rng.choice(["", parts, " filler x y z\n" + parts, "\n" + " ".join(rng.sample(words, len(words)))]))
    rows = [*enumerate(texts), (None, texts[9]), (3, texts[3])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op9_licenses"](spark, str(tmp_path)).collect()
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "n_links")
    want = duck.sql(f"SELECT {', '.join(columns)}, round(score, 9) FROM ({queries.SQL['op9_licenses']})").fetchall()
    assert collections.Counter(tuple(r[c] for c in columns) + (round(r.score, 9),) for r in found) == collections.Counter(want)
    by_lines = sum(len(r.linked) for r in licenses.scan(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect())
    assert sum(r.n_links for r in found) > by_lines + 50
