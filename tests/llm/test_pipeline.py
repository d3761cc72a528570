"""The pipeline against a brute-force version of its stages, on a small folder of tables."""

import collections
import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import packing, quality
from test_operators import _components, contaminated, reference_fingerprint


def folder(spark, path):
    rng = np.random.default_rng(3)
    words = [f"w{n}" for n in range(400)]
    texts = []
    for n in range(160):
        text = " ".join(rng.choice(words, 60))
        texts.append(text if n % 4 else " ".join(w.upper() + "!!" for w in text.split()))
    item = " ".join(f"bench{n}" for n in range(20))
    texts += [texts[1], texts[1] + "  ", texts[2].replace(" ", "\n"), "", None, texts[3] + " " + item, item + " " + texts[5] * 9, " ".join(texts[:40])]
    rows = [(n, t, "en", "s", len(t or ""), "x") for n, t in enumerate(texts)] + [(1, texts[1], "en", "s", 5, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `row` string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(n, int(n % 4 > 0), 0) for n in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, [(1, item), (2, None)]


def test_pipeline(spark, tmp_path):
    rows, items = folder(spark, tmp_path)
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    left = [(i, t) for i, t, *_ in rows if quality.score(t, model) >= quality.THRESHOLD]
    best = {}
    for i, t in left:
        key = re.sub(r"[\x20\x09-\x0D]+", "", t or "")
        best[key] = min(best.get(key, (1, 0, "")), (-len(t or ""), i, t))
    left = [(i, t) for _, i, t in best.values()]
    prints = {i: reference_fingerprint(t) for i, t in left}
    root, first = _components(list(prints.values())), {}
    for i in sorted(prints):
        first.setdefault(root[prints[i]], i)
    left = [(i, t) for i, t in left if i in first.values()]
    left = [d for d, (n, hit, _) in zip(left, contaminated([t for _, t in left], items)) if not (hit and 20 * hit >= n)]
    encode = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for i, t in left:
        ids = encode([t])[0] + np.array([packing.END], "<u4").tobytes()
        for s in range(0, len(ids), 4 * packing.LENGTH):
            want[i, s // 4, len(ids[s : s + 4 * packing.LENGTH]) // 4, zlib.crc32(ids[s : s + 4 * packing.LENGTH])] += 1
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in found) == want
    assert 50 < len(left) < len(rows) - 20


def test_stages_keep_the_columns(spark, tmp_path):
    folder(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for frame in (docs, docs.where("false"), docs.withColumn("extra", F.lit(1))):
            found = stage(spark, frame, str(tmp_path))
            assert found.columns == frame.columns and found.count() <= frame.count()
