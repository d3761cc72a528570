"""Row numbers over many ranges, however the engine cuts and coalesces them."""

from pyspark.sql import functions as F

from tessera.operators import sampling


def test_numbers_are_gapless_over_many_ranges(spark):
    total = 1_200_000
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k", "spark.sql.shuffle.partitions": "61"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, total, 1, 23).select(((F.col("id") * 7919) % 1_299_709).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
        found = sampling.numbered(rows, "id")
        for _ in range(2):  # each action gives the same
            told = found.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("n").alias("d"), F.min("n").alias("low"), F.max("n").alias("high")).first()
            assert tuple(told) == (total, total, 1, total)
        wrong = found.join(found.select((F.col("n") - 1).alias("n"), F.col("id").alias("next")), "n").where("next <= id")
        assert wrong.count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_balanced_keeps_the_least_class_whole(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("kind"))
    found = {r.kind: r["count"] for r in sampling.balanced(rows, "kind", "id", 3).groupBy("kind").count().collect()}
    assert found == {"a": 100, "b": 100} and sampling.balanced(rows.where("false"), "kind", "id", 3).count() == 0
