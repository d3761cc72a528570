"""Evaluation: confusion, precision and recall, balanced accuracy, calibration, threshold tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """part / whole, and 0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def confusion(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    return rows.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(rows: DataFrame, classes: list[str]) -> DataFrame:
    """Precision, recall and F1 of each declared class, also of one that no row has."""
    n = F.col("n")
    per = confusion(rows).select("*", F.explode(F.lit(classes)).alias("class"))
    own = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    sums = per.groupBy("class").agg(own((F.col("gold") == F.col("class")) & (F.col("pred") == F.col("class"))).alias("tp"), own(F.col("pred") == F.col("class")).alias("said"), own(F.col("gold") == F.col("class")).alias("are"))
    precision, recall = share(F.col("tp"), F.col("said")), share(F.col("tp"), F.col("are"))
    return sums.select("class", precision.alias("precision"), recall.alias("recall"), share(2 * precision * recall, precision + recall).alias("f1"))


def balanced_accuracy(positive: Column, said: Column) -> Column:
    """The mean of both classes' recalls; a class without rows counts as 0."""
    rate = lambda own, right: F.coalesce(F.avg(F.when(own, right.cast("double"))), F.lit(0.0))
    return (rate(positive, said) + rate(~positive, ~said)) / 2


def calibration_error(rows: DataFrame, conf: str = "conf", right: str = "right", bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins (i/bins, (i+1)/bins]."""
    # The product is rounded, so that a confidence on an edge falls into the lower bin.
    bucket = F.ceil(F.round(F.col(conf) * bins, 9))
    per = rows.where(F.col(conf) > 0).groupBy(bucket.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(right).cast("double")).alias("acc"), F.avg(conf).alias("mean"))
    return per.agg(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("mean"))).alias("gap"), F.sum("n").alias("n")).select((F.col("gap") / F.col("n")).alias("ece"), "n")


def temperature(rows: DataFrame, logit: str, truth: str, grid: list[float]) -> DataFrame:
    """temperature with the least mean log loss of the scaled logits, its nll, and before: that of temperature 1."""
    sign = F.when(F.col(truth), -F.col(logit)).otherwise(F.col(logit))
    losses = rows.agg(*(F.avg(F.ln(1 + F.exp(sign / t))).alias(f"l{n}") for n, t in enumerate([1.0, *grid])))
    tried = F.array(*(F.struct(F.round(f"l{n}", 9).alias("nll"), F.lit(t).alias("t")) for n, t in enumerate(grid, 1)))
    return losses.select(F.array_min(tried).alias("best"), F.col("l0").alias("before")).select(F.col("best.t").alias("temperature"), "best.nll", "before")


def joined_checked(dump: DataFrame, data: DataFrame, key: str, label: str) -> DataFrame:
    """key and label of both sides' rows; the job fails where their labels differ."""
    met = dump.join(data.withColumnRenamed(label, "_label"), key)
    same = F.when(F.col(label).eqNullSafe(F.col("_label")), F.col(label)).otherwise(F.raise_error(F.concat(F.lit(f"{label} differs at "), F.col(key).cast("string"))))
    return met.select(key, same.alias(label))


def ranked(rows: DataFrame, key: str, classes: list[str]) -> DataFrame:
    """key, accuracy, macro_f1 and rank (by both, then key) of rows (key, gold, pred): all keys in one pass of counts."""
    of = lambda c, column: F.count_if(F.col(column) == c)
    hits = [F.count_if((F.col("gold") == c) & (F.col("pred") == c)).alias(f"_tp{n}") for n, c in enumerate(classes)]
    both = [(of(c, "gold") + of(c, "pred")).alias(f"_all{n}") for n, c in enumerate(classes)]
    counted = rows.groupBy(key).agg(F.avg((F.col("gold") == F.col("pred")).cast("int")).alias("_acc"), *hits, *both)
    f1 = sum((F.when(F.col(f"_all{n}") > 0, 2 * F.col(f"_tp{n}") / F.col(f"_all{n}")).otherwise(0.0) for n in range(len(classes))), F.lit(0.0)) / len(classes)
    told = counted.select(key, F.round("_acc", 9).alias("accuracy"), F.round(f1, 9).alias("macro_f1"))
    return told.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("accuracy"), F.desc("macro_f1"), key)))  # one row a setting


def judges(rows: DataFrame, judge: str, gold: str, said: str) -> DataFrame:
    """judge, n, tpr, tnr and bacc of rows whose gold and said are 0 or 1."""
    rate = lambda value, right: F.coalesce(F.avg(F.when(F.col(gold) == value, right)), F.lit(0.0))
    tpr, tnr = rate(1, F.col(said)), rate(0, 1 - F.col(said))
    return rows.groupBy(judge).agg(F.count(F.lit(1)).alias("n"), F.round(tpr, 6).alias("tpr"), F.round(tnr, 6).alias("tnr"), F.round((tpr + tnr) / 2, 6).alias("bacc"))


def speed(rows: DataFrame, model: str, hit: str, seconds: str) -> DataFrame:
    """model, accuracy, ms_per_pair and n."""
    return rows.groupBy(model).agg(F.round(F.avg(F.col(hit).cast("int")), 6).alias("accuracy"), F.round(F.sum(seconds) / F.count(F.lit(1)) * 1000, 6).alias("ms_per_pair"), F.count(F.lit(1)).alias("n"))
