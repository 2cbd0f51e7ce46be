"""Evaluation measures as grouped and windowed aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _by_score(df: DataFrame, keys: list[str], truth: str, score: str, weight: str | None) -> DataFrame:
    w = F.lit(1.0) if weight is None else F.col(weight)
    return df.groupBy(*keys, score).agg(F.sum(w * F.col(truth)).alias("p"), F.sum(w * (1 - F.col(truth))).alias("n"))


def ranking_metrics(df: DataFrame, keys: list[str], truth: str, score: str, weight: str | None = None) -> DataFrame:
    """(keys, n, prevalence, auroc, average_precision, ap_lift); tied scores count half, as one threshold.

    Scores are first aggregated, so only distinct scores are ranked.
    """
    by = _by_score(df, keys, truth, score, weight)
    run = W.partitionBy(*keys).orderBy(F.col(score).desc())
    c = by.withColumns({"tp": F.sum("p").over(run), "fp": F.sum("n").over(run)})
    agg = c.groupBy(*keys).agg(
        F.sum(c["p"] + c["n"]).alias("size"), F.sum("p").alias("_P"), F.sum("n").alias("_N"),
        F.sum(c["n"] * (c["tp"] - c["p"] / 2)).alias("_auc"), F.sum(c["p"] * F.try_divide(c["tp"], c["tp"] + c["fp"])).alias("_ap"),
    )
    prev = F.try_divide("_P", F.col("size"))
    ap = F.try_divide("_ap", F.col("_P"))
    return agg.select(*keys, "size", prev.alias("prevalence"), F.try_divide(F.col("_auc"), F.col("_P") * F.col("_N")).alias("auroc"), ap.alias("average_precision"), F.try_divide(ap, prev).alias("ap_lift"))


def threshold_metrics(df: DataFrame, keys: list[str], truth: str, predicted: str) -> DataFrame:
    """Recall, false-positive rate, specificity, precision and balanced accuracy of 0/1 predictions."""
    t, p = F.col(truth), F.col(predicted)
    c = df.groupBy(*keys).agg(F.sum(t * p).alias("tp"), F.sum((1 - t) * p).alias("fp"), F.sum(t * (1 - p)).alias("fn"), F.sum((1 - t) * (1 - p)).alias("tn"))
    recall, fpr = F.try_divide("tp", F.col("tp") + F.col("fn")), F.try_divide("fp", F.col("fp") + F.col("tn"))
    return c.select(*keys, recall.alias("recall"), fpr.alias("fpr"), (1 - fpr).alias("specificity"), F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), ((recall + 1 - fpr) / 2).alias("balanced_accuracy"))


def confusion(df: DataFrame, actual: str, predicted: str, weight: str | None = None, keys: list[str] | None = None) -> DataFrame:
    w = F.lit(1.0) if weight is None else F.col(weight)
    return df.groupBy(*(keys or []), actual, predicted).agg(F.sum(w).alias("w"))


def class_metrics(matrix: DataFrame, actual: str, predicted: str, keys: list[str] | None = None) -> DataFrame:
    """Per class precision, recall and F1 of a confusion table."""
    keys = keys or []
    hit = F.when(F.col(actual) == F.col(predicted), F.col("w")).otherwise(0.0)
    rows = matrix.groupBy(*keys, F.col(actual).alias("label")).agg(F.sum("w").alias("support"), F.sum(hit).alias("tp"))
    cols = matrix.groupBy(*keys, F.col(predicted).alias("label")).agg(F.sum("w").alias("called"))
    out = rows.join(cols, [*keys, "label"], "left").fillna(0.0, ["called"])
    p = F.coalesce(F.try_divide("tp", F.col("called")), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", F.col("support")), F.lit(0.0))
    return out.select(*keys, "label", "support", "tp", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def overall_metrics(per_class: DataFrame, keys: list[str] | None = None) -> DataFrame:
    s = F.sum("support")
    return per_class.groupBy(*(keys or [])).agg((F.sum("tp") / s).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / s).alias("weighted_f1"))


def max_difference(a: DataFrame, b: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """One row: largest absolute difference, rows without a partner, and whether both are within tolerance."""
    both = a.select(*key, F.col(value).alias("_a")).join(b.select(*key, F.col(value).alias("_b")), key, "full")
    alone = F.count_if(F.col("_a").isNull() | F.col("_b").isNull())
    return both.agg(F.max(F.abs(F.col("_a") - F.col("_b"))).alias("difference"), alone.alias("unpaired")).withColumn("ok", (F.coalesce("difference", F.lit(0.0)) <= tolerance) & (F.col("unpaired") == 0))


def gate(value, low: float, high: float):
    """PASS from high on, EXPLORATORY from low on, else FAIL; null is not testable."""
    return F.when(value.isNull(), "NOT_TESTABLE").when(value >= high, "PASS").when(value >= low, "EXPLORATORY").otherwise("FAIL")
