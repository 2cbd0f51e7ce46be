"""Analytic-window operators: ranks, canonical rows, spaced rows, folds, lags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def raster_window(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Tight window of each group and top-down row and column of each cell in it."""
    w = W.partitionBy(*keys)
    x0, x1, y0, y1 = F.min(x).over(w), F.max(x).over(w), F.min(y).over(w), F.max(y).over(w)
    return df.withColumns({"width": x1 - x0 + 1, "height": y1 - y0 + 1, "local_row": y1 - F.col(y), "local_col": F.col(x) - x0})


def first_rows(df: DataFrame, keys: list[str], order: list, n: int | Column = 1) -> DataFrame:
    """The first n rows of each group. Spark prunes ranks before the shuffle where n is a number."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def ordinal(df: DataFrame, keys: list[str], order: list, name: str = "ordinal") -> DataFrame:
    """Position in the group from 0, and the size of the group."""
    w = W.partitionBy(*keys)
    return df.withColumn(name, F.row_number().over(w.orderBy(*order)) - 1).withColumn(f"{name}_count", F.count("*").over(w))


def spaced_rows(df: DataFrame, keys: list[str], order: list, m: int) -> DataFrame:
    """Rows at m evenly spaced positions of each group; all rows of smaller groups."""
    at = ordinal(df, keys, order, "_at")
    n = F.col("_at_count")
    step = (n - 1) / F.lit(max(m - 1, 1)).cast("double")
    places = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.when(i == m - 1, F.greatest(n - 1, F.lit(0)) if m > 1 else F.lit(0)).otherwise(F.floor(i * step)))
    return at.where((n <= m) | F.array_contains(places.cast("array<long>"), F.col("_at").cast("long"))).drop("_at", "_at_count")


def resampled(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """Every group as k rows with position seq: middles of k even chunks, or all rows and then rounded interior repeats."""
    at = ordinal(df, keys, order, "_at")
    sizes = at.groupBy(*keys).agg(F.max("_at_count").cast("int").alias("_n"))
    n = F.col("_n")
    i = F.col("seq")
    extra, base = n % k, F.floor(n / k).cast("int")
    start = F.when(i < extra, i * (base + 1)).otherwise(extra * (base + 1) + (i - extra) * base)
    size = F.when(i < extra, base + 1).otherwise(base)
    spare = F.lit(k) - n
    gap = (n - 1).cast("double") / (spare + 1)
    more = F.rint((i - n + 1) * gap).cast("int")
    want = sizes.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    want = want.withColumn("_at", F.when(n >= k, start + F.floor(size / 2)).when(i < n, i).otherwise(more).cast("int")).drop("_n")
    return at.drop("_at_count").join(want, [*keys, "_at"]).drop("_at")


def fold_of(df: DataFrame, keys: list[str], rank: Column, k: int, name: str = "fold") -> DataFrame:
    """Fold by position in hashed order, modulo k, inside each group."""
    return df.withColumn(name, (F.row_number().over(W.partitionBy(*keys).orderBy(rank)) - 1) % k)


def previous(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Columns of the row before, as prev_*."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})


def typical(df: DataFrame, keys: list[str], value: str, size: str, key: str) -> DataFrame:
    """The row nearest to its group's median; ties to the larger size, then the smaller key."""
    mid = F.percentile(value, F.lit(0.5)).over(W.partitionBy(*keys))
    near = df.withColumn("_gap", F.round(F.abs(F.col(value) - mid), 9))
    return first_rows(near, keys, [F.col("_gap"), F.col(size).desc(), F.col(key)]).drop("_gap")


def operating_point(df: DataFrame, truth: str, score: str, most_fpr: float, keys: list[str] | None = None) -> DataFrame:
    """Best threshold with a false-positive rate of at most most_fpr: by recall, precision, then rate and threshold. Groups without negatives have no rate and no row."""
    keys = keys or []
    by = df.groupBy(*keys, score).agg(F.sum(truth).alias("p"), F.sum(1 - F.col(truth)).alias("n"))
    w = W.partitionBy(*keys)
    run = w.orderBy(F.col(score).desc()).rowsBetween(W.unboundedPreceding, 0)
    tp, fp = F.sum("p").over(run), F.sum("n").over(run)
    c = by.withColumns({"recall": F.try_divide(tp, F.sum("p").over(w)), "fpr": F.try_divide(fp, F.sum("n").over(w)), "precision": F.try_divide(tp, tp + fp)})
    best = F.max(F.struct("recall", "precision", (-F.col("fpr")).alias("m"), F.col(score).alias("threshold"))).alias("b")
    out = c.where(F.col("fpr") <= most_fpr).groupBy(*keys).agg(best)
    return out.select(*keys, "b.threshold", "b.recall", "b.precision", (-F.col("b.m")).alias("fpr"))


def argmax_class(p: Column) -> tuple[Column, Column]:
    """Position (from 0) and value of the largest entry."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int"), F.array_max(p)


def first_available(df: DataFrame, keys: list[str], kind: str, order: list[str]) -> DataFrame:
    """The row whose kind comes first in a priority list."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(kind))
    return first_rows(df.where(place > 0), keys, [place])


def placed(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows in the order of the columns, with their place from 1: a range partition, local ranks and the sizes before."""
    sorted_ = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    local = sorted_.withColumn("_rank", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    sizes = sorted_.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a partition
    before = sizes.withColumn("_before", F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).drop("_n")
    return local.join(before, "_part").withColumn("place", F.col("_rank") + F.col("_before")).drop("_part", "_rank", "_before")
