"""Cohort cleaning: canonical rows, private pixels, staged attrition, common rows of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import dealt
from .windows import first_rows


def distinct_over(value: str, keys: list[str]) -> Column:
    """Distinct values of a group beside each row, from the ends where two are enough is not wanted; groups are bounded."""
    return F.size(F.collect_set(value).over(W.partitionBy(*keys)))


def with_group_counts(df: DataFrame, keys: list[str], **values: str) -> DataFrame:
    """Distinct counts of a group joined to its rows: pre-aggregated, so hot groups do not meet in one window."""
    df = dealt(df, keys)
    counts = df.groupBy(*keys).agg(*[F.count_distinct(c).alias(k) for k, c in values.items()])
    return df.join(counts, keys)


def canonical_fields(df: DataFrame, geometry: str, label: str, key: str) -> DataFrame:
    """Adds canonical (least key of the geometry and label) and conflict (the geometry has several labels)."""
    g = df.groupBy(geometry).agg((F.count_distinct(label) > 1).alias("conflict"))
    c = df.groupBy(geometry, label).agg(F.min(key).alias("canonical"))
    return df.join(c, [geometry, label]).join(g, geometry)


def attrition(stages: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """(stage, position, n) of a list of ever smaller frames."""
    parts = [df.agg(F.count_distinct(key).alias("n")).select(F.lit(name).alias("stage"), F.lit(i).alias("position"), "n") for i, (name, df) in enumerate(stages)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def private_pixels(member: DataFrame, excluded: DataFrame, field: str, pixel: str, label: str) -> DataFrame:
    """Membership rows after excluded fields went, whose pixel then belongs to one field and one label."""
    left = member.join(excluded.select(field).distinct(), field, "left_anti")
    left = dealt(left, [pixel])
    one = lambda c: F.min(c) == F.max(c)
    own = left.groupBy(pixel).agg((one(field) & one(label)).alias("_own")).where("_own")
    return left.join(own.select(pixel), pixel, "left_semi")


def unambiguous(df: DataFrame, pixel: str, label: str, ok: Column, order: list) -> tuple[DataFrame, DataFrame]:
    """(one row per pixel with one label and a good vector, audit counts)."""
    good = df.where(ok)
    counts = good.groupBy(pixel).agg(F.count_distinct(label).alias("_l"))
    kept = first_rows(good.join(counts.where("_l = 1").select(pixel), pixel, "left_semi"), [pixel], order)
    audit = df.agg(F.count("*").alias("rows"), F.sum((~ok).cast("long")).alias("bad")).crossJoin(counts.agg(F.count_if(F.col("_l") > 1).alias("conflicts"), F.count_if(F.col("_l") == 1).alias("kept")))
    return kept, audit


def scoreable(member: DataFrame, field: str, pixel: str, label: str, least_pixels: int, least_fields: int, top: int) -> DataFrame:
    """Labels with enough fields of enough pixels, most fields first, at most top of them."""
    f = member.groupBy(label, field).agg(F.count_distinct(pixel).alias("n")).where(F.col("n") >= least_pixels)
    return f.groupBy(label).agg(F.count("*").alias("fields"), F.sum("n").alias("pixels")).where(F.col("fields") >= least_fields).orderBy(F.desc("fields"), label).limit(top)


def in_all_windows(df: DataFrame, keys: list[str], window: str, k: int) -> DataFrame:
    """Keys that occur in all k windows, by one grouped count."""
    return df.groupBy(*keys).agg(F.count_distinct(window).alias("_w")).where(F.col("_w") == k).drop("_w")


def fully_published(df: DataFrame, expected: DataFrame, field: str, window: str, k: int) -> DataFrame:
    """Fields whose count equals the expected one in every window."""
    got = df.groupBy(field, window).agg(F.count("*").alias("_n"))
    return got.join(expected, field).where("_n = expected").groupBy(field).agg(F.count("*").alias("_w")).where(F.col("_w") == k).select(field)


def largest_per_class(df: DataFrame, field: str, label: str, geometry: str, size: str, n: int) -> DataFrame:
    """Largest fields per label after geometries with several labels and repeats went."""
    one = canonical_fields(df, geometry, label, field).where(~F.col("conflict") & (F.col(field) == F.col("canonical")))
    return first_rows(one, [label], [F.col(size).desc(), F.col(field)], n).drop("canonical", "conflict")
