"""Observation mosaics, views and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import hash_rank, unit_interval


def daily_first_valid(df: DataFrame, keys: list[str], order: list[str], valid: str, bands: str, item: str) -> DataFrame:
    """One row per key: all bands of the first valid item in order, else zeros, not valid, with the first item."""
    at = F.struct(*order)
    row = F.struct(F.col(item).alias("item"), F.col(bands).alias("bands"))
    good = F.min_by(F.when(F.col(valid), row), F.when(F.col(valid), at))
    any_ = F.min_by(row, at)
    out = df.groupBy(*keys).agg(good.alias("g"), any_.alias("f"))
    zero = F.transform(F.col("f.bands"), lambda x: x * 0)
    return out.select(*keys, F.col("g").isNotNull().alias("valid"), F.coalesce("g.item", "f.item").alias("item"), F.coalesce(F.col("g.bands"), zero).alias("bands"))


def first_nonzero_each(df: DataFrame, keys: list[str], order: list[str], bands: list[str], item: str) -> DataFrame:
    """Each band by itself from its first non-zero item; composite where the items differ, with a digest of both."""
    at = F.struct(*order)
    picks = []
    for b in bands:
        ok = F.col(b) != 0
        picks.append(F.min_by(F.when(ok, F.struct(F.col(b).alias("v"), F.col(item).alias("i"))), F.when(ok, at)).alias(f"_{b}"))
    out = df.groupBy(*keys).agg(*picks)
    ids = F.array_distinct(F.filter(F.array(*[F.col(f"_{b}.i") for b in bands]), lambda x: x.isNotNull()))
    out = out.withColumn("composite", F.size(ids) > 1).withColumn("provenance", F.sha2(F.to_json(ids), 256))
    return out.select(*keys, *[F.coalesce(F.col(f"_{b}.v"), F.lit(0.0)).alias(b) for b in bands], "composite", "provenance")


def sampled_view(df: DataFrame, keys: list[str], key: str, day: str, most: int, dropout: float, seed: str = "") -> DataFrame:
    """At most `most` rows per group by hash, each but the first left out with a probability, in order of days with place."""
    k = F.col(key).cast("string")
    ranked = df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(hash_rank(F.lit("v" + seed), k))))
    kept = ranked.where((F.col("_k") <= most) & ((F.col("_k") == 1) | (unit_interval(F.lit("d" + seed), k) >= dropout)))
    return kept.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(day, key)) - 1).drop("_k")


def causal_windows(df: DataFrame, key: str, batch: Column, day: str, least: int, prefix: float) -> DataFrame:
    """One duration per batch, log-uniform between least and the batch's shortest coverage; starts at the first day or uniform."""
    s = df.groupBy(key).agg(F.min(day).alias("_a"), (F.max(day) + 1).alias("_z")).withColumn("batch", batch)
    cover = s.groupBy("batch").agg(F.min(F.col("_z") - F.col("_a")).alias("_c"))
    u1, u2 = unit_interval(F.lit("w"), F.col("batch").cast("string")), unit_interval(F.lit("s"), F.col(key).cast("string"))
    low = F.log(F.lit(float(least)))
    days = F.least(F.col("_c"), F.floor(F.exp(low + u1 * (F.log(F.col("_c")) - low)))).cast("int")
    s = s.join(cover, "batch").withColumns({"days": days, "_u": u2})
    start = F.when(F.col("_u") < prefix, F.col("_a")).otherwise((F.col("_a") + F.floor((F.col("_u") - prefix) / (1 - prefix) * (F.col("_z") - F.col("_a") - F.col("days") + 1))).cast("int"))
    return s.select(key, "batch", start.alias("start"), "days")


def representatives(df: DataFrame, key: str, roles: list[tuple[str, Column, list]]) -> DataFrame:
    """(role, key): the first row by each role's order that no earlier role took."""
    left, out = df, None
    for name, ok, order in roles:
        one = left.where(ok).orderBy(*order).limit(1).select(F.lit(name).alias("role"), key)
        out = one if out is None else out.unionByName(one)
        left = left.join(one.select(key), key, "left_anti")
    return out


def extended_timeline(seed: DataFrame, source: DataFrame, day: str, cutoff: int) -> DataFrame:
    """A finished seed and what came on the cutoff day or later."""
    return seed.where(F.col(day) < cutoff).unionByName(source.where(F.col(day) >= cutoff))


def outcomes(expected: DataFrame, rows: DataFrame, keys: list[str], valid: Column, least: int, sums: dict[str, str] | None = None) -> DataFrame:
    """complete, insufficient or none per expected key, by the number of valid rows; sums: columns of rows to be added up, and their names."""
    added = [F.sum(c).alias(name) for c, name in (sums or {}).items()]
    n = rows.groupBy(*keys).agg(F.count_if(valid).alias("valid_rows"), F.count("*").alias("rows"), *added)
    out = expected.join(n, keys, "left").fillna(0, ["valid_rows", "rows"])
    status = F.when(F.col("rows") == 0, "none").when(F.col("valid_rows") < least, "insufficient").otherwise("complete")
    return out.withColumn("outcome", status)
