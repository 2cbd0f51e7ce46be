"""Data contracts: each gives a DataFrame of violations (rule, key, detail); enforce() raises if there are any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import dealt, spread_over


class ContractError(ValueError):
    """A contract has violations."""


def violations(df: DataFrame, key, rules: dict[str, Column], detail=None) -> DataFrame:
    """One row per broken rule: rules name a predicate that must hold; null counts as broken."""
    key = F.concat_ws("|", *key) if isinstance(key, (list, tuple)) else F.col(key)
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda r: r.isNotNull())
    what = (F.lit(None) if detail is None else detail).cast("string").alias("detail")
    return df.select(F.explode(broken).alias("rule"), key.cast("string").alias("key"), what)


def enforce(found: DataFrame, most: int = 10) -> None:
    rows = found.limit(most).collect()  # a few rows for the message
    if rows:
        raise ContractError("; ".join(f"{r.rule}: {r.key} {r.detail or ''}".strip() for r in rows))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def unique(df: DataFrame, key: list, rule: str = "unique") -> DataFrame:
    """Keys that occur more than once."""
    columns = [F.col(k) if isinstance(k, str) else k for k in key]
    by = df.repartition(spread_over(df.sparkSession), *columns).groupBy(*columns)
    found = by.agg(F.count("*").alias("_n")).where("_n > 1")
    return found.select(F.lit(rule).alias("rule"), F.concat_ws("|", *found.columns[:-1]).alias("key"), F.col("_n").cast("string").alias("detail"))


def constant(df: DataFrame, key: list[str], value, rule: str) -> DataFrame:
    """Keys whose value is not the same in all rows: no block in two splits, one fingerprint per task."""
    found = df.groupBy(*key).agg(F.min(value).alias("_a"), F.max(value).alias("_b")).where("_a <> _b")
    return found.select(F.lit(rule).alias("rule"), F.concat_ws("|", *key).alias("key"), F.concat_ws("|", F.col("_a").cast("string"), F.col("_b").cast("string")).alias("detail"))


def references(df: DataFrame, key: str, other: DataFrame, rule: str) -> DataFrame:
    """Keys without a row in other."""
    missing = dealt(df.select(key), [key]).distinct().join(dealt(other.select(key), [key]).distinct(), key, "left_anti")
    return missing.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.lit(None).cast("string").alias("detail"))


def same_rows(a: DataFrame, b: DataFrame, rule: str) -> DataFrame:
    """Rows in one and not the other, with repeats."""
    side = lambda x, y, name: x.exceptAll(y).select(F.lit(rule).alias("rule"), F.to_json(F.struct("*")).alias("key"), F.lit(name).alias("detail"))
    return side(a, b, "missing").unionByName(side(b, a, "extra"))


def candidate_contract(df: DataFrame, countries: list[str]) -> DataFrame:
    """Unique ids and rounded places, known countries, non-empty blocks and strata."""
    place = [F.bround("longitude", 8).alias("lon"), F.bround("latitude", 8).alias("lat")]
    rules = {"country": F.col("country").isin(countries), "block": F.trim("spatial_block") != "", "stratum": F.trim("stratum") != ""}
    return union([unique(df, ["candidate_id"], "unique_id"), unique(df, place, "unique_place"), violations(df, "candidate_id", rules)])


def years_contract(df: DataFrame, key: list[str], year: str, years: list[int], meta: list[str]) -> DataFrame:
    """Every key has exactly these years and the same metadata in each."""
    found = df.groupBy(*key).agg(F.sort_array(F.collect_set(year)).alias("_y"), F.count("*").alias("_n"), F.count_distinct(F.struct(*meta)).alias("_m"))
    rules = {"years": (F.col("_y") == F.array(*map(F.lit, sorted(years)))) & (F.col("_n") == len(years)), "constant_meta": F.col("_m") == 1}
    return violations(found, key, rules)


def observation_contract(df: DataFrame, bands: int, low: float, high: float) -> DataFrame:
    """Field ranges, calendar agreement, the validity rule, unique identity of (sample_id, epoch_day, orbit)."""
    rules = {
        "bands": (F.size("bands") == bands) & F.forall("bands", lambda x: x.isNotNull() & x.between(low, high)),
        "calendar": F.unix_date(F.to_date("acquired")) == F.col("epoch_day"),
        "orbit": F.col("orbit").isin(-1, 1),
        "valid": F.col("valid") == F.exists("bands", lambda x: x != 0),
    }
    return union([violations(df, "obs_id", rules), unique(df, ["sample_id", "epoch_day", "orbit"], "identity")])


def complete_vector_contract(df: DataFrame, key: str, outcome: str, vector: str, size: int) -> DataFrame:
    """Complete rows have a finite vector, others none."""
    from ..functions.vectors import is_finite

    ok = F.when(F.col(outcome) == "complete", is_finite(F.col(vector), size)).otherwise(F.col(vector).isNull())
    return violations(df, key, {"vector_of_outcome": ok}, F.col(outcome))


def never_falls(df: DataFrame, key: list[str], order: str, value: str, rule: str = "never_falls") -> DataFrame:
    """Rows whose value is less than the row before's."""
    before = F.lag(value).over(W.partitionBy(*key).orderBy(order))
    marked = df.withColumn("_before", before)
    return violations(marked, [*key, order], {rule: F.coalesce(F.col(value) >= F.col("_before"), F.lit(True))}, F.col("_before") - F.col(value))


def timeline_contract(df: DataFrame, key: str, obs: str, day: str, bands: int) -> DataFrame:
    """Unique observation ids per timeline and the right number of bands; days in order of ids."""
    return union([unique(df, [key, obs], "unique_observation"), violations(df, [key, obs], {"width": F.size("bands") == bands}), never_falls(df, [key], obs, day, "chronological").select("rule", "key", "detail")])


def seed_contract(seed: DataFrame, extension: DataFrame, day: str, cutoff: int) -> DataFrame:
    """The seed ends before the cutoff, the extension begins on it or later."""
    a = violations(seed.agg(F.max(day).alias("d")), "d", {"seed_before_cutoff": F.coalesce(F.col("d") < cutoff, F.lit(True))})
    return a.unionByName(violations(extension.agg(F.min(day).alias("d")), "d", {"extension_after_cutoff": F.coalesce(F.col("d") >= cutoff, F.lit(True))}))


def cardinality(df: DataFrame, want: Column, rule: str = "cardinality") -> DataFrame:
    """One row if the aggregate want does not hold."""
    return violations(df.agg(want.alias("_ok")), "_ok", {rule: F.col("_ok")})


def missing_rate(df: DataFrame, missing: Column, most: float, keys: list[str]) -> DataFrame:
    """Groups with a larger share of missing rows."""
    rate = df.groupBy(*keys).agg(F.avg(missing.cast("double")).alias("_r"))
    return violations(rate, keys, {"missing_rate": F.col("_r") <= most}, F.round("_r", 6))


def batch_contract(df: DataFrame, batch: str, sample: str, block: str, split: str) -> DataFrame:
    """At least two samples and blocks, unique samples, only the train split."""
    by = df.groupBy(batch).agg(F.count("*").alias("n"), F.count_distinct(sample).alias("s"), F.count_distinct(block).alias("b"), F.bool_and(F.col(split) == "train").alias("t"))
    return violations(by, batch, {"two_samples": F.col("s") >= 2, "two_blocks": F.col("b") >= 2, "unique_samples": F.col("n") == F.col("s"), "train_only": F.col("t")})


def leakage(df: DataFrame, keys: list[str], split: str) -> DataFrame:
    """Keys that occur in more than one split."""
    return union([constant(df, [k], split, f"leak_{k}") for k in keys])


def class_mapping(df: DataFrame, label: str, number: str, split: str, splits: list[str]) -> DataFrame:
    """One number per label and back, numbers without gaps, no empty split."""
    spread = df.agg((F.max(number) - F.min(number) + 1 == F.count_distinct(number)).alias("_ok"))
    empty = df.agg(*[F.coalesce(F.bool_or(F.col(split) == s), F.lit(False)).alias(s) for s in splits])
    return union([constant(df, [label], number, "one_number"), constant(df, [number], label, "one_label"), violations(spread, "_ok", {"contiguous": F.col("_ok")}),
                  violations(empty.withColumn("_k", F.lit("all")), "_k", {f"split_{s}": F.col(s) for s in splits})])


def binding(state: DataFrame, want: DataFrame) -> DataFrame:
    """(key, value) rows of a state table that differ from the inputs it is to be used with."""
    both = state.withColumnRenamed("value", "_a").join(want.withColumnRenamed("value", "_b"), "key", "full")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(F.lit("binding").alias("rule"), "key", F.concat_ws("|", "_a", "_b").alias("detail"))


def band_order(df: DataFrame, bands: str, canonical: list[str]) -> DataFrame:
    """Adds canonical: whether the named bands of a row are the canonical ones, in their order."""
    return df.withColumn("canonical", F.coalesce(F.col(bands) == F.array(*map(F.lit, canonical)), F.lit(False)))
