"""Calibration and calls of two-source fields: thresholds by count bin, a validation gate, ten statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import count_bin
from . import linear, mixture
from .aggregates import stated_quantiles

#: Fixed bins of rows per field.
BINS = ("1", "2", "3-4", "5-8", "9-16", "17-32", "33-64", "65+")
#: Fixed statuses, in the order they are tried.
STATUSES = (
    "NO_CALL_VALIDATION_FAILED", "NO_CALL_ONE_PIXEL", "NO_CALL_INSUFFICIENT_SPATIAL_BLOCKS", "OUT_OF_MODEL", "OUT_OF_FAMILY",
    "INTERCROP_SUPPORTED", "AMBIGUOUS_WIDE_INTERVAL", "PARENT_A_LIKE", "PARENT_B_LIKE", "AMBIGUOUS_NO_MIXTURE_EVIDENCE",
)


def pair_fields(rows: DataFrame, keys: list[str], block: str, labels: list, temperature: float, points: int = 201) -> DataFrame:
    """Measures of each group for its pair (columns pa and pb: places of its labels from 0, in log_scores).

    keys, rows, bin, blocks, share, evidence_per_row, named_mass (mean posterior of the two), far (90 % of rows are
    nearer to their nearest label than this squared distance), margin (log likelihood less the best other pair's).
    """
    post = linear.posteriors(F.col("log_scores"))
    mass = F.get(post, F.col("pa")) + F.get(post, F.col("pb"))
    own = rows.withColumns({"_a": F.get("log_scores", F.col("pa")), "_b": F.get("log_scores", F.col("pb")), "_mass": mass, "_far": -2.0 * temperature * F.array_max("log_scores")})
    share = mixture.mosaic_share(own, [*keys, "pa", "pb"], "_a", "_b", points)
    about = own.groupBy(*keys).agg(F.count_distinct(block).alias("blocks"), F.avg("_mass").alias("named_mass"), F.percentile("_far", F.lit(0.9)).alias("far"))
    every = mixture.all_pair_shares(own, keys, "log_scores", list(range(len(labels))), points).select(*keys, F.col("a").cast("int").alias("xa"), F.col("b").cast("int").alias("xb"), "log_likelihood")
    mine = share.select(*keys, "pa", "pb")
    other = every.join(mine, keys).where("NOT (xa = least(pa, pb) AND xb = greatest(pa, pb))").groupBy(*keys).agg(F.max("log_likelihood").alias("_other"))
    out = share.join(about, keys).join(other, keys, "left")
    return out.select(
        *keys, "pa", "pb", "rows", count_bin(F.col("rows")).alias("bin"), "blocks", "share", (F.col("evidence") / F.col("rows")).alias("evidence_per_row"),
        "named_mass", "far", (F.col("log_likelihood") - F.col("_other")).alias("margin"),
    )


def thresholds(controls: DataFrame, pair: str, evidence: float = 0.95, mass: float = 0.05, least: int = 5) -> DataFrame:
    """(pair, bin, evidence_threshold, mass_threshold, far_threshold, controls, source) for every bin; bins of few controls
    take those of all of the pair."""
    c = controls.withColumn("_e", F.round("evidence_per_row", 9))
    fine = stated_quantiles(c, [pair, "bin"], "_e", evidence, ["higher"]).where(F.col("n") >= least).select(pair, "bin", F.col("n").alias("_n"), F.col("higher").alias("_h"))
    wide = stated_quantiles(c, [pair], "_e", evidence, ["higher"])
    low = stated_quantiles(c, [pair], "named_mass", mass, ["lower"]).select(pair, F.col("lower").alias("mass_threshold"))
    far = stated_quantiles(c, [pair], "far", 0.95, ["higher"]).select(pair, F.col("higher").alias("far_threshold"))
    out = wide.join(low, pair).join(far, pair).withColumn("bin", F.explode(F.array(*map(F.lit, BINS)))).join(fine, [pair, "bin"], "left")
    return out.select(
        pair, "bin", F.coalesce("_h", "higher").alias("evidence_threshold"), "mass_threshold", "far_threshold", F.coalesce("_n", "n").alias("controls"),
        F.when(F.col("_h").isNotNull(), "matching_bin").otherwise("all_controls").alias("source"),
    )


def gates(controls: DataFrame, synthetic: DataFrame, pair: str, folds: int, accuracy: float, limits: dict[str, float]) -> DataFrame:
    """(pair, fields, endpoint_mae, synthetic_mae, passed): whether a pair's controls are good enough for calls.

    controls: pair, label, truth (share of the first source), share; synthetic: pair, truth, share.
    limits: fields (of the rarer label), accuracy, endpoint, synthetic.
    """
    fields = controls.groupBy(pair, "label").agg(F.count("*").alias("n")).groupBy(pair).agg(F.min("n").alias("fields"), F.count("*").alias("_labels"))
    error = lambda d, name: d.groupBy(pair).agg(F.avg(F.abs(F.col("share") - F.col("truth"))).alias(name))
    out = fields.join(error(controls, "endpoint_mae"), pair).join(error(synthetic, "synthetic_mae"), pair, "left")
    model = folds >= 2 and accuracy >= limits["accuracy"]
    ok = (F.col("_labels") == 2) & (F.col("fields") >= limits["fields"]) & (F.col("endpoint_mae") <= limits["endpoint"]) & F.coalesce(F.col("synthetic_mae") <= limits["synthetic"], F.lit(False))
    return out.select(pair, "fields", "endpoint_mae", "synthetic_mae", (F.lit(model) & ok).alias("passed"))


def status(epsilon: float = 0.02) -> Column:
    """The first status that fits: columns of pair_fields, thresholds and gates, named (the field is said to be this
    mixture), low and high (the share's interval, null where there is none)."""
    c = F.col
    inner = (c("share") > epsilon) & (c("share") < 1 - epsilon)
    sure = ~c("named") | F.coalesce((c("low") > epsilon) & (c("high") < 1 - epsilon), F.lit(False))
    mixed = (c("evidence_per_row") > c("evidence_threshold")) & inner
    tests = [
        ~F.coalesce("passed", F.lit(False)), c("rows") < 2, c("named") & (c("blocks") < 2), c("far") > c("far_threshold"),
        (c("named_mass") < c("mass_threshold")) | (c("margin") < 0), mixed & sure, mixed, c("share") >= 1 - epsilon, c("share") <= epsilon,
    ]
    out = F
    for test, name in zip(tests, STATUSES, strict=False):
        out = out.when(test, name)
    return out.otherwise(STATUSES[-1])


def called(fields: DataFrame, limits: DataFrame, gate: DataFrame, pair: str, epsilon: float = 0.02) -> DataFrame:
    """fields with their thresholds, gate and status."""
    return fields.join(limits, [pair, "bin"], "left").join(gate.select(pair, "passed"), pair, "left").withColumn("status", status(epsilon))
