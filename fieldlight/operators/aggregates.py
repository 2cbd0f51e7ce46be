"""Aggregation operators: budgets, weights, moments, roll-ups, state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def work_tiles(df: DataFrame, keys: list[str], pad: float) -> DataFrame:
    """Padded box and number of points per tile."""
    box = [F.min("longitude").alias("west"), F.min("latitude").alias("south"), F.max("longitude").alias("east"), F.max("latitude").alias("north")]
    out = df.groupBy(*keys).agg(*box, F.count("*").alias("sample_count"))
    return out.withColumns({"west": F.col("west") - pad, "south": F.col("south") - pad, "east": F.col("east") + pad, "north": F.col("north") + pad})


def power_allocation(strata: DataFrame, groups: list[str], keys: list[str], total: int, floor: int, power: float) -> DataFrame:
    """Adds target to strata (groups, keys, n): each group's total, shared in proportion to capacity to a power.

    Everything is in closed form over the strata still open: a stratum has its floor (at most n), and of
    what its group has left its share, rounded down. Where all shares round to nothing, the largest
    remainders get one each; ties go to the larger share, then the greater key. Strata are grouped rows,
    in as many tasks as there are groups; a round is one window over them, and few rounds are needed,
    as each leaves less than one a stratum unless a stratum is full.
    """
    if total <= 0 or floor < 0 or not 0 <= power <= 1:
        raise ValueError("the total must be positive, the floor not negative, the power in [0, 1]")
    now = strata.where("n > 0").withColumn("target", F.least("n", F.lit(floor).cast("long"))).persist()
    sums = now.groupBy(*groups).agg(F.sum("n").alias("n"), F.sum("target").alias("reserved"))
    bad = sums.agg(F.count("*").alias("groups"), F.count_if(F.col("n") < total).alias("small"), F.count_if(F.col("reserved") > total).alias("high")).head()
    if not bad.groups or bad.small or bad.high:
        raise ValueError("no strata" if not bad.groups else "more samples are asked for than there are candidates" if bad.small else "the floors exceed the total")
    group = W.partitionBy(*(groups or [F.lit(0)]))
    room = F.col("n") - F.col("target")
    while True:
        share = F.when(room > 0, F.pow(room.cast("double"), F.lit(float(power)))).otherwise(0.0)
        step = now.withColumns({"_left": total - F.sum("target").over(group), "_share": share})
        step = step.withColumn("_share", F.coalesce(F.try_divide("_share", F.sum("_share").over(group)), F.lit(0.0)))
        step = step.withColumn("_exact", F.col("_left") * F.col("_share"))
        step = step.withColumns({"_whole": F.least(room, F.floor("_exact")), "_rest": F.col("_exact") - F.floor("_exact")})
        last = F.row_number().over(group.orderBy((room > 0).desc(), F.desc("_rest"), F.desc("_share"), *[F.desc(k) for k in keys]))
        one = ((F.sum("_whole").over(group) == 0) & (last <= F.col("_left")) & (room > 0)).cast("long")
        after = step.withColumn("target", F.col("target") + F.col("_whole") + one).select(*strata.columns, "target").persist()
        open_ = after.groupBy(*groups).agg(F.sum("target").alias("t")).where(F.col("t") < total).count()
        now.unpersist()
        now = after
        if not open_:
            return now


def stratum_targets(df: DataFrame, groups: list[str], keys: list[str], total: int, floor: int, power: float) -> DataFrame:
    """(groups, keys, n, target, inclusion_probability); the total is one group's."""
    got = power_allocation(df.groupBy(*groups, *keys).agg(F.count("*").alias("n")), groups, keys, total, floor, power)
    return got.withColumn("inclusion_probability", F.col("target") / F.col("n"))


def balanced_weights(df: DataFrame, nest: list[str]) -> DataFrame:
    """weight: equal total per value of nest[0], inside it per nest[1], and so on down to rows; all weights sum to 1."""
    # each level's number of groups in its parent, from pre-aggregated distinct keys
    out, weight = df, F.lit(1.0)
    for i in range(len(nest)):
        n = df.select(*nest[: i + 1]).distinct()
        n = n.groupBy(*nest[:i]).agg(F.count("*").alias(f"_n{i}")) if i else n.agg(F.count("*").alias("_n0"))
        out = out.join(n, nest[:i]) if i else out.crossJoin(n)  # one row
        weight = weight / F.col(f"_n{i}")
    rows = df.groupBy(*nest).agg(F.count("*").alias("_rows"))
    out = out.join(rows, nest).withColumn("weight", weight / F.col("_rows"))
    return out.drop("_rows", *[f"_n{i}" for i in range(len(nest))])


def vector_moments(df: DataFrame, keys: list[str], v: str, weight: Column | None = None) -> DataFrame:
    """(keys, mean, std): weighted mean and population deviation of each dimension, as arrays in order."""
    w = F.lit(1.0) if weight is None else weight
    each = df.select(*keys, w.alias("_w"), F.posexplode(v).alias("d", "x"))
    m = each.groupBy(*keys, "d").agg(F.sum("_w").alias("s"), F.sum(F.col("_w") * F.col("x")).alias("sx"), F.sum(F.col("_w") * F.col("x") * F.col("x")).alias("sxx"))
    mean = F.col("sx") / F.col("s")
    m = m.withColumns({"m": mean, "sd": F.sqrt(F.greatest(F.lit(0.0), F.col("sxx") / F.col("s") - mean * mean))})
    order = F.array_sort(F.collect_list(F.struct("d", "m", "sd")))  # one entry per dimension
    out = m.groupBy(*keys).agg(order.alias("o"))
    return out.select(*keys, F.col("o.m").alias("mean"), F.col("o.sd").alias("std"))


def mean_vectors(df: DataFrame, keys: list[str], v: str, weight: Column | None = None) -> DataFrame:
    return vector_moments(df, keys, v, weight).select(*keys, F.col("mean").alias(v))


def empirical_tail(df: DataFrame, controls: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(1 + controls at or above the value) / (controls + 1), by ranks over the union: no pairs are made."""
    both = df.withColumn("_c", F.lit(0)).unionByName(controls.select(*keys, value).withColumn("_c", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy(*keys)
    above = F.sum("_c").over(w.orderBy(F.col(value).desc()).rangeBetween(W.unboundedPreceding, 0))
    out = both.withColumn("tail", (1 + above) / (F.sum("_c").over(w) + 1)).where("_c = 0")
    return out.drop("_c")


def stated_quantiles(df: DataFrame, keys: list[str], value: str, p: float, methods: list[str]) -> DataFrame:
    """(keys, n, one column a method): the quantile by linear interpolation, or the order statistic below or above.

    Values are counted first, so only distinct values of a group are ranked; nothing is collected into arrays.
    """
    by = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = W.partitionBy(*(keys or [F.lit(0)]))
    by = by.withColumns({"_upto": F.sum("_c").over(w.orderBy(value)), "_n": F.sum("_c").over(w)})
    at = (F.col("_n") - 1) * p
    low, high = F.floor(at + 1e-9), F.ceil(at - 1e-9)
    pick = lambda place: F.min(F.when(F.col("_upto") > place, F.col(value)))
    out = by.groupBy(*keys).agg(F.first("_n").alias("n"), pick(low).alias("_low"), pick(high).alias("_high"))
    span = (F.col("n") - 1) * p
    made = {"lower": F.col("_low"), "higher": F.col("_high"), "linear": F.col("_low") + (F.col("_high") - F.col("_low")) * F.greatest(F.lit(0.0), span - F.floor(span + 1e-9))}
    return out.select(*keys, "n", *[made[m].alias(m) for m in methods])


def distribution(p: str) -> list[Column]:
    """Summary of a probability over a group."""
    c = F.col(p)
    q = F.percentile(p, F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9))))
    h = F.when((c <= 0) | (c >= 1), 0.0).otherwise(-(c * F.log(c) + (1 - c) * F.log(1 - c)))
    return [
        F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"), q[0].alias("q10"), q[1].alias("q25"), q[2].alias("q50"), q[3].alias("q75"), q[4].alias("q90"),
        (q[3] - q[1]).alias("iqr"), F.avg(1 - F.abs(2 * c - 1)).alias("balance"), F.avg((c < 0.1).cast("double")).alias("low_tail"),
        F.avg((c > 0.9).cast("double")).alias("high_tail"), F.avg(h).alias("entropy"),
    ]


def robust_channel(df: DataFrame, value: str, keys: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """value scaled so that its low and high quantile are 0 and 1, clipped."""
    q = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("_q"))
    joined = df.join(q, keys) if keys else df.crossJoin(q)  # one row
    span = F.greatest(F.col("_q")[1] - F.col("_q")[0], F.lit(1e-12))
    return joined.withColumn(value, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - F.col("_q")[0]) / span))).drop("_q")


def completion(tasks: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """One row: total, succeeded, missing, complete."""
    missing = expected.join(tasks, key, "left_anti").agg(F.count("*").alias("missing"))
    t = tasks.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "succeeded").alias("succeeded"))
    return t.crossJoin(missing).withColumn("complete", (F.col("missing") == 0) & (F.col("total") == F.col("succeeded")))


def apply_outcomes(state: DataFrame, events: DataFrame, key: str, most_attempts: int, base: float, most_delay: float) -> DataFrame:
    """Task states after a batch of outcomes: the latest per task decides; retries wait twice as long each time."""
    last = events.groupBy(key).agg(F.max_by("outcome", F.struct("at", "outcome")).alias("_o"))
    s = state.join(last, key, "left")
    tries = F.col("attempts")
    again = tries < most_attempts
    status = (
        F.when(F.col("_o").isin("complete", "insufficient"), "succeeded").when(F.col("_o") == "retry", F.when(again, "pending").otherwise("failed"))
        .when(F.col("_o") == "fatal", "failed").when(F.col("_o") == "expired", F.when(again, "pending").otherwise("failed")).otherwise(F.col("status"))
    )
    delay = F.when(status.eqNullSafe(F.lit("pending")) & F.col("_o").isNotNull(), F.least(F.lit(most_delay), base * F.pow(F.lit(2.0), tries - 1)))
    return s.withColumns({"new_status": status, "delay": delay}).drop("_o")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key, new ones winning."""
    rank = old.withColumn("_r", F.lit(0)).unionByName(new.withColumn("_r", F.lit(1)))
    best = rank.groupBy(key).agg(F.max_by(F.struct(*[c for c in old.columns if c != key]), "_r").alias("_b"))
    return best.select(key, "_b.*").select(old.columns)
