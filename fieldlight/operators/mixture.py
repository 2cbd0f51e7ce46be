"""Two-source shares, segment and simplex projections, bootstraps."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.hashing import hash_rank
from .aggregates import mean_vectors
from .linear import HELD_GROUPS, MERGE_PARTS, added, literal, moments, summed
from .windows import placed


#: Rows whose likelihoods at all grid points are held at once.
GRID_ROWS = 2048


def _grid_sums(la: np.ndarray, lb: np.ndarray, wt: np.ndarray, group: np.ndarray, groups: int, grid: np.ndarray) -> np.ndarray:
    """(groups, grid) sums of the rows' log likelihoods; group is ascending."""
    out = np.zeros((groups, len(grid)))
    for at in range(0, len(group), GRID_ROWS):
        a, b, w, own = (x[at : at + GRID_ROWS] for x in (la[:, None], lb[:, None], wt[:, None], group))
        top = np.maximum(a, b)
        ll = w * (top + np.log(grid * np.exp(a - top) + (1 - grid) * np.exp(b - top) + 1e-300))
        heads = np.flatnonzero(np.r_[True, np.diff(own) != 0])
        out[own[heads]] += np.add.reduceat(ll, heads, axis=0)
    return out


def grid_likelihoods(df: DataFrame, keys: list[str], a: str, b: str, points: int, weight: str | None = None) -> DataFrame:
    """(keys, rows, ll): log likelihood of each group at each share of an even grid, as an array.

    Rows are never multiplied by grid points. A batch gives one partial array for a group whose rows in it take more room than that,
    and those meet in MERGE_PARTS parts first, so a hot group is spread over all tasks; of other groups it gives the rows as they
    are, and an array is made where they meet.
    """
    w = F.lit(1.0) if weight is None else F.col(weight)
    rows = df.select(*keys, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"), w.cast("double").alias("_w"))
    grid = np.linspace(0, 1, points)
    least = points // 3  # rows of three numbers as large as an array

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            group = frame.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            many = np.bincount(group)[group] > least
            if not many.all():
                yield frame[~many].assign(rows=1, ll=None, _thick=False)
            if many.any():
                order = np.flatnonzero(many)[np.argsort(group[many], kind="stable")]
                heads = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
                counts = np.diff(np.r_[heads, len(order)])
                la, lb, wt = (frame[c].to_numpy()[order] for c in ("_a", "_b", "_w"))
                ll = _grid_sums(la, lb, wt, np.repeat(np.arange(len(heads)), counts), len(heads), grid)
                yield frame[[*keys]].iloc[order[heads]].assign(_a=np.nan, _b=np.nan, _w=np.nan, rows=counts, ll=list(ll), _thick=True)

    def met(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for frame in frames:
            if not len(frame):
                continue
            group = frame.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(group, kind="stable")
            heads = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
            thick = frame["_thick"].to_numpy(dtype=bool)
            thin = order[~thick[order]]
            la, lb, wt = (frame[c].to_numpy()[thin] for c in ("_a", "_b", "_w"))
            ll = _grid_sums(la, lb, wt, group[thin], len(heads), grid)
            for i in np.flatnonzero(thick):
                ll[group[i]] += frame["ll"].iat[i]
            out = frame[keys].iloc[order[heads]].reset_index(drop=True)
            out = out.assign(rows=np.add.reduceat(frame["rows"].to_numpy()[order], heads), ll=list(ll))
            held = out if held is None else pd.concat([held, out], ignore_index=True)
            if len(held) >= HELD_GROUPS:
                held = held.groupby(keys, dropna=False, sort=False, as_index=False).agg({"rows": "sum", "ll": "sum"})
                if len(held) >= HELD_GROUPS // 2:
                    yield held
                    held = None
        if held is not None:
            yield held.groupby(keys, dropna=False, sort=False, as_index=False).agg({"rows": "sum", "ll": "sum"})

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    some = rows.mapInPandas(part, f"{own}, _a double, _b double, _w double, rows long, ll array<double>, _thick boolean")
    where = F.when(F.col("_thick"), 1 + F.spark_partition_id() % MERGE_PARTS).otherwise(0)
    some = some.withColumn("_part", where).repartition(*keys, "_part").sortWithinPartitions(*keys).drop("_part")
    partial = some.mapInPandas(met, f"{own}, rows long, ll array<double>")
    return summed(partial, keys, ["rows"], ["ll"])


def _best(ll: Column, points: int) -> Column:
    """(ll, r, share) of the best grid point: ties to the share nearest 0.5, then the smaller."""
    grid = np.linspace(0, 1, points)
    order = sorted(range(points), key=lambda i: (abs(grid[i] - 0.5), i))
    place = F.array(*[F.struct(F.lit(-order.index(i)).alias("r"), F.lit(float(grid[i])).alias("share")) for i in range(points)])
    return F.array_max(F.zip_with(ll, place, lambda x, p: F.struct(F.round(x, 9).alias("ll"), p["r"].alias("r"), p["share"].alias("share"))))


def mosaic_share(df: DataFrame, keys: list[str], a: str, b: str, points: int = 201, weight: str | None = None) -> DataFrame:
    """(keys, rows, share, evidence, log_likelihood): the share of source a that makes the rows likeliest.

    a and b are log likelihoods of a row under either source; evidence is the gain over the better pure source.
    """
    g = grid_likelihoods(df, keys, a, b, points, weight)
    pure = F.greatest(F.round(F.col("ll")[0], 9), F.round(F.col("ll")[points - 1], 9))
    out = g.select(*keys, "rows", _best(F.col("ll"), points).alias("_b"), pure.alias("_p"))
    return out.select(*keys, "rows", F.col("_b.share").alias("share"), (F.col("_b.ll") - F.col("_p")).alias("evidence"), F.col("_b.ll").alias("log_likelihood"))


def responsibility(a: Column, b: Column, share: Column) -> Column:
    """Probability that a row is of source a, given the group's share."""
    top = F.greatest(a, b)
    pa, pb = share * F.exp(a - top), (1 - share) * F.exp(b - top)
    return F.when(pa + pb > 0, pa / (pa + pb)).otherwise(0.5)


def all_pair_shares(df: DataFrame, keys: list[str], log_scores: str, labels: list, points: int = 101) -> DataFrame:
    """Best share and likelihood for every pair of labels; margin is the best pair's lead."""
    pairs = F.array(*[F.struct(F.lit(str(labels[i])).alias("a"), F.lit(str(labels[j])).alias("b"), F.col(log_scores)[i].alias("la"), F.col(log_scores)[j].alias("lb")) for i, j in combinations(range(len(labels)), 2)])
    return mosaic_share(df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*"), [*keys, "a", "b"], "la", "lb", points)


def best_pair(shares: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, share, margin) of the likeliest pair."""
    top = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("log_likelihood", "a", "b", "share")))), 1, 2)
    g = shares.groupBy(*keys).agg(top.alias("t"))  # one entry per pair of labels
    return g.select(*keys, F.col("t")[0]["a"].alias("a"), F.col("t")[0]["b"].alias("b"), F.col("t")[0]["share"].alias("share"), (F.col("t")[0]["log_likelihood"] - F.try_element_at("t", F.lit(2))["log_likelihood"]).alias("margin"))


def draws(groups: DataFrame, keys: list[str], unit: str, replicates: int, seed: str = "") -> DataFrame:
    """(keys, replicate, unit, weight): each replicate draws as many units as a group has, with replacement.

    groups has distinct (keys, unit). Units are numbered in order by a range partition, and each is a slot, which picks a
    number by hash in every replicate: no row holds the units of a group, and the draws are the same everywhere.
    """
    at = placed(groups.select(*keys, unit), [*keys, unit])
    at = at.join(at.groupBy(*keys).agg(F.min("place").alias("_first"), F.count("*").alias("_m")), keys).withColumn("_s", F.col("place") - F.col("_first"))
    slots = at.select(*keys, "_s", "_m", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    pick = F.pmod(hash_rank(F.lit(seed), *[F.col(k).cast("string") for k in keys], F.col("replicate").cast("string"), F.col("_s").cast("string")), F.col("_m").cast("decimal(20,0)")).cast("long")
    drawn = slots.select(*keys, "replicate", pick.alias("_s")).groupBy(*keys, "replicate", "_s").agg(F.count("*").cast("double").alias("weight"))
    return drawn.join(at.select(*keys, "_s", unit), [*keys, "_s"]).select(*keys, "replicate", unit, "weight")


def bootstrap_share(df: DataFrame, keys: list[str], block: str, a: str, b: str, replicates: int, points: int = 51, units: DataFrame | None = None) -> DataFrame:
    """(keys, low, median, high): share over block bootstrap replicates, from block sums per grid point.

    units: the distinct (keys, block) of df, where the caller has them without the work behind a and b.
    """
    blocks = grid_likelihoods(df, [*keys, block], a, b, points)
    w = draws(df.select(*keys, block).distinct() if units is None else units, keys, block, replicates)
    scaled = blocks.join(w, [*keys, block]).withColumn("ll", F.transform("ll", lambda x: x * F.col("weight")))
    total = added(scaled, [*keys, "replicate"], [], ["ll"])
    q = F.percentile("share", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    out = total.withColumn("share", _best(F.col("ll"), points)["share"]).groupBy(*keys).agg(q.alias("q"))
    return out.select(*keys, F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high"))


def reference_replicates(references: DataFrame, rows: DataFrame, pairs: DataFrame, window: str, label: str, field: str, v: str, group: str, replicates: int, seed: str = "") -> DataFrame:
    """(window, group, field, replicate, share): mean share of a pair's first label in the rows of each field, by drawn reference fields.

    references: window, label, field, v; rows: window, group, field, v; pairs: group, a, b (labels), one row a group. A replicate draws the
    fields of a label once for all windows; prototypes are the means of their means. A row gets an array of shares, one per
    replicate, clipped to 0..1, so rows are not copied; what a group's rows meet are `replicates` vectors. A replicate in which a
    window has no drawn field of a label has no share there.
    """
    signatures = mean_vectors(references, [window, label, field], v)
    drawn = draws(signatures.select(label, field).distinct(), [label], field, replicates, seed)
    p = mean_vectors(signatures.join(drawn, [label, field]), [window, label, "replicate"], v, F.col("weight"))
    side = lambda c: p.select(window, F.col(label).alias(c), "replicate", F.col(v).alias(f"_{c}"))
    wanted = rows.select(window, group).distinct().join(pairs.select(group, "a", "b"), group).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    ends = wanted.join(side("a"), [window, "a", "replicate"], "left").join(side("b"), [window, "b", "replicate"], "left")
    way = ends.withColumn("_d", vectors.minus(F.col("_a"), F.col("_b"))).withColumn("_n", F.greatest(vectors.dot(F.col("_d"), F.col("_d")), F.lit(1e-300)))
    line = F.struct("replicate", vectors.scaled(F.col("_d"), 1 / F.col("_n")).alias("u"), (vectors.dot(F.col("_b"), F.col("_d")) / F.col("_n")).alias("c"))
    lines = way.groupBy(window, group).agg(F.sort_array(F.collect_list(line)).alias("_lines"))  # one entry a replicate
    clipped = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), vectors.dot(F.col(v), x["u"]) - x["c"]))
    share = F.transform("_lines", lambda x: F.when(x["c"].isNotNull(), clipped(x)).otherwise(F.lit(float("nan"))))
    m = moments(rows.join(lines, [window, group]).select(window, group, field, share.alias("_share")), [window, group, field], "_share", gram=False)
    return m.select(window, group, field, F.posexplode(F.transform("total", lambda x: x / F.col("mass"))).alias("replicate", "share")).where(~F.isnan("share"))


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, low, median, high, replicates_used): the middle 95 % and the median of the replicates."""
    q = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"), F.count("*").alias("replicates_used"))
    return q.select(*keys, *[F.col("q")[i].alias(n) for i, n in enumerate(("low", "median", "high"))], "replicates_used")


def group_replicates(shares: DataFrame, fields: DataFrame, window: str, group: str, field: str, replicates: int, seed: str = "g") -> DataFrame:
    """(window, group, replicate, share): the mean over fields drawn in each replicate, the same for all windows, of reference_replicates' shares.

    fields: distinct (group, field). Both parts of a replicate vary, references and fields.
    """
    drawn = draws(fields.select(group, field), [group], field, replicates, seed)
    return shares.join(drawn, [group, field, "replicate"]).groupBy(window, group, "replicate").agg((F.sum(F.col("weight") * F.col("share")) / F.sum("weight")).alias("share"))


def segment_projection(v: Column, a: np.ndarray, b: np.ndarray) -> tuple[Column, Column, Column]:
    """(share of a clipped to 0..1, raw share, residual distance) on the segment from b to a."""
    d = a - b
    raw = vectors.dot(vectors.minus(v, literal(b)), literal(d)) / float(max(d @ d, 1e-300))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    at = F.zip_with(literal(b), literal(d), lambda x, y: x + share * y)
    return share, raw, vectors.distance(v, at)


def dual_evidence(a: Column, b: Column) -> Column:
    """4ab / (a + b), or 0 where both are 0."""
    return F.coalesce(F.try_divide(4 * a * b, a + b), F.lit(0.0))


def simplex_projection(v: Column, prototypes: np.ndarray) -> Column:
    """Weights on the simplex of the prototypes nearest to v: every active set in closed form, the best feasible one.

    For a set the weights are an affine function of the dot products of v with the prototypes; the inverse
    is computed once per set, so a row costs a few products.
    """
    k, _ = prototypes.shape
    dots = F.array(*[vectors.dot(v, literal(p)) for p in prototypes])
    gram = prototypes @ prototypes.T
    tried = []
    for size in range(1, k + 1):
        for own in combinations(range(k), size):
            system = np.zeros((size + 1, size + 1))
            system[:size, :size] = gram[np.ix_(own, own)]
            system[:size, size] = system[size, :size] = 1
            inverse = np.linalg.pinv(system)
            weights = [sum((float(inverse[r, c]) * dots[own[c]] for c in range(size)), F.lit(float(inverse[r, size]))) for r in range(size)]
            full = F.array(*[weights[own.index(i)] if i in own else F.lit(0.0) for i in range(k)])
            tried.append(full)

    def loss(w: Column) -> Column:
        quad = sum((float(gram[i, j]) * w[i] * w[j] for i in range(k) for j in range(k)), F.lit(0.0))
        lin = sum((w[i] * dots[i] for i in range(k)), F.lit(0.0))
        return F.when(F.array_min(w) >= -1e-9, quad - 2 * lin).otherwise(float("inf"))

    options = F.transform(F.array(*tried), lambda w: F.struct(F.round(loss(w), 12).alias("loss"), F.transform(w, lambda x: F.greatest(x, F.lit(0.0))).alias("w")))
    return F.array_min(options)["w"]


def with_simplex(df: DataFrame, v: str, prototypes: np.ndarray, least: float = 1e-9) -> DataFrame:
    """Adds weights on the simplex of the prototypes, and how well they do: the residual's length, its root mean square,
    its share of the vector's length (null for a zero vector), and the number of prototypes in use."""
    if not 2 <= len(prototypes) <= 4:
        raise ValueError("two to four prototypes")
    out = df.withColumn("weights", simplex_projection(F.col(v), prototypes))
    made = F.array(*[sum((float(p[i]) * F.col("weights")[k] for k, p in enumerate(prototypes)), F.lit(0.0)) for i in range(prototypes.shape[1])])
    out = out.withColumn("residual_norm", vectors.distance(F.col(v), made))
    length = F.sqrt(vectors.dot(F.col(v), F.col(v)))
    return out.withColumns({
        "residual_rmse": F.col("residual_norm") / float(np.sqrt(prototypes.shape[1])), "relative_residual": F.try_divide(F.col("residual_norm"), length),
        "active_count": F.size(F.filter("weights", lambda w: w > least)),
    })
