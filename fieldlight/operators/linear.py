"""Small dense models fitted from distributed sufficient statistics.

Only sums leave the executors: per label and fold a count, a vector sum and a Gram matrix, whose
size is set by the vector length. Eigenvectors and inverses of those are taken on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors

MOMENT_DDL = "mass double, total array<double>, gram array<double>"


#: Groups of a task whose partial sums are held at once.
HELD_GROUPS = 4096
#: Partial arrays meet in so many parts first, so that no task gets one from every other task.
MERGE_PARTS = 256


def summed(partial: DataFrame, keys: list[str], sums: list[str], arrays: list[str]) -> DataFrame:
    """Partial rows added by keys: numbers, and arrays of one length element by element."""
    zero = lambda c: F.transform(F.first(c), lambda x: F.lit(0.0))
    add = lambda c: F.aggregate(F.collect_list(c), zero(c), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias(c)
    return partial.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *map(add, arrays))


def added(partial: DataFrame, keys: list[str], sums: list[str], arrays: list[str]) -> DataFrame:
    """As summed, in two levels."""
    parts = summed(partial.withColumn("_part", F.spark_partition_id() % MERGE_PARTS), [*keys, "_part"], sums, arrays)
    return summed(parts, keys, sums, arrays)


def moments(df: DataFrame, keys: list[str], v: str, weight: Column | None = None, gram: bool = True) -> DataFrame:
    """(keys, mass, total, gram): weighted count, sum and flattened Gram matrix of each group.

    Partial sums are made in every partition and then added, so a hot group is spread over all.
    """
    w = F.lit(1.0) if weight is None else weight
    rows = df.select(*keys, w.cast("double").alias("_w"), F.col(v).alias("_v"))
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields), MOMENT_DDL])

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = {}

        def out() -> pd.DataFrame:
            rows = [(*k, float(s[0]), s[1].tolist(), s[2].ravel().tolist()) for k, s in sums.items()]
            sums.clear()
            return pd.DataFrame(rows, columns=[*keys, "mass", "total", "gram"])

        for frame in frames:
            for key, own in frame.groupby(keys, dropna=False, sort=False) if keys else [((), frame)]:
                x, w_ = np.stack(own["_v"].to_numpy()).astype(np.float64), own["_w"].to_numpy()
                add = [w_.sum(), w_ @ x, (x.T * w_) @ x if gram else np.zeros(0)]
                old = sums.get(key)
                sums[key] = add if old is None else [a + b for a, b in zip(old, add, strict=True)]
            if len(sums) >= HELD_GROUPS:
                yield out()
        yield out()

    return added(rows.mapInPandas(part, ddl), keys, ["mass"], ["total", "gram"])


def principal_axes(df: DataFrame, v: str, k: int = 3, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes, explained share): the sign of an axis makes its largest loading positive."""
    m = moments(df, [], v, weight).head()
    n, s = m.mass, np.array(m.total)
    mean = s / n
    cov = np.array(m.gram).reshape(len(s), len(s)) / n - np.outer(mean, mean)
    values, vecs = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    axes = vecs[:, order].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    return mean, axes, values[order] / max(values.sum(), 1e-300)


def scores_on(df: DataFrame, v: str, mean: np.ndarray, axes: np.ndarray, name: str = "pc") -> DataFrame:
    """Coordinates on the axes as an array, and the residual's length."""
    centred = vectors.minus(F.col(v), literal(mean))
    pcs = F.array(*[vectors.dot(F.col("_c"), literal(a)) for a in axes])
    out = df.withColumn("_c", centred).withColumn(name, pcs)
    rest = F.greatest(F.lit(0.0), vectors.dot(F.col("_c"), F.col("_c")) - vectors.dot(F.col(name), F.col(name)))
    return out.withColumn("residual", F.sqrt(rest)).drop("_c")


def literal(x: np.ndarray) -> Column:
    return F.array(*[F.lit(float(a)) for a in x])


class Density:
    """Gaussian per label with one shrunken covariance; whitener @ x has unit covariance inside labels."""

    def __init__(self, labels: list, centres: np.ndarray, whitener: np.ndarray, shrinkage: float, temperature: float = 1.0):
        self.labels, self.centres, self.whitener, self.shrinkage, self.temperature = labels, centres, whitener, shrinkage, temperature

    def log_scores(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.whitener.T
        c = self.centres @ self.whitener.T
        d = (z * z).sum(1)[:, None] - 2 * z @ c.T + (c * c).sum(1)[None, :]
        return -0.5 * d / self.temperature


def fit_density(stats: list, shrinkage: float, most_components: int | None = None, equal_labels: bool = False) -> Density:
    """From rows of moments per label, each label counting by its mass or (equal_labels) the same. The pooled
    within-label covariance is shrunk to its mean variance; axes whose variance is next to nothing beside that mean
    are left out."""
    if not 0 < shrinkage <= 1:
        raise ValueError("shrinkage lies in (0, 1]")
    stats = sorted(stats, key=lambda r: r[0])
    w = np.array([r[1] for r in stats])
    centres = np.array([r[2] for r in stats]) / w[:, None]
    d = centres.shape[1]
    each = np.array([np.array(r[3]).reshape(d, d) / r[1] - np.outer(c, c) for r, c in zip(stats, centres, strict=True)])
    cov = np.average(each, axis=0, weights=None if equal_labels else w)
    usual = np.trace(cov) / d
    values, vecs = np.linalg.eigh((1 - shrinkage) * cov + shrinkage * usual * np.eye(d))
    kept = np.flatnonzero(values > max(usual * 1e-8, 1e-12))[::-1][:most_components]
    if not len(kept):
        raise ValueError("the reference has no variation")
    return Density([r[0] for r in stats], centres, (vecs[:, kept] / np.sqrt(values[kept])).T, shrinkage)


def with_field_weight(df: DataFrame, field: str, name: str = "_field_weight") -> DataFrame:
    """Adds one over the rows of the row's field: fields of a label then count the same."""
    return df.join(df.groupBy(field).agg((1.0 / F.count("*")).alias(name)), field)


def label_stats(df: DataFrame, label: str, v: str, weight: Column | None = None, fold: str | None = None) -> list[tuple]:
    """Rows of (label, [fold,] w, s, g); as many as labels times folds."""
    keys = [label] if fold is None else [label, fold]
    return [tuple(r) for r in moments(df, keys, v, weight).collect()]


def without_fold(stats: list[tuple], fold) -> list[tuple]:
    """Statistics of all folds but one: totals less the held-out sums."""
    out: dict = {}
    for label, own, w, s, g in stats:
        if own != fold:
            old = out.get(label)
            add = (w, np.array(s), np.array(g))
            out[label] = add if old is None else tuple(a + b for a, b in zip(old, add, strict=True))
    return [(k, *v) for k, v in out.items()]


def with_log_scores(df: DataFrame, v: str, models, column: str = "log_scores", fold: str | None = None) -> DataFrame:
    """Adds log scores per label; models is one Density, or one per fold value."""
    return with_all_scores(df, v, {column: models}, fold)


def with_all_scores(df: DataFrame, v: str, columns: dict, fold: str | None = None) -> DataFrame:
    """Adds a column of log scores for each name in columns, all in one pass over the vectors."""
    shared = df.sparkSession.sparkContext.broadcast(columns)  # a few matrices of the vector's length

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame[v].to_numpy()).astype(np.float64)
            folds = [(None, np.arange(len(x)))] if fold is None else [(f, np.flatnonzero(frame[fold] == f)) for f in frame[fold].unique()]
            made = {}
            for name, models in shared.value.items():
                got: list = [None] * len(x)
                for f, rows in folds:
                    for i, row in zip(rows.tolist(), (models if fold is None else models[f]).log_scores(x[rows]), strict=True):
                        got[i] = row
                made[name] = got
            yield frame.assign(**made)

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{c}` array<double>" for c in columns)])
    return df.mapInPandas(score, ddl)


#: Shrinkages that a validated fit chooses from.
SHRINKAGES = (0.10, 0.25, 0.50, 0.75)


def validated_density(df: DataFrame, label: str, field: str, v: str, fold: str, shrinkages: tuple[float, ...] = SHRINKAGES) -> tuple[Density, DataFrame, list[tuple[float, float]]]:
    """(model, rows with held-out log_scores at its temperature, losses): shrinkage and temperature chosen on held-out fields.

    Folds hold whole fields. Labels count the same, fields of a label, and rows of a field, in every fit and
    every loss. One pass makes the sums of all folds, one the scores of all shrinkages.
    """
    df = with_field_weight(df, field)
    stats = label_stats(df, label, v, F.col("_field_weight"), fold)
    folds = sorted({r[1] for r in stats})
    columns = {f"_s{i}": {f: fit_density(without_fold(stats, f), s, equal_labels=True) for f in folds} for i, s in enumerate(shrinkages)}
    labels = sorted({r[0] for r in stats})
    place = F.array_position(F.array(*map(F.lit, labels)), F.col(label)).cast("int")
    scored = with_all_scores(df, v, columns, fold).withColumn("_place", place)
    fields = {k: len({r[1] for r in stats if r[0] == k}) for k in labels}
    if min(fields.values()) < 2:
        raise ValueError("a label lies in one fold only")
    mass = {k: sum(r[2] for r in stats if r[0] == k) for k in labels}  # fields of each label
    per_label = F.element_at(F.array(*[F.lit(1.0 / (len(labels) * mass[k])) for k in labels]), F.col("_place"))
    scored = scored.withColumn("_weight", F.col("_field_weight") * per_label)
    sums = scored.agg(*[F.sum(F.col("_weight") * log_loss(F.col(c), F.col("_place"), F.lit(1.0))).alias(c) for c in columns]).head()
    losses = [(s, sums[i]) for i, s in enumerate(shrinkages)]
    best = min(range(len(shrinkages)), key=lambda i: (losses[i][1], i))
    chosen = scored.withColumn("log_scores", F.col(f"_s{best}"))
    t = calibrated_temperature(chosen, "log_scores", "_place", "_weight")
    whole = {}
    for k, _, w, s, g in stats:
        old = whole.get(k, (0.0, 0.0, 0.0))
        whole[k] = (old[0] + w, old[1] + np.array(s), old[2] + np.array(g))
    model = fit_density([(k, *x) for k, x in whole.items()], shrinkages[best], equal_labels=True)
    model.temperature = t
    out = chosen.withColumn("log_scores", F.transform("log_scores", lambda x: x / t)).withColumn("place", F.col("_place")).withColumn("weight", F.col("_weight"))
    return model, out.drop(*columns, "_place", "_weight", "_field_weight"), losses


def posteriors(log_scores: Column) -> Column:
    top = F.array_max(log_scores)
    e = F.transform(log_scores, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def log_loss(log_scores: Column, place: Column, temperature: Column) -> Column:
    """-log of the softmax at a place (from 1), at a temperature."""
    top = F.array_max(log_scores)
    total = F.aggregate(log_scores, F.lit(0.0), lambda s, x: s + F.exp((x - top) / temperature))
    return F.log(total) - (F.element_at(log_scores, place) - top) / temperature


def calibrated_temperature(df: DataFrame, log_scores: str, place: str, weight: str, low: float = 0.25, high: float = 8.0, points: int = 65) -> float:
    """Temperature of least weighted log loss on a log-spaced grid: one sum per grid point in one pass."""
    grid = np.exp(np.linspace(np.log(low), np.log(high), points)).tolist()
    sums = [F.sum(F.col(weight) * log_loss(F.col(log_scores), F.col(place), F.lit(t))).alias(f"t{i}") for i, t in enumerate(grid)]
    row = df.agg(*sums).head()
    return grid[min(range(points), key=lambda i: (row[i], i))]


def nearest_centroid(df: DataFrame, v: str, centroids: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Adds predicted label and distance, by the centroid table (label, c), joined on by; ties to the lesser label."""
    by = by or []
    table = centroids.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), "c"))).alias("_t"))  # one entry per label
    joined = df.join(table, by) if by else df.crossJoin(table)  # one row
    d = F.transform("_t", lambda t: F.struct(F.round(vectors.distance(F.col(v), t["c"]), 9).alias("d"), t["l"].alias("l")))
    return joined.withColumn("_b", F.array_min(d)).withColumn("predicted", F.col("_b.l")).withColumn("distance", F.col("_b.d")).drop("_t", "_b")


def balanced_centroids(df: DataFrame, v: str, label: str, field: str, fold: str, folds: int, floor: float = 1e-8) -> DataFrame:
    """(fold, mean, scale, centroids): for each fold, from the rows of the others, with rows equal in a field, fields equal in a label and labels equal.

    Rows are read once, for the moments of each field; every fold then takes the field moments of the others. centroids: array of (label, standardised centroid).
    """
    from .aggregates import mean_vectors

    both = df.withColumn("_b", F.concat(v, F.transform(v, lambda x: x * x)))
    fields = mean_vectors(both, [label, field, fold], "_b")
    each = fields.withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where(F.col("_f") != F.col(fold))
    labels = mean_vectors(each.select("_f", label, "_b"), ["_f", label], "_b")
    whole = mean_vectors(labels, ["_f"], "_b")
    half = (F.size("_b") / 2).cast("int")
    first, second = F.slice("_b", F.lit(1), half), F.slice("_b", half + 1, half)
    deviation = F.zip_with("_q", "mean", lambda q, m: F.sqrt(F.greatest(q - m * m, F.lit(0.0))))
    whole = whole.select("_f", first.alias("mean"), second.alias("_q")).withColumn("scale", F.transform(deviation, lambda s: F.when(s < floor, 1.0).otherwise(s))).drop("_q")
    own = labels.select("_f", F.col(label).alias("l"), first.alias("_c")).join(whole, "_f")
    own = own.withColumn("c", F.transform("_c", lambda x, i: (x - F.get("mean", i)) / F.get("scale", i)))
    table = own.groupBy("_f").agg(F.array_sort(F.collect_list(F.struct("l", "c"))).alias("centroids"))  # one entry per label
    return table.join(whole, "_f").withColumnRenamed("_f", fold)


def centroid_distances(df: DataFrame, v: str, table: DataFrame, fold: str) -> DataFrame:
    """Adds distances: array of (l, d), the squared distance of the standardised row to each centroid of its fold's table."""
    joined = df.join(table, fold).withColumn("_z", F.transform(v, lambda x, i: (x - F.get("mean", i)) / F.get("scale", i)))
    square = lambda c: F.aggregate(F.zip_with("_z", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return joined.withColumn("distances", F.transform("centroids", lambda t: F.struct(t["l"].alias("l"), square(t["c"]).alias("d")))).drop("_z", "centroids", "mean", "scale")


def field_decisions(rows: DataFrame, field: str, keep: list[str]) -> DataFrame:
    """(field, keep, predicted, distance): the label with the least mean distance over a field's rows, the lesser of equals."""
    each = rows.select(field, *keep, F.explode("distances").alias("e")).groupBy(field, *keep, "e.l").agg(F.round(F.avg("e.d"), 9).alias("d"))
    return each.groupBy(field, *keep).agg(F.min(F.struct("d", "l")).alias("b")).select(field, *keep, F.col("b.l").alias("predicted"), F.col("b.d").alias("distance"))


HEALTH_DDL = "cosine_distance double, relational double, cross_correlation double, variance_floor double, covariance_penalty double"


def embedding_health(df: DataFrame, keys: list[str], first: str, second: str, weight: Column | None = None, target: float = 1.0, redundancy: float = 5e-3) -> DataFrame:
    """(keys, HEALTH_DDL) of two vector sets of the same rows, from one matrix of moments a group.

    Weighted mean cosine distance; weighted mean squared difference of the two sets' matrices of cosines over
    all pairs of rows, from the sets' Gram matrices, so that no pair is made; cross-correlation of standardised
    dimensions (its diagonal to one, redundancy times the rest to zero); floor of the first set's deviations;
    its covariances off the diagonal.
    """
    w = F.lit(1.0) if weight is None else F.greatest(weight.cast("double"), F.lit(0.0))
    unit = lambda c: F.transform(c, lambda x: x / F.sqrt(vectors.dot(F.col(c), F.col(c))))
    rows = df.select(*keys, w.alias("_w"), F.sqrt(w).alias("_root"), F.concat(first, second).alias("_raw"), F.concat(unit(first), unit(second)).alias("_unit"))
    raw = moments(rows, keys, "_raw").select(*keys, "mass", "total", "gram")
    units = moments(rows, keys, "_unit", F.col("_root")).select(*keys, F.col("gram").alias("unit"))
    cos = rows.groupBy(*keys).agg((F.sum(F.col("_w") * F.aggregate(F.slice("_unit", 1, (F.size("_unit") / 2).cast("int")), F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("s")), lambda a, x: F.struct((a["i"] + 1).alias("i"), (a["s"] + x * F.get("_unit", a["i"] + (F.size("_unit") / 2).cast("int"))).alias("s")), lambda a: a["s"])) / F.sum("_w")).alias("cosine"))
    both = raw.join(units, keys).join(cos, keys) if keys else raw.crossJoin(units).crossJoin(cos)  # one row a group

    def terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                n, d = r.mass, len(r.total) // 2
                mean = np.array(r.total) / n
                cov = np.array(r.gram).reshape(2 * d, 2 * d) / n - np.outer(mean, mean)
                g = np.array(r.unit).reshape(2 * d, 2 * d)
                sd = np.maximum(np.sqrt(np.maximum(np.diag(cov), 0)), 1e-4)
                cross = cov[:d, d:] / np.outer(sd[:d], sd[d:])
                diagonal, own = np.diag(cross), cov[:d, :d] * n / max(n - 1, 1)
                relational = ((g[:d, :d] ** 2).sum() - 2 * (g[:d, d:] ** 2).sum() + (g[d:, d:] ** 2).sum()) / n**2
                out.append((
                    1 - r.cosine, relational, ((diagonal - 1) ** 2).sum() + redundancy * ((cross**2).sum() - (diagonal**2).sum()),
                    np.maximum(0, target - np.sqrt(np.maximum(np.diag(cov)[:d], 0) + 1e-4)).mean(), ((own**2).sum() - (np.diag(own) ** 2).sum()) / d,
                ))
            yield pd.concat([frame[keys].reset_index(drop=True), pd.DataFrame(out, columns=[x.split()[0] for x in HEALTH_DDL.split(", ")])], axis=1)

    return both.mapInPandas(terms, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields), HEALTH_DDL]))
