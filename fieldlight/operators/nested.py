"""Nested evaluations over grouped fits: parent axes, detectors with an inner choice, lenses with a calibrated operating point, classes over stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import evaluation, logistic, windows
from .aggregates import stated_quantiles


def _exploded(df: DataFrame, parts: list[tuple[str, str]]) -> DataFrame:
    """One row per fit that scored a row; the parts of its name as columns (name, type) and p, the probabilities."""
    one = df.withColumn("_s", F.explode("scores")).drop("scores")
    name = F.split("_s.fit", ":")
    return one.select(*[c for c in one.columns if c != "_s"], *[name[i].cast(t).alias(c) for i, (c, t) in enumerate(parts)], F.col("_s.p").alias("p"))


def axis_scores(rows: DataFrame, pair: str, window: str, key: str, field: str, v: str, truth: str, outer: str, base: str, outers: int, bases: int, strength: float = 1.0) -> DataFrame:
    """(pair, window, key, field, truth, outer_fold, role, score): one axis per pair, window, outer fold and base fold.

    Fields weigh the same inside a class and classes the same. Training rows of an outer fold are scored by the axis that
    left their base fold out (role 'train'); rows of the outer fold by all of its axes, averaged (role 'test').
    """
    folds = [(o, b) for o in range(outers) for b in range(bases)]
    name = lambda o, b: logistic.named(F.col(pair), F.col(window), o, b)
    seen = rows.groupBy(pair, window, field, truth, outer, base).agg(F.count("*").alias("_n"))
    fits = seen.withColumn("_f", F.explode(F.array_compact(F.array(*[F.when((F.col(outer) != o) & (F.col(base) != b), name(o, b)) for o, b in folds]))))
    of_class, of_fit = W.partitionBy("_f", truth), W.partitionBy("_f")
    raw = 1 / (F.count("*").over(of_class) * F.col("_n"))
    fits = fits.withColumn("_w", raw * F.sum("_n").over(of_fit) / F.size(F.collect_set(truth).over(of_fit)))
    fits = fits.groupBy(pair, window, field).agg(F.collect_list(F.struct(F.col("_f").alias("fit"), F.col("_w").alias("weight"))).alias("fits"))
    rows = rows.join(fits, [pair, window, field], "left")
    models = logistic.fitted(rows, v, truth, strength=strength)
    by = logistic.naming(*[((F.col(outer) == o) | (F.col(base) == b), name(o, b)) for o, b in folds])
    got = _exploded(logistic.scored(rows.drop("fits"), v, models, by), [("_pair", "string"), ("_window", "string"), ("outer_fold", "int"), ("_b", "int")])
    role = F.when(F.col(outer) == F.col("outer_fold"), "test").otherwise("train")
    return got.groupBy(pair, window, key, field, truth, "outer_fold", role.alias("role")).agg(F.avg(F.col("p")[1]).alias("score"))


def detected(rows: DataFrame, keys: list[str], key: str, x: str, truth: str, inners: int, strengths: tuple[float, ...], most_fpr: float = 0.1) -> DataFrame:
    """(keys, key, truth, outer_fold, score, strength, threshold, call) of the test rows.

    rows have outer_fold, test (0 or 1) and inner (a fold of the training rows). For each of keys and outer fold the strength with the
    best average precision over the inner folds is taken (the smaller of equals), its operating point from the inner
    scores, and a detector of all training rows scores the test rows. All fits advance together.
    """
    each = [(i, c) for i in (*range(inners), "all") for c in strengths]
    name = lambda i, c: logistic.named(*[F.col(k) for k in keys], F.col("outer_fold"), i, c)
    train, test = F.col("test") == 0, F.col("test") == 1
    held = lambda i: F.lit(False) if i == "all" else F.col("inner") == i
    models = logistic.fitted(rows.withColumn("fits", logistic.training(*[(train & ~held(i), name(i, c)) for i, c in each])), x, truth, strength=lambda f: float(f.rsplit(":", 1)[1]), balanced=True)
    by = logistic.naming(*[((train & held(i)) if i != "all" else test, name(i, c)) for i, c in each])
    parts = [*[(f"_{k}", "string") for k in keys], ("_o", "int"), ("_i", "string"), ("strength", "double")]
    got = _exploded(logistic.scored(rows.select(*keys, key, truth, "outer_fold", "test", "inner", x), x, models, by), parts)
    got = got.select(*keys, key, truth, "outer_fold", "test", "strength", F.round(F.col("p")[1], 9).alias("score"))
    inner, group = got.where("test = 0"), [*keys, "outer_fold"]
    m = evaluation.ranking_metrics(inner, [*group, "strength"], truth, "score")
    best = m.groupBy(*group).agg(F.max(F.struct(F.round("average_precision", 9).alias("ap"), (-F.col("strength")).alias("c"))).alias("b")).select(*group, (-F.col("b.c")).alias("strength"))
    point = windows.operating_point(inner.join(best, [*group, "strength"]), truth, "score", most_fpr, group).select(*group, "threshold")
    out = got.where("test = 1").join(best, [*group, "strength"]).join(point, group, "left")
    return out.select(*group, key, truth, "score", "strength", "threshold", (F.col("score") >= F.coalesce("threshold", F.lit(float("inf")))).cast("int").alias("call"))


def lens_decisions(rows: DataFrame, lens: str, key: str, x: str, truth: str, outer: str, inner: str, outers: int, target: float = 0.1, strength: float = 1.0) -> DataFrame:
    """(lens, outer_fold, key, truth, score, operating_score, threshold, decision) of every row in its outer fold.

    The score is that of a model of the other outer folds. The operating score is that of a second model, without the rows of inner
    fold 0, whose negatives give the threshold: the higher (1 - target) quantile, passed strictly where reaching it is too common.
    """
    fits, by = [], []
    name = lambda o, kind: logistic.named(F.col(lens), o, kind)
    for o in range(outers):
        out, own = F.col(outer) != o, F.col(outer) == o
        fits += [(out, name(o, "primary")), (out & (F.col(inner) != 0), name(o, "operating"))]
        by += [(own, name(o, "primary")), (own | (F.col(inner) == 0), name(o, "operating"))]
    models = logistic.fitted(rows.withColumn("fits", logistic.training(*fits)), x, truth, strength=strength, balanced=True)
    got = _exploded(logistic.scored(rows, x, models, logistic.naming(*by)), [("_l", "string"), ("outer_fold", "int"), ("kind", "string")])
    got = got.select(lens, key, truth, "outer_fold", "kind", (F.col(outer) == F.col("outer_fold")).alias("_own"), F.round(F.col("p")[1], 9).alias("score"))
    group = [lens, "outer_fold"]
    calm = got.where((F.col("kind") == "operating") & ~F.col("_own") & (F.col(truth) == 0))
    at = stated_quantiles(calm, group, "score", 1 - target, ["higher"]).select(*group, F.col("higher").alias("threshold"))
    strict = calm.join(at, group).groupBy(*group, "threshold").agg((F.avg((F.col("score") >= F.col("threshold")).cast("double")) > target).alias("_strict"))
    own = got.where("_own").groupBy(*group, key, truth).agg(*[F.max(F.when(F.col("kind") == k, F.col("score"))).alias(n) for k, n in (("primary", "score"), ("operating", "operating_score"))])
    s, t = F.col("operating_score"), F.col("threshold")
    return own.join(strict, group, "left").withColumn("decision", F.when(F.col("_strict"), s > t).otherwise(s >= t).cast("int")).drop("_strict")


def staged_classes(rows: DataFrame, keys: list[str], key: str, x: str, label: str, fold: str, folds: int, classes: int, strength: float = 1.0) -> DataFrame:
    """(keys, key, label, predicted): every row called by the model of the other folds; classes from 0, ties to the smaller one."""
    name = lambda f: logistic.named(*[F.col(k) for k in keys], f)
    models = logistic.fitted(rows.withColumn("fits", logistic.training(*[(F.col(fold) != f, name(f)) for f in range(folds)])), x, label, strength=strength, classes=classes, balanced=True)
    got = logistic.scored(rows, x, models, logistic.naming(*[(F.col(fold) == f, name(f)) for f in range(folds)]))
    p = F.transform(F.col("scores")[0]["p"], lambda a: F.round(a, 9))
    return got.where(F.size("scores") > 0).select(*keys, key, label, (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("predicted"))
