"""Queries of model evaluation (J32 to J41) and user functions (L)."""

import pandas as pd
from pyspark.sql import functions as F

from ..operators import encoding, evaluation, joins, models, nested
from . import inputs
from .inputs import PREDICTIONS, VECTORS
from .registry import query


def _replicates(keys: str, scores: str, text: str, n: int) -> str:
    """CTEs up to rep (keys, model, replicate, auroc, average_precision): blocks drawn by hash, weights, tied ranks."""
    by = f"{keys}, " if keys else ""
    own = f"PARTITION BY {keys} " if keys else ""
    using = f"({by}block)"
    return f"""u AS (SELECT {by}block, row_number() OVER ({own}ORDER BY block) - 1 AS i, count(*) OVER ({own}) AS m FROM (SELECT DISTINCT {by}block FROM predictions)),
sl AS (SELECT DISTINCT {by}m, r AS replicate, unnest(range(m)) AS s FROM u, (SELECT unnest(range({n})) AS r)),
dr AS (SELECT {by}replicate, CAST(CAST('0x' || substr(sha256({text}), 1, 16) AS UBIGINT) % m AS BIGINT) AS i FROM sl),
wt AS (SELECT {by}block, replicate, count(*) AS w FROM dr JOIN u USING ({by}i) GROUP BY ALL),
lg AS (SELECT {by}block, truth, unnest([{scores}]) AS q FROM predictions),
sc AS (SELECT {by}q.model AS model, replicate, q.score AS score, sum(w * truth) AS p, sum(w * (1 - truth)) AS n FROM lg JOIN wt USING {using} GROUP BY ALL),
cu AS (SELECT *, sum(p) OVER x AS tp, sum(n) OVER x AS fp FROM sc WINDOW x AS (PARTITION BY {by}model, replicate ORDER BY score DESC)),
rep AS (SELECT {by}model, replicate, sum(n * (tp - p / 2.0::DOUBLE)) / nullif(sum(p) * sum(n), 0) AS auroc, sum(CASE WHEN tp + fp > 0 THEN p * tp / (tp + fp) END) / nullif(sum(p), 0) AS average_precision FROM cu GROUP BY ALL)"""


_ONE = "{'model': 'score', 'score': score}"
_ENDS = "round(quantile_cont({0}, 0.025), 6) AS low, round(quantile_cont({0}, 0.975), 6) AS high, count({0}) AS replicates_used"


@query("j32_bootstrap_intervals", f"WITH {PREDICTIONS}, {_replicates('lang', _ONE, chr(39) + ':' + chr(39) + ' || lang || ' + chr(39) + ':' + chr(39) + ' || replicate || ' + chr(39) + ':' + chr(39) + ' || s', 40)} SELECT lang, {_ENDS.format('auroc')} FROM rep GROUP BY lang")
def j32(spark, sf):
    return models.bootstrap_metrics(inputs.predictions(spark, sf), "block", "truth", "score", 40, ["lang"])


_TWO = _ONE + ", {'model': 'other', 'score': round(n / 50000.0::DOUBLE, 3)}"
_J33 = f"""WITH {PREDICTIONS}, {_replicates('', _TWO, "':0:' || replicate || ':' || s", 40)},
de AS (SELECT replicate, CASE WHEN count(auroc) = 2 THEN sum(CASE WHEN model = 'score' THEN auroc ELSE -auroc END) END AS auroc, CASE WHEN count(average_precision) = 2 THEN sum(CASE WHEN model = 'score' THEN average_precision ELSE -average_precision END) END AS average_precision FROM rep GROUP BY replicate),
lo AS (SELECT 'auroc' AS metric, round(auroc, 9) AS d FROM de UNION ALL SELECT 'average_precision', round(average_precision, 9) FROM de)
SELECT metric, {_ENDS.format('d')}, count(d) >= 20 AS usable FROM lo GROUP BY metric"""


@query("j33_block_bootstrap_delta", _J33)
def j33(spark, sf):
    """AUROC and average precision of two scores on the same draws: intervals of their difference."""
    p = inputs.predictions(spark, sf).withColumn("other", F.round(F.col("n") / 50000.0, 3))
    return models.paired_deltas(p, "block", "truth", "score", "other", 40)


def _folded(df):
    """Folds of fields: two outer ones, two base or inner ones inside each."""
    f = F.col("field") % 5
    return df.withColumns({"outer": (f % 2).cast("int"), "base": (F.floor(f / 2) % 2).cast("int"), "truth": (F.col("crop") % 2).cast("int"), "pair": F.floor(F.col("crop") / 2).cast("int")})


def _axes(spark, sf):
    """Axis of each pair of neighbouring crops in each window, cross-fitted by fields."""
    rows = _folded(inputs.windowed_vectors(spark, sf)).select("pair", "w", "row_id", "field", "truth", "outer", "base", "v")
    return nested.axis_scores(rows, "pair", "w", "row_id", "field", "v", "truth", "outer", "base", 2, 2)


@query("j34_pair_axis_classifier")
def j34(spark, sf):
    return _axes(spark, sf).select("pair", "w", "row_id", "outer_fold", "role", F.round("score", 6).alias("score"))


@query("j35_detector_selection")
def j35(spark, sf):
    """Missing features are filled and flagged; the strength is chosen by average precision over inner folds."""
    v = _folded(inputs.vectors(spark, sf)).withColumn("v", F.transform("v", lambda x, i: F.when((i > 0) | (F.col("row_id") % 7 != 0), x)))
    rows = v.select("row_id", "truth", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("outer_fold"), "outer", F.col("base").alias("inner"), "v")
    rows = rows.withColumn("test", (F.col("outer") == F.col("outer_fold")).cast("int"))
    found = nested.detected(rows, [], "row_id", "v", "truth", 2, (0.01, 0.1, 1.0))
    return found.select("outer_fold", "row_id", F.round("score", 6).alias("score"), "strength", "call")


def _stages(rows, keys, width):
    """For stages 1 to 4 the arrays of the windows up to it, then their differences from one window to the next."""
    by = rows.groupBy(*keys).agg(*[F.max(F.when(F.col("w") == w, F.col("own"))).alias(f"w{w}") for w in (1, 2, 3, 4)])
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: y - x)
    made = [F.concat(*[f"w{w}" for w in range(1, s + 1)], *[minus(f"w{w}", f"w{w + 1}") for w in range(1, s)]) for s in (1, 2, 3, 4)]
    return by.select(*keys, F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), x.alias("x")) for s, x in zip((1, 2, 3, 4), made, strict=True)])).alias("s")).select(*keys, "s.stage", "s.x")


@query("j36_nested_feature_sets")
def j36(spark, sf):
    """Mean vectors, parent evidence and both, over four stages: axes, their distributions, deltas and detectors nested in outer folds."""
    from ..operators.aggregates import distribution, mean_vectors

    keys = ["field", "truth", "inner", "outer_fold", "test"]
    axes = _axes(spark, sf).withColumns({"test": (F.col("role") == "test").cast("int"), "inner": (F.floor(F.col("field") % 5 / 2) % 2).cast("int")})
    shape = distribution("score")
    names = ["mean", "std", "q10", "q25", "q50", "q75", "q90", "iqr", "balance", "low_tail", "high_tail", "entropy"]
    parent = axes.groupBy(*keys, "w").agg(*shape).select(*keys, "w", F.array(*names).alias("own"))
    means = mean_vectors(inputs.windowed_vectors(spark, sf), ["field", "w"], "v").select("field", "w", F.slice("v", 1, 16).alias("vector"))
    both = parent.join(means, ["field", "w"])
    sets = {"vector": F.col("vector"), "parent": F.col("own"), "both": F.concat("vector", "own")}
    rows = both.select(*keys, "w", F.explode(F.array(*[F.struct(F.lit(n).alias("features"), x.alias("own")) for n, x in sets.items()])).alias("s")).select(*keys, "w", "s.*")
    found = nested.detected(_stages(rows, [*keys, "features"], 4), ["features", "stage"], "field", "x", "truth", 2, (0.1, 1.0))
    m = evaluation.ranking_metrics(found, ["features", "stage"], "truth", "score")
    calls = evaluation.threshold_metrics(found, ["features", "stage"], "truth", "call")
    return m.join(calls, ["features", "stage"]).select("features", "stage", *[F.round(c, 6).alias(c) for c in ("auroc", "average_precision", "recall", "fpr")])


_AUC = f"""WITH {PREDICTIONS}, s AS (SELECT lang, score, sum(truth) AS p, sum(1 - truth) AS n FROM predictions GROUP BY ALL), c AS (SELECT *, sum(p) OVER (PARTITION BY lang ORDER BY score DESC) AS tp FROM s),
g AS (SELECT lang, sum(n * (tp - p / 2.0::DOUBLE)) / nullif(sum(p) * sum(n), 0) AS auroc FROM c GROUP BY lang)"""


@query("j37_gate_table", _AUC + " SELECT lang, CASE WHEN auroc IS NULL THEN 'NOT_TESTABLE' WHEN auroc >= 0.9 THEN 'PASS' WHEN auroc >= 0.8 THEN 'EXPLORATORY' ELSE 'FAIL' END AS gate FROM g")
def j37(spark, sf):
    m = evaluation.ranking_metrics(inputs.predictions(spark, sf), ["lang"], "truth", "score")
    return m.select("lang", evaluation.gate(F.col("auroc"), 0.8, 0.9).alias("gate"))


@query("j38_lens_evaluation")
def j38(spark, sf):
    """Seven lenses on fields: place, shape, both, early values, early values with both, all values, mean vectors."""
    from ..operators.aggregates import mean_vectors

    w = _folded(inputs.windowed_vectors(spark, sf))
    place = w.where("w = 1").groupBy("field", "truth", "outer", "base").agg(
        F.array(F.avg("x"), F.avg("y")).alias("place"), F.array(F.log(F.count("*")), (F.max("x") - F.min("x")).cast("double"), (F.max("y") - F.min("y")).cast("double")).alias("shape"))
    by = mean_vectors(w, ["field", "w"], "v").groupBy("field").agg(*[F.max(F.when(F.col("w") == i, F.col("v"))).alias(f"m{i}") for i in (1, 2, 3, 4)])
    few = lambda i: F.slice(f"m{i}", 1, 8)
    early = F.concat(few(1), few(2), F.zip_with(few(1), few(2), lambda a, b: b - a))
    lenses = {"location_only": F.col("place"), "geometry_only": F.col("shape"), "nuisance_only": F.concat("place", "shape"), "raw_safe": early,
              "raw_safe_plus_context": F.concat(early, "place", "shape"), "raw_full": F.concat(early, few(3), few(4)), "vectors": F.col("m2")}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("lens"), x.alias("x")) for n, x in lenses.items()])).alias("l")
    rows = place.join(by, "field").select("field", "truth", "outer", "base", each).select("field", "truth", "outer", "base", "l.*")
    found = nested.lens_decisions(rows, "lens", "field", "x", "truth", "outer", "base", 2)
    m = evaluation.ranking_metrics(found, ["lens"], "truth", "score")
    calls = evaluation.threshold_metrics(found, ["lens"], "truth", "decision")
    return m.join(calls, "lens").select("lens", *[F.round(c, 6).alias(c) for c in ("auroc", "average_precision", "recall", "fpr")])


@query("j39_scorecard", _AUC + " SELECT 'auroc' AS metric, lang, round(auroc, 6) AS value FROM g UNION ALL SELECT 'rows', lang, CAST(count(*) AS DOUBLE) FROM predictions GROUP BY lang")
def j39(spark, sf):
    p = inputs.predictions(spark, sf)
    a = evaluation.ranking_metrics(p, ["lang"], "truth", "score").select(F.lit("auroc").alias("metric"), "lang", F.round("auroc", 6).alias("value"))
    return a.unionByName(p.groupBy("lang").agg(F.count("*").cast("double").alias("value")).select(F.lit("rows").alias("metric"), "lang", "value"))


def _classified(spark, sf, hidden, iterations=(30,)):
    v = inputs.vectors(spark, sf).withColumn("fold", (F.col("field") % 5).cast("int"))
    p = models.vector_classifier(v.where("fold > 1"), v.where("fold = 0"), "v", "crop", 10, hidden, iterations, v.where("fold = 1"))
    return evaluation.overall_metrics(evaluation.class_metrics(evaluation.confusion(p, "crop", "predicted"), "crop", "predicted"))


@query("j40_multinomial_models")
def j40(spark, sf):
    """Models of three classes of crops over growing numbers of windows, by field means and by pixels on the same folds."""
    from ..operators.aggregates import mean_vectors

    w = inputs.windowed_vectors(spark, sf).withColumns({"group": (F.col("crop") % 3).cast("int"), "fold": (F.col("field") % 5).cast("int")})
    stages = w.withColumn("stage", F.explode(F.array(*[F.lit(s) for s in (1, 2, 4)]))).where("w <= stage")
    pixels = mean_vectors(stages, ["row_id", "field", "group", "fold", "stage"], "v")
    fields = mean_vectors(pixels, ["field", "group", "fold", "stage"], "v")
    one = lambda d, unit, key: d.select(F.lit(unit).alias("unit"), "stage", F.col(key).cast("long").alias("key"), "group", "fold", "v")
    called = nested.staged_classes(one(fields, "field", "field").unionByName(one(pixels, "pixel", "row_id")), ["unit", "stage"], "key", "v", "group", "fold", 5, 3)
    keys = ["unit", "stage"]
    m = evaluation.overall_metrics(evaluation.class_metrics(evaluation.confusion(called, "group", "predicted", keys=keys), "group", "predicted", keys), keys)
    return m.select(*keys, *[F.round(c, 6).alias(c) for c in m.columns if c not in keys])


@query("j41_feed_forward_classifier")
def j41(spark, sf):
    m = _classified(spark, sf, 16, (10, 30, 60))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("l1_encoder_function", f"WITH {inputs.OBSERVATIONS} SELECT sample_id, round(avg(value), 6) AS m, 1.0::DOUBLE AS one FROM observations WHERE epoch_day >= 19723 AND epoch_day < 19740 GROUP BY sample_id")
def l1(spark, sf):
    """A user's encoder in place of the default one."""
    import numpy as np

    def mine(bands, days):
        return np.array([bands[:, 0].mean(), 1.0])

    w = spark.createDataFrame([(1, 19723, 19740)], "w int, start int, end int")
    rows = encoding.windows_of(inputs.observations(spark, sf), w, "sample_id", "epoch_day", "bands", "obs_id")
    e = encoding.encoded(rows, "sample_id", mine).where("outcome = 'complete'")
    return e.select("sample_id", F.round(F.get("vector", F.lit(0)), 6).alias("m"), F.get("vector", F.lit(1)).alias("one"))


@query("l3_sampler_table", f"WITH {inputs.ITEMS}, {inputs.CANDIDATES} SELECT item_id, candidate_id, CAST((quantity * 7 + c_custkey) % 100 AS BIGINT) AS value FROM candidates c JOIN items i ON i.tile = c_custkey % 50 AND longitude BETWEEN west AND east AND latitude BETWEEN south AND north")
def l3(spark, sf):
    """Samples are a table: a value per item and point, here from both keys."""
    c = inputs.candidates(spark, sf).withColumn("tile", F.col("c_custkey") % 50)
    hit = joins.point_in_boxes(c, inputs.items(spark, sf), ["tile"], "longitude", "latitude")
    return hit.select("item_id", "candidate_id", ((F.col("quantity") * 7 + F.col("c_custkey")) % 100).alias("value"))


@query("l4_worker_function", f"WITH {inputs.TASKS} SELECT task_id, attempts * 10 + tile % 10 AS artifact FROM tasks")
def l4(spark, sf):
    """A plain function over batches; Spark's task retry is the retry."""

    def work(frames):
        for frame in frames:
            yield pd.DataFrame({"task_id": frame["task_id"], "artifact": frame["attempts"] * 10 + frame["tile"] % 10})

    return inputs.tasks(spark, sf).select("task_id", "attempts", "tile").mapInPandas(work, "task_id long, artifact long")


@query("l2_result_table", f"WITH {inputs.OBSERVATIONS}, w(w, a, z) AS (VALUES (1, 19723, 19730), (2, 19723, 19740)), s AS (SELECT DISTINCT sample_id FROM observations), e AS (SELECT s.sample_id, w.w, count(obs_id) AS n, round(avg(value) + 1e-9, 6) AS m1 FROM s CROSS JOIN w LEFT JOIN observations o ON o.sample_id = s.sample_id AND epoch_day >= a AND epoch_day < z GROUP BY ALL) SELECT sample_id, CASE WHEN n > 0 THEN 'complete' ELSE 'empty_window' END AS outcome, m1, CAST(w AS INTEGER) AS w, sample_id % 2 = 0 AS hit FROM e WHERE w = 1")
def l2(spark, sf):
    """put stores the results of some samples as a table keyed by content; get finds them there, and nothing else."""
    from .q_sources import folder

    w = spark.createDataFrame([(1, 19723, 19730), (2, 19723, 19740)], "w int, start int, end int")
    rows = encoding.windows_of(inputs.observations(spark, sf), w, "sample_id", "epoch_day", "bands", "obs_id")
    path = folder(spark)
    encoding.put_results(encoding.encoded(rows.where("sample_id % 2 = 0"), "sample_id"), path)
    encoding.put_results(encoding.encoded(rows.where("sample_id % 4 = 0"), "sample_id"), path)  # put twice, kept once
    got = encoding.incremental(rows.where("w = 1"), encoding.get_results(spark, path), "sample_id")
    return got.select("sample_id", "outcome", F.round(F.get("vector", F.lit(0)) + 1e-9, 6).alias("m1"), "w", F.col("reused").alias("hit"))
