"""Queries of aggregations (F), analytic windows (G), top-k (H) and set operations (I)."""

from pyspark.sql import functions as F

from ..functions import hashing, vectors
from ..operators import aggregates as a
from ..operators import cohort, evaluation, joins, mosaic, windows
from . import inputs
from .inputs import CANDIDATES, FIELDS, ITEMS, MEMBERSHIPS, OBSERVATIONS, PREDICTIONS, TASKS, VECTORS, WINDOWED
from .registry import query

#: F3 and F4: rounds of shares of 20 a country, at least 3 a stratum, to the power 0.5.
ALLOCATION = """strata AS (SELECT country, stratum, count(*) AS n FROM candidates GROUP BY ALL),
rounds(i, country, stratum, n, target) AS (SELECT 0, country, stratum, n, least(n, 3) FROM strata UNION ALL
 SELECT i + 1, country, stratum, n, target + CASE WHEN n > target AND sum(whole) OVER (PARTITION BY country) = 0 AND k <= left_ THEN 1 ELSE whole END FROM (
  SELECT *, row_number() OVER (PARTITION BY country ORDER BY n > target DESC, exact - floor(exact) DESC, share DESC, stratum DESC) AS k, least(n - target, CAST(floor(exact) AS BIGINT)) AS whole FROM (
   SELECT *, left_ * share AS exact FROM (
    SELECT *, 20 - sum(target) OVER (PARTITION BY country) AS left_, sqrt(CAST(n - target AS DOUBLE)) / nullif(sum(sqrt(CAST(n - target AS DOUBLE))) OVER (PARTITION BY country), 0) AS share FROM rounds))) WHERE left_ > 0),
allocation AS (SELECT country, stratum, any_value(n) AS n, CAST(arg_max(target, i) AS BIGINT) AS target FROM rounds GROUP BY ALL)"""


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("f1_work_tiles", f"WITH {CANDIDATES} SELECT country, spatial_block, min(longitude) - 0.5 AS west, min(latitude) - 0.5 AS south, max(longitude) + 0.5 AS east, max(latitude) + 0.5 AS north, count(*) AS sample_count FROM candidates GROUP BY ALL")
def f1(spark, sf):
    return a.work_tiles(inputs.candidates(spark, sf), ["country", "spatial_block"], 0.5)


@query("f2_stratum_counts", f"WITH {CANDIDATES} SELECT country, stratum, count(*) AS n, count(*) FILTER (latitude < -60) AS excluded_south, count(*) FILTER (latitude >= -60 AND longitude > 150) AS excluded_east FROM candidates GROUP BY ALL")
def f2(spark, sf):
    south = F.col("latitude") < -60
    return inputs.candidates(spark, sf).groupBy("country", "stratum").agg(F.count("*").alias("n"), F.count_if(south).alias("excluded_south"), F.count_if(~south & (F.col("longitude") > 150)).alias("excluded_east"))


@query("f3_strata_budget", f"WITH RECURSIVE {CANDIDATES}, {ALLOCATION} SELECT country, stratum, n, target, target / n AS inclusion_probability FROM allocation")
def f3(spark, sf):
    return a.stratum_targets(inputs.candidates(spark, sf), ["country"], ["stratum"], 20, 3, 0.5)


@query("f4_inclusion_probability", f"WITH RECURSIVE {CANDIDATES}, {ALLOCATION} SELECT candidate_id, round(target / n, 6) AS total FROM candidates JOIN allocation USING (country, stratum)")
def f4(spark, sf):
    c = inputs.candidates(spark, sf)
    t = a.stratum_targets(c, ["country"], ["stratum"], 20, 3, 0.5)
    return c.join(t, ["country", "stratum"]).select("candidate_id", F.round("inclusion_probability", 6).alias("total"))


@query("f5_pixel_overlap", f"WITH {MEMBERSHIPS} SELECT pixel, count(DISTINCT field_uid) AS overlap_field_count, count(DISTINCT label) > 1 AS label_conflict FROM memberships GROUP BY pixel")
def f5(spark, sf):
    return inputs.memberships(spark, sf).groupBy("pixel").agg(F.count_distinct("field_uid").alias("overlap_field_count"), (F.count_distinct("label") > 1).alias("label_conflict"))


@query("f6_duplicate_count", f"WITH {FIELDS} SELECT field_uid, count(*) OVER (PARTITION BY geometry_sha256) AS duplicate_count FROM fields")
def f6(spark, sf):
    f = inputs.fields(spark, sf).select("field_uid", "geometry_sha256")
    n = f.groupBy("geometry_sha256").agg(F.count("*").alias("duplicate_count"))
    return f.join(n, "geometry_sha256").select("field_uid", "duplicate_count")


@query("f7_pixels_per_task", f"WITH {MEMBERSHIPS}, t AS (SELECT tile, count(*) AS n FROM memberships GROUP BY tile) SELECT min(n) AS least, quantile_cont(CAST(n AS DOUBLE), 0.5) AS median, round(avg(n), 6) AS mean, max(n) AS most FROM t")
def f7(spark, sf):
    t = inputs.memberships(spark, sf).groupBy("tile").agg(F.count("*").alias("n"))
    return r6(t.agg(F.min("n").alias("least"), F.median("n").alias("median"), F.avg("n").alias("mean"), F.max("n").alias("most")), "mean")


@query("f8_status_outcomes", f"WITH {TASKS} SELECT status, CASE WHEN status = 'succeeded' THEN outcome WHEN status = 'pending' THEN 'terminal_data_error' ELSE 'none' END AS outcome, count(*) AS n FROM tasks GROUP BY ALL")
def f8(spark, sf):
    o = F.when(F.col("status") == "succeeded", F.coalesce(F.get_json_object("meta", "$.outcome"), F.lit("complete"))).when(F.col("status") == "pending", "terminal_data_error").otherwise("none")
    return inputs.tasks(spark, sf).groupBy("status", o.alias("outcome")).agg(F.count("*").alias("n"))


@query("f9_completion_gate", f"WITH {TASKS} SELECT count(*) AS total, count(*) FILTER (status = 'succeeded') AS succeeded, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT task_id FROM tasks WHERE tile < 25)) AS missing, false AS complete FROM tasks WHERE tile < 25")
def f9(spark, sf):
    want = inputs.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task_id"))
    return a.completion(inputs.tasks(spark, sf).where("tile < 25"), want, "task_id")


@query("f10_due_tasks", f"WITH {TASKS} SELECT tile, count(*) FILTER (status = 'pending' AND due <= TIMESTAMP '1997-01-01') AS due_now, CAST(epoch(min(CASE WHEN status = 'pending' AND due > TIMESTAMP '1997-01-01' THEN due END)) - epoch(TIMESTAMP '1997-01-01') AS BIGINT) AS seconds_until_due FROM tasks GROUP BY tile")
def f10(spark, sf):
    now = F.lit("1997-01-01").cast("timestamp")
    p = F.col("status") == "pending"
    wait = F.unix_seconds(F.min(F.when(p & (F.col("due") > now), F.col("due")).cast("timestamp"))) - F.unix_seconds(now)
    return inputs.tasks(spark, sf).groupBy("tile").agg(F.count_if(p & (F.col("due") <= now)).alias("due_now"), wait.alias("seconds_until_due"))


@query("f11_crosstab", f"WITH {VECTORS} SELECT crop, count(*) FILTER (block % 3 = 0) AS s0, count(*) FILTER (block % 3 = 1) AS s1, count(*) FILTER (block % 3 = 2) AS s2 FROM vectors GROUP BY crop")
def f11(spark, sf):
    p = inputs.vectors(spark, sf).withColumn("s", F.col("block") % 3).groupBy("crop").pivot("s", [0, 1, 2]).count()
    return p.select("crop", *[F.coalesce(str(i), F.lit(0)).alias(f"s{i}") for i in range(3)])


@query("f12_phase_quartiles", f"WITH {OBSERVATIONS}, p AS (SELECT sample_id, CAST(floor((epoch_day - 19723) / 10) AS BIGINT) AS phase, CASE WHEN valid THEN value END AS v FROM observations) SELECT sample_id, phase, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, count(v) AS n FROM p GROUP BY ALL")
def f12(spark, sf):
    o = inputs.observations(spark, sf).withColumn("phase", F.floor((F.col("epoch_day") - 19723) / 10)).withColumn("v", F.when(F.col("valid"), F.col("value")))
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = o.groupBy("sample_id", "phase").agg(q.alias("q"), F.count("v").alias("n"))
    return out.select("sample_id", "phase", F.round(F.col("q")[1], 6).alias("median"), F.round(F.col("q")[2] - F.col("q")[0], 6).alias("iqr"), "n")


@query("f13_field_quartiles", f"WITH {VECTORS}, q AS (SELECT field, quantile_cont(v[1], 0.5) AS m, quantile_cont(v[1], 0.75) - quantile_cont(v[1], 0.25) AS i, quantile_cont(v[2], 0.5) AS m2 FROM vectors GROUP BY field) SELECT field, round(m, 6) AS median, round(i, 6) AS iqr, round(m2 - m, 6) AS contrast FROM q")
def f13(spark, sf):
    v = inputs.vectors(spark, sf).select("field", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"))
    q = v.groupBy("field").agg(F.percentile("a", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.percentile("b", F.lit(0.5)).alias("m2"))
    return q.select("field", F.round(F.col("q")[1], 6).alias("median"), F.round(F.col("q")[2] - F.col("q")[0], 6).alias("iqr"), F.round(F.col("m2") - F.col("q")[1], 6).alias("contrast"))


_POS = "each AS (SELECT * EXCLUDE (v), unnest(v) AS e, unnest(range(len(v))) AS d FROM {t})"
_MEAN = f"WITH {VECTORS}, {_POS.format(t='vectors')}, m AS (SELECT field, d, avg(e) AS m, stddev_pop(e) AS s FROM each GROUP BY field, d)"


@query("f14_vector_moments", _MEAN + " SELECT field, round(sum(m), 6) AS mean_sum, round(sum(s), 6) AS std_sum, round(max(m) FILTER (d = 3), 6) AS m3 FROM m GROUP BY field")
def f14(spark, sf):
    m = a.vector_moments(inputs.vectors(spark, sf), ["field"], "v")
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6)
    return m.select("field", total("mean").alias("mean_sum"), total("std").alias("std_sum"), F.round(F.col("mean")[3], 6).alias("m3"))


@query("f14_dispersion", _MEAN + ", c AS (SELECT field, list(m ORDER BY d) AS c FROM m GROUP BY field) SELECT field, round(avg(list_distance(v, c)), 6) AS dispersion FROM vectors JOIN c USING (field) GROUP BY field")
def f14b(spark, sf):
    v = inputs.vectors(spark, sf)
    c = a.mean_vectors(v, ["field"], "v").withColumnRenamed("v", "c")
    return v.join(c, "field").groupBy("field").agg(F.round(F.avg(vectors.distance(F.col("v"), F.col("c"))), 6).alias("dispersion"))


@query("f15_balanced_weights", f"WITH {VECTORS}, w AS (SELECT row_id, 1.0::DOUBLE / (SELECT count(DISTINCT crop) FROM vectors) / (SELECT count(DISTINCT field) FROM vectors b WHERE b.crop = a.crop) / (SELECT count(*) FROM vectors b WHERE b.field = a.field) AS w FROM vectors a) SELECT row_id, round(w, 9) AS weight FROM w")
def f15(spark, sf):
    return a.balanced_weights(inputs.vectors(spark, sf), ["crop", "field"]).select("row_id", F.round("weight", 9).alias("weight"))


@query("f16_weighted_standardizer", f"WITH {VECTORS}, {_POS.format(t='vectors')}, m AS (SELECT crop, d, sum(e * (x + 1)) / sum(x + 1) AS m, sum(e * e * (x + 1)) / sum(x + 1) AS q FROM each GROUP BY crop, d) SELECT crop, round(sum(m), 6) AS mean_sum, round(sum(greatest(sqrt(greatest(0, q - m * m)), 1e-6)), 6) AS scale_sum FROM m GROUP BY crop")
def f16(spark, sf):
    m = a.vector_moments(inputs.vectors(spark, sf), ["crop"], "v", F.col("x") + 1.0)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6)
    return m.select("crop", total("mean").alias("mean_sum"), total(F.transform("std", lambda s: F.greatest(s, F.lit(1e-6)))).alias("scale_sum"))


@query("f19_robust_channel", f"WITH {VECTORS}, s AS (SELECT row_id, v[1] + v[2] AS s FROM vectors), q AS (SELECT quantile_cont(s, 0.02) AS lo, quantile_cont(s, 0.98) AS hi FROM s) SELECT row_id, round(greatest(0, least(1, (s - lo) / (hi - lo))), 6) AS s FROM s, q")
def f19(spark, sf):
    s = inputs.vectors(spark, sf).select("row_id", (F.col("v")[0] + F.col("v")[1]).alias("s"))
    return r6(a.robust_channel(s, "s", []), "s")


_FW = f"WITH {WINDOWED}, {_POS.format(t='windowed')}, m AS (SELECT crop, field, w, d, avg(e) AS m FROM each GROUP BY ALL), fw AS (SELECT crop, field, w, list(m ORDER BY d) AS v FROM m GROUP BY ALL), mv AS (SELECT a.crop, a.field, a.w, list_distance(a.v, b.v) AS move FROM fw a JOIN fw b ON b.field = a.field AND b.w = a.w - 1)"


def field_windows(spark, sf):
    return a.mean_vectors(inputs.windowed_vectors(spark, sf), ["crop", "field", "w"], "v")


def moves(spark, sf):
    p = windows.previous(field_windows(spark, sf), ["field"], "w", ["v"])
    return p.where("prev_v IS NOT NULL").withColumn("move", vectors.distance(F.col("v"), F.col("prev_v")))


@query("f20_window_movement", _FW + " SELECT crop, w, round(quantile_cont(move, 0.5), 6) AS median, round(quantile_cont(move, 0.9), 6) AS p90 FROM mv GROUP BY ALL")
def f20(spark, sf):
    q = F.percentile("move", F.array(F.lit(0.5), F.lit(0.9)))
    return moves(spark, sf).groupBy("crop", "w").agg(q.alias("q")).select("crop", "w", F.round(F.col("q")[0], 6).alias("median"), F.round(F.col("q")[1], 6).alias("p90"))


@query("f21_path_tortuosity", _FW + ", e AS (SELECT a.field, list_distance(a.v, b.v) AS net FROM fw a JOIN fw b ON b.field = a.field AND a.w = 1 AND b.w = 4), p AS (SELECT field, sum(move) AS path FROM mv GROUP BY field) SELECT field, round(path, 6) AS path, round(net, 6) AS net, round(path / net, 6) AS tortuosity FROM p JOIN e USING (field)")
def f21(spark, sf):
    fw = windows.previous(field_windows(spark, sf), ["field"], "w", ["v"])
    step = F.when(F.col("prev_v").isNotNull(), vectors.distance(F.col("v"), F.col("prev_v"))).otherwise(0.0)
    g = fw.groupBy("field").agg(F.sum(step).alias("path"), F.min_by("v", "w").alias("s"), F.max_by("v", "w").alias("e"))
    g = g.withColumn("net", vectors.distance(F.col("s"), F.col("e")))
    return r6(g.select("field", "path", "net", F.try_divide("path", "net").alias("tortuosity")), "path", "net", "tortuosity")


@query("f22_direction_coherence", _FW + ", u AS (SELECT a.crop, a.w, list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) / list_distance(a.v, b.v)) AS u FROM fw a JOIN fw b ON b.field = a.field AND b.w = a.w - 1), ue AS (SELECT crop, w, unnest(u) AS e, unnest(range(64)) AS d FROM u), um AS (SELECT crop, w, d, avg(e) AS m FROM ue GROUP BY ALL) SELECT crop, w, round(sqrt(sum(m * m)), 6) AS coherence FROM um GROUP BY ALL")
def f22(spark, sf):
    u = moves(spark, sf).withColumn("u", vectors.unit(vectors.minus(F.col("v"), F.col("prev_v"))))
    return a.mean_vectors(u, ["crop", "w"], "u").select("crop", "w", F.round(vectors.norm(F.col("u")), 6).alias("coherence"))


_RANK = f"""WITH {PREDICTIONS}, s AS (SELECT lang, score, sum(truth) AS p, sum(1 - truth) AS n FROM predictions GROUP BY ALL),
c AS (SELECT *, sum(p) OVER (PARTITION BY lang ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY lang ORDER BY score DESC) AS fp FROM s),
g AS (SELECT lang, sum(p) AS pp, sum(n) AS nn, sum(n * (tp - p / 2.0::DOUBLE)) AS auc, sum(p * tp / (tp + fp)::DOUBLE) AS ap FROM c GROUP BY lang)"""


@query("f23_ranking_metrics", _RANK + " SELECT lang, CAST(pp + nn AS DOUBLE) AS size, round(pp / (pp + nn), 6) AS prevalence, round(auc / nullif(pp * nn, 0), 6) AS auroc, round(ap / nullif(pp, 0), 6) AS average_precision, round(ap / nullif(pp, 0) / (pp / (pp + nn)), 6) AS ap_lift FROM g")
def f23(spark, sf):
    return r6(evaluation.ranking_metrics(inputs.predictions(spark, sf), ["lang"], "truth", "score"), "prevalence", "auroc", "average_precision", "ap_lift")


@query("f23_threshold_metrics", f"WITH {PREDICTIONS}, c AS (SELECT lang, count(*) FILTER (truth = 1 AND score >= 0.5) AS tp, count(*) FILTER (truth = 0 AND score >= 0.5) AS fp, count(*) FILTER (truth = 1 AND score < 0.5) AS fn, count(*) FILTER (truth = 0 AND score < 0.5) AS tn FROM predictions GROUP BY lang) SELECT lang, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS fpr, round(1 - fp / nullif(fp + tn, 0), 6) AS specificity, round(tp / nullif(tp + fp, 0), 6) AS precision, round((tp / nullif(tp + fn, 0) + 1 - fp / nullif(fp + tn, 0)) / 2, 6) AS balanced_accuracy FROM c")
def f23b(spark, sf):
    p = inputs.predictions(spark, sf).withColumn("call", (F.col("score") >= 0.5).cast("int"))
    return r6(evaluation.threshold_metrics(p, ["lang"], "truth", "call"), "recall", "fpr", "specificity", "precision", "balanced_accuracy")


_CALLS = f"WITH {VECTORS}, c AS (SELECT crop AS actual, CASE WHEN row_id % 4 = 0 THEN (crop + 1) % 10 ELSE crop END AS called, 1.0::DOUBLE AS w FROM vectors), m AS (SELECT actual, called, sum(w) AS w FROM c GROUP BY ALL), k AS (SELECT r.label, support, coalesce(called, 0) AS called, tp FROM (SELECT actual AS label, sum(w) AS support, sum(CASE WHEN actual = called THEN w ELSE 0 END) AS tp FROM m GROUP BY actual) r LEFT JOIN (SELECT called AS label, sum(w) AS called FROM m GROUP BY called) q USING (label)), x AS (SELECT label, support, tp, coalesce(tp / nullif(called, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM k)"


def _calls(spark, sf):
    v = inputs.vectors(spark, sf)
    called = F.when(F.col("row_id") % 4 == 0, (F.col("crop") + 1) % 10).otherwise(F.col("crop"))
    return evaluation.confusion(v.select(F.col("crop").alias("actual"), called.alias("called")), "actual", "called")


@query("f24_confusion", _CALLS + " SELECT actual, CAST(called AS INTEGER) AS called, w FROM m")
def f24(spark, sf):
    return _calls(spark, sf)


@query("f24_class_metrics", _CALLS + " SELECT label, support, tp, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM x")
def f24b(spark, sf):
    return r6(evaluation.class_metrics(_calls(spark, sf), "actual", "called"), "precision", "recall", "f1")


@query("f24_overall_metrics", _CALLS + ", y AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM x) SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(r), 6) AS balanced_accuracy, round(avg(f), 6) AS macro_f1, round(sum(f * support) / sum(support), 6) AS weighted_f1 FROM y")
def f24c(spark, sf):
    return r6(evaluation.overall_metrics(evaluation.class_metrics(_calls(spark, sf), "actual", "called")), "accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")


@query("f25_score_distribution", f"WITH {PREDICTIONS}, h AS (SELECT *, CASE WHEN score <= 0 OR score >= 1 THEN 0 ELSE -(score * ln(score) + (1 - score) * ln(1 - score)) END AS h FROM predictions) SELECT block, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(quantile_cont(score, 0.1), 6) AS q10, round(quantile_cont(score, 0.5), 6) AS q50, round(quantile_cont(score, 0.75) - quantile_cont(score, 0.25), 6) AS iqr, round(avg(1 - abs(2 * score - 1)), 6) AS balance, round(avg(CASE WHEN score < 0.1 THEN 1.0 ELSE 0.0 END), 6) AS low_tail, round(avg(CASE WHEN score > 0.9 THEN 1.0 ELSE 0.0 END), 6) AS high_tail, round(avg(h), 6) AS entropy FROM h GROUP BY block")
def f25(spark, sf):
    d = inputs.predictions(spark, sf).groupBy("block").agg(*a.distribution("score")).drop("q25", "q75", "q90")
    return r6(d, *[c for c in d.columns if c != "block"])


@query("f26_neighbour_contrast", f"WITH {VECTORS}, n AS (SELECT abs(a.v[1] - b.v[1]) AS d, (a.v[1] > 0) <> (b.v[1] > 0) AS c, b.y FROM vectors a JOIN vectors b ON (b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)) SELECT y, round(avg(d), 6) AS contrast, round(avg(CASE WHEN c THEN 1.0 ELSE 0.0 END), 6) AS crossing FROM n GROUP BY y")
def f26(spark, sf):
    n = joins.neighbours(inputs.vectors(spark, sf).withColumn("s", F.col("v")[0]), [], "x", "y", "s")
    out = n.groupBy("y").agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("contrast"), F.avg(((F.col("a") > 0) != (F.col("b") > 0)).cast("double")).alias("crossing"))
    return r6(out, "contrast", "crossing")


@query("f27_residual_radius", _MEAN + ", c AS (SELECT field, list(m ORDER BY d) AS c FROM m GROUP BY field), f AS (SELECT any_value(crop) AS crop, field, avg(list_distance(v, c) ** 2) AS s FROM vectors JOIN c USING (field) GROUP BY field), l AS (SELECT crop, avg(s) AS s FROM f GROUP BY crop) SELECT round(sqrt(avg(s)), 6) AS radius FROM l")
def f27(spark, sf):
    v = inputs.vectors(spark, sf)
    c = a.mean_vectors(v, ["field"], "v").withColumnRenamed("v", "c")
    f = v.join(c, "field").groupBy("crop", "field").agg(F.avg(F.pow(vectors.distance(F.col("v"), F.col("c")), 2)).alias("s"))
    return f.groupBy("crop").agg(F.avg("s").alias("s")).agg(F.round(F.sqrt(F.avg("s")), 6).alias("radius"))


@query("f28_empirical_tail", f"WITH {PREDICTIONS} SELECT p.row_id, round((1 + count(c.row_id)) / (any_value(t.n) + 1), 6) AS tail FROM predictions p JOIN (SELECT lang, count(*) FILTER (truth = 0) AS n FROM predictions GROUP BY lang) t USING (lang) LEFT JOIN predictions c ON c.lang = p.lang AND c.truth = 0 AND c.score >= p.score WHERE p.truth = 1 GROUP BY p.row_id")
def f28(spark, sf):
    p = inputs.predictions(spark, sf)
    return a.empirical_tail(p.where("truth = 1"), p.where("truth = 0"), ["lang"], "score").select("row_id", F.round("tail", 6).alias("tail"))


@query("f29_stated_quantiles", f"WITH {PREDICTIONS} SELECT block, list_sort(list(score))[CAST(floor((count(*) - 1) * 0.3 + 1e-9) AS INTEGER) + 1] AS lower, list_sort(list(score))[CAST(ceil((count(*) - 1) * 0.3 - 1e-9) AS INTEGER) + 1] AS higher, round(quantile_cont(score, 0.3), 6) AS linear FROM predictions GROUP BY block")
def f29(spark, sf):
    return r6(a.stated_quantiles(inputs.predictions(spark, sf), ["block"], "score", 0.3, ["lower", "higher", "linear"]), "linear").drop("n")


@query("f30_field_rollup", f"WITH {VECTORS} SELECT field, round(avg(CASE WHEN v[1] > 0 THEN 1.0 ELSE 0.0 END), 6) AS rate, round(quantile_cont(v[1], 0.5), 6) AS median, bool_and(v[2] > -0.2) AS every FROM vectors GROUP BY field")
def f30(spark, sf):
    x = F.col("v")[0]
    out = inputs.vectors(spark, sf).groupBy("field").agg(F.avg((x > 0).cast("double")).alias("rate"), F.percentile(x, F.lit(0.5)).alias("median"), F.bool_and(F.col("v")[1] > -0.2).alias("every"))
    return r6(out, "rate", "median")


@query("f31_detection_rates", f"WITH {PREDICTIONS} SELECT block, count(*) AS n, round(count(*) FILTER (truth = 1 AND score > 0.6) / nullif(count(*) FILTER (truth = 1), 0), 6) AS detected, round(count(*) FILTER (truth = 0 AND score > 0.6) / nullif(count(*) FILTER (truth = 0), 0), 6) AS false_calls FROM predictions GROUP BY block")
def f31(spark, sf):
    hit, t = F.col("score") > 0.6, F.col("truth") == 1
    rate = lambda c: F.round(F.try_divide(F.count_if(c & hit), F.count_if(c)), 6)
    return inputs.predictions(spark, sf).groupBy("block").agg(F.count("*").alias("n"), rate(t).alias("detected"), rate(~t).alias("false_calls"))


@query("f32_outcome_table", f"WITH {WINDOWED}, s AS (SELECT crop, w, v[2] AS s FROM windowed) SELECT crop, w, count(*) FILTER (s > 0) AS supported, count(*) FILTER (s <= -0.1) AS out_of_model, round(quantile_cont(s, 0.5), 6) AS median, round(quantile_cont(s, 0.25), 6) AS q25, round(quantile_cont(s, 0.75), 6) AS q75 FROM s GROUP BY ALL")
def f32(spark, sf):
    s = inputs.windowed_vectors(spark, sf).select("crop", "w", F.col("v")[1].alias("s"))
    q = F.percentile("s", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = s.groupBy("crop", "w").agg(F.count_if(F.col("s") > 0).alias("supported"), F.count_if(F.col("s") <= -0.1).alias("out_of_model"), q.alias("q"))
    return out.select("crop", "w", "supported", "out_of_model", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q25", "median", "q75"))])


@query("f33_fact_payload", f"WITH {PREDICTIONS} SELECT '{{\"rows\":' || count(*) || ',\"positive\":' || count(*) FILTER (truth = 1) || ',\"false_calls\":' || count(*) FILTER (truth = 0 AND score > 0.6) || '}}' AS facts FROM predictions")
def f33(spark, sf):
    p = inputs.predictions(spark, sf).agg(F.count("*").alias("rows"), F.count_if(F.col("truth") == 1).alias("positive"), F.count_if((F.col("truth") == 0) & (F.col("score") > 0.6)).alias("false_calls"))
    return p.select(F.to_json(F.struct("rows", "positive", "false_calls")).alias("facts"))


@query("f34_publication_progress", f"WITH {TASKS} SELECT tile, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'pending') AS pending FROM tasks GROUP BY tile")
def f34(spark, sf):
    p = inputs.tasks(spark, sf).groupBy("tile").pivot("status", ["succeeded", "running", "pending"]).count()
    return p.fillna(0)


@query("f35_stratum_performance", _RANK.replace("lang", "b").replace("SELECT b, score", "SELECT block % 4 AS b, score").replace(", b FROM labels", ", lang FROM labels") + " SELECT CAST(b AS INTEGER) AS stratum, round(auc / nullif(pp * nn, 0), 6) AS auroc, round(ap / nullif(pp, 0), 6) AS average_precision FROM g")
def f35(spark, sf):
    p = inputs.predictions(spark, sf).withColumn("stratum", F.col("block") % 4)
    return r6(evaluation.ranking_metrics(p, ["stratum"], "truth", "score"), "auroc", "average_precision").select("stratum", "auroc", "average_precision")


@query("f36_stage_summary", f"WITH {WINDOWED} SELECT w, count(*) AS rows, count(DISTINCT field) AS fields, count(DISTINCT crop) AS crops FROM windowed GROUP BY w")
def f36(spark, sf):
    return inputs.windowed_vectors(spark, sf).groupBy("w").agg(F.count("*").alias("rows"), F.count_distinct("field").alias("fields"), F.count_distinct("crop").alias("crops"))


@query("f37_artifact_metadata", f"WITH {ITEMS} SELECT tile, array_to_string(list_sort(list(DISTINCT substr(sha256(doc), 1, 6))), ',') AS digests, count(*) FILTER (orbit <> 'R') AS valid, count(*) AS total FROM items GROUP BY tile")
def f37(spark, sf):
    d = F.substring(F.sha2("doc", 256), 1, 6)
    return inputs.items(spark, sf).groupBy("tile").agg(F.array_join(F.sort_array(F.collect_set(d)), ",").alias("digests"), F.count_if(F.col("orbit") != "R").alias("valid"), F.count("*").alias("total"))


@query("f40_max_difference", f"WITH {VECTORS} SELECT round(max(abs(row_id % 2 * 0.001::DOUBLE)), 6) AS difference, count(*) FILTER (row_id % 100 = 0) AS unpaired, false AS ok FROM vectors")
def f40(spark, sf):
    v = inputs.vectors(spark, sf).select("row_id", F.col("v")[0].alias("s"))
    other = v.where("row_id % 100 <> 0").withColumn("s", F.col("s") + F.col("row_id") % 2 * 0.001)
    return r6(evaluation.max_difference(v, other, ["row_id"], "s", 0.01), "difference")


@query("f41_set_fingerprint", "SELECT o_custkey % 20 AS grp, substr(sha256(array_to_string(list_sort(list(sha256(CAST(o_orderkey AS VARCHAR)))), ',')), 1, 16) AS fingerprint FROM orders GROUP BY 1")
def f41(spark, sf):
    return inputs.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 20).alias("grp")).agg(hashing.fingerprint(F.col("o_orderkey").cast("string"), length=16).alias("fingerprint"))


@query("f42_source_accounting", f"WITH {FIELDS} SELECT landcover, count(*) AS records, count(DISTINCT geometry_sha256) AS geometries FROM fields GROUP BY landcover")
def f42(spark, sf):
    return inputs.fields(spark, sf).groupBy("landcover").agg(F.count("*").alias("records"), F.count_distinct("geometry_sha256").alias("geometries"))


_G1 = f"WITH {CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY country, stratum ORDER BY CAST('0x' || substr(sha256('9:' || candidate_id), 1, 16) AS UBIGINT), candidate_id) AS k FROM candidates)"


@query("g1_stratified_ranks", _G1 + " SELECT candidate_id, country, stratum FROM r WHERE k <= 5")
def g1(spark, sf):
    return windows.first_rows(inputs.candidates(spark, sf), ["country", "stratum"], [hashing.hash_rank(F.lit("9"), "candidate_id"), F.col("candidate_id")], 5).select("candidate_id", "country", "stratum")


@query("g2_duplicate_ordinal", f"WITH {FIELDS} SELECT field_uid, CAST(row_number() OVER (PARTITION BY geometry_sha256 ORDER BY field_uid) - 1 AS INTEGER) AS ordinal FROM fields")
def g2(spark, sf):
    return windows.ordinal(inputs.fields(spark, sf), ["geometry_sha256"], ["field_uid"]).select("field_uid", "ordinal")


@query("g3_canonical_rows", f"WITH {FIELDS} SELECT field_uid FROM (SELECT field_uid, row_number() OVER (PARTITION BY geometry_sha256 ORDER BY (lang = 'en') DESC, field_uid) AS k FROM fields) WHERE k = 1")
def g3(spark, sf):
    return windows.first_rows(inputs.fields(spark, sf), ["geometry_sha256"], [(F.col("lang") == "en").desc(), F.col("field_uid")]).select("field_uid")


@query("g4_spaced_rows", f"WITH {OBSERVATIONS}, r AS (SELECT obs_id, row_number() OVER (PARTITION BY sample_id ORDER BY obs_id) - 1 AS i, count(*) OVER (PARTITION BY sample_id) AS n FROM observations) SELECT obs_id FROM r WHERE n <= 7 OR list_contains(list_transform(range(7), lambda j: CASE WHEN j = 6 THEN n - 1 ELSE CAST(floor(j * ((n - 1) / 6.0::DOUBLE)) AS BIGINT) END), i)")
def g4(spark, sf):
    return windows.spaced_rows(inputs.observations(spark, sf), ["sample_id"], ["obs_id"], 7).select("obs_id")


@query("g5_class_cap", f"WITH {VECTORS} SELECT row_id, crop FROM (SELECT row_id, crop, row_number() OVER (PARTITION BY crop ORDER BY CAST('0x' || substr(sha256('c:' || row_id), 1, 16) AS UBIGINT), row_id) AS k FROM vectors) WHERE k <= 12")
def g5(spark, sf):
    v = inputs.vectors(spark, sf)
    return windows.first_rows(v, ["crop"], [hashing.hash_rank(F.lit("c"), F.col("row_id").cast("string")), F.col("row_id")], 12).select("row_id", "crop")


_G6 = f"WITH {OBSERVATIONS} SELECT sample_id, epoch_day, bool_or(valid) AS valid, CASE WHEN bool_or(valid) THEN arg_min(obs_id, obs_id) FILTER (valid) ELSE min(obs_id) END AS item, CASE WHEN bool_or(valid) THEN arg_min(value, obs_id) FILTER (valid) ELSE 0 END AS b1, CASE WHEN bool_or(valid) THEN arg_min(k, obs_id) FILTER (valid) ELSE 0 END AS b2 FROM observations GROUP BY sample_id, epoch_day"


@query("g6_daily_mosaic", _G6)
def g6(spark, sf):
    m = mosaic.daily_first_valid(inputs.observations(spark, sf), ["sample_id", "epoch_day"], ["acquired", "obs_id"], "valid", "bands", "obs_id")
    return m.select("sample_id", "epoch_day", "valid", F.col("item"), F.col("bands")[0].alias("b1"), F.col("bands")[1].alias("b2"))


@query("g7_per_band_mosaic", f"WITH {OBSERVATIONS}, o AS (SELECT *, CASE WHEN obs_id % 3 = 0 THEN 0 ELSE value END AS vv, CASE WHEN obs_id % 2 = 0 THEN 0 ELSE k END AS vh FROM observations) SELECT sample_id, epoch_day, orbit, coalesce(arg_min(vv, obs_id) FILTER (vv <> 0), 0) AS vv, coalesce(arg_min(vh, obs_id) FILTER (vh <> 0), 0) AS vh, coalesce(arg_min(obs_id, obs_id) FILTER (vv <> 0) <> arg_min(obs_id, obs_id) FILTER (vh <> 0), false) AS composite FROM o GROUP BY ALL")
def g7(spark, sf):
    o = inputs.observations(spark, sf).withColumns({"vv": F.when(F.col("obs_id") % 3 == 0, 0.0).otherwise(F.col("value")), "vh": F.when(F.col("obs_id") % 2 == 0, 0.0).otherwise(F.col("k"))})
    return mosaic.first_nonzero_each(o, ["sample_id", "epoch_day", "orbit"], ["acquired", "obs_id"], ["vv", "vh"], "obs_id").select("sample_id", "epoch_day", "orbit", "vv", "vh", "composite")


@query("g8_daily_groups", f"WITH {ITEMS} SELECT tile, CAST(acquired AS DATE) AS day, orbit, count(*) AS n FROM items WHERE orbit <> 'N' GROUP BY ALL")
def g8(spark, sf):
    return inputs.items(spark, sf).where("orbit <> 'N'").groupBy("tile", F.to_date("acquired").alias("day"), "orbit").agg(F.count("*").alias("n"))


_G9 = f"""WITH {OBSERVATIONS}, r AS (SELECT sample_id, obs_id, row_number() OVER (PARTITION BY sample_id ORDER BY obs_id) - 1 AS i FROM observations), s AS (SELECT sample_id, count(*) AS n FROM r GROUP BY sample_id),
x AS (SELECT sample_id, n, unnest(range(16)) AS q FROM s), y AS (SELECT *, CASE WHEN n >= 16 THEN (CASE WHEN q < n % 16 THEN q * (n // 16 + 1) + (n // 16 + 1) // 2 ELSE (n % 16) * (n // 16 + 1) + (q - n % 16) * (n // 16) + (n // 16) // 2 END)
 WHEN q < n THEN q ELSE CAST(round_even((q - n + 1) * ((n - 1)::DOUBLE / (16 - n + 1)), 0) AS BIGINT) END AS i FROM x) SELECT sample_id, CAST(q AS INTEGER) AS seq, obs_id FROM y JOIN r USING (sample_id, i)"""


@query("g9_resample", _G9)
def g9(spark, sf):
    o = inputs.observations(spark, sf).select("sample_id", "obs_id")
    return windows.resampled(o, ["sample_id"], ["obs_id"], 16).select("sample_id", "seq", "obs_id")


@query("g10_previous_differences", _FW + " SELECT field, w, round(move, 6) AS move FROM mv")
def g10(spark, sf):
    return moves(spark, sf).select("field", "w", F.round("move", 6).alias("move"))


@query("g11_typical_row", f"WITH {FIELDS}, m AS (SELECT landcover, quantile_cont(CAST(n_chars AS DOUBLE), 0.5) AS m FROM fields GROUP BY landcover) SELECT landcover, field_uid FROM (SELECT landcover, field_uid, row_number() OVER (PARTITION BY landcover ORDER BY round(abs(n_chars - m), 9), n_chars DESC, field_uid) AS k FROM fields JOIN m USING (landcover)) WHERE k = 1")
def g11(spark, sf):
    return windows.typical(inputs.fields(spark, sf), ["landcover"], "n_chars", "n_chars", "field_uid").select("landcover", "field_uid")


@query("g12_largest_fields", f"WITH {FIELDS}, g AS (SELECT geometry_sha256 FROM fields GROUP BY 1 HAVING count(DISTINCT landcover) = 1), c AS (SELECT landcover, field_uid, n_chars, row_number() OVER (PARTITION BY geometry_sha256, landcover ORDER BY field_uid) AS d FROM fields JOIN g USING (geometry_sha256)) SELECT landcover, field_uid FROM (SELECT *, row_number() OVER (PARTITION BY landcover ORDER BY n_chars DESC, field_uid) AS k FROM c WHERE d = 1) WHERE k <= 4")
def g12(spark, sf):
    return cohort.largest_per_class(inputs.fields(spark, sf), "field_uid", "landcover", "geometry_sha256", "n_chars", 4).select("landcover", "field_uid")


@query("g13_pool_draw", f"WITH {FIELDS}, p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY landcover ORDER BY n_chars DESC, field_uid) AS k FROM fields) WHERE k <= 50) SELECT landcover, field_uid FROM (SELECT *, row_number() OVER (PARTITION BY landcover ORDER BY CAST('0x' || substr(sha256('p:' || field_uid), 1, 16) AS UBIGINT), field_uid) AS j FROM p) WHERE j <= 6")
def g13(spark, sf):
    pool = windows.first_rows(inputs.fields(spark, sf), ["landcover"], [F.desc("n_chars"), F.col("field_uid")], 50)
    return windows.first_rows(pool, ["landcover"], [hashing.hash_rank(F.lit("p"), F.col("field_uid").cast("string")), F.col("field_uid")], 6).select("landcover", "field_uid")


@query("g14_operating_threshold", f"""WITH {PREDICTIONS}, s AS (SELECT lang, score, sum(truth) AS p, sum(1 - truth) AS n FROM predictions GROUP BY ALL), c AS (SELECT lang, score AS threshold, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY lang) AS pp, sum(n) OVER (PARTITION BY lang) AS nn FROM s WINDOW w AS (PARTITION BY lang ORDER BY score DESC)),
m AS (SELECT lang, threshold, tp / pp AS recall, tp / (tp + fp) AS precision, fp / nn AS fpr FROM c) SELECT lang, threshold, round(recall, 6) AS recall, round(precision, 6) AS precision, round(fpr, 6) AS fpr FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY recall DESC, precision DESC, fpr, threshold DESC) AS k FROM m WHERE fpr <= 0.2) WHERE k = 1""")
def g14(spark, sf):
    return r6(windows.operating_point(inputs.predictions(spark, sf), "truth", "score", 0.2, ["lang"]), "recall", "precision", "fpr")


@query("g15_hashed_folds", f"WITH {VECTORS} SELECT row_id, CAST((row_number() OVER (PARTITION BY crop ORDER BY CAST('0x' || substr(sha256('f:' || row_id), 1, 16) AS UBIGINT)) - 1) % 5 AS INTEGER) AS fold FROM vectors")
def g15(spark, sf):
    return windows.fold_of(inputs.vectors(spark, sf), ["crop"], hashing.hash_rank(F.lit("f"), F.col("row_id").cast("string")), 5).select("row_id", "fold")


@query("g16_view_with_dropout", f"WITH {OBSERVATIONS}, u AS (SELECT sample_id, obs_id, epoch_day, CAST('0x' || substr(sha256('v:' || obs_id), 1, 16) AS UBIGINT) AS h, CAST('0x' || substr(sha256('d:' || obs_id), 1, 16) AS UBIGINT)::DOUBLE / 18446744073709551616 AS d FROM observations WHERE valid), r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY h) AS k FROM u), f AS (SELECT * FROM r WHERE k <= 8 AND (k = 1 OR d >= 0.3)) SELECT sample_id, obs_id, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY epoch_day, obs_id) - 1 AS INTEGER) AS place FROM f")
def g16(spark, sf):
    return mosaic.sampled_view(inputs.observations(spark, sf).where("valid"), ["sample_id"], "obs_id", "epoch_day", 8, 0.3).select("sample_id", "obs_id", "place")


@query("g17_causal_windows", f"WITH {OBSERVATIONS}, s AS (SELECT sample_id, min(epoch_day) AS a, max(epoch_day) + 1 AS z FROM observations GROUP BY sample_id), b AS (SELECT sample_id, a, z, sample_id % 4 AS batch FROM s), c AS (SELECT *, min(z - a) OVER (PARTITION BY batch) AS cov FROM b), u AS (SELECT *, CAST('0x' || substr(sha256('w:' || batch), 1, 16) AS UBIGINT)::DOUBLE / 18446744073709551616 AS u1, CAST('0x' || substr(sha256('s:' || sample_id), 1, 16) AS UBIGINT)::DOUBLE / 18446744073709551616 AS u2 FROM c), d AS (SELECT *, CAST(least(cov, floor(exp(ln(7.0) + u1 * (ln(cov) - ln(7.0))))) AS INTEGER) AS days FROM u) SELECT sample_id, CASE WHEN u2 < 0.2 THEN a ELSE CAST(a + floor((u2 - 0.2) / 0.8 * (z - a - days + 1)) AS INTEGER) END AS \"start\", days FROM d")
def g17(spark, sf):
    return mosaic.causal_windows(inputs.observations(spark, sf), "sample_id", F.col("sample_id") % 4, "epoch_day", 7, 0.2).select("sample_id", "start", "days")


@query("g18_argmax_class", f"WITH {VECTORS} SELECT row_id, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS top, round(list_max(v), 6) AS p FROM vectors")
def g18(spark, sf):
    top, p = windows.argmax_class(F.col("v"))
    return inputs.vectors(spark, sf).select("row_id", top.alias("top"), F.round(p, 6).alias("p"))


@query("g19_display_pair", f"WITH {VECTORS}, p AS (SELECT crop, block, avg(v[1]) AS mass, avg(v[2]) AS evidence FROM vectors GROUP BY ALL) SELECT crop, block FROM (SELECT *, row_number() OVER (PARTITION BY crop ORDER BY (block = crop) DESC, round(mass, 9) DESC, round(evidence, 9) DESC, block) AS k FROM p) WHERE k = 1")
def g19(spark, sf):
    p = inputs.vectors(spark, sf).groupBy("crop", "block").agg(F.avg(F.col("v")[0]).alias("mass"), F.avg(F.col("v")[1]).alias("evidence"))
    return windows.first_rows(p, ["crop"], [(F.col("block") == F.col("crop")).desc(), F.round("mass", 9).desc(), F.round("evidence", 9).desc(), F.col("block")]).select("crop", "block")


@query("g20_role_representatives", f"WITH {PREDICTIONS}, a AS (SELECT row_id FROM predictions WHERE truth = 1 ORDER BY score DESC, row_id LIMIT 1), b AS (SELECT row_id FROM predictions WHERE row_id NOT IN (SELECT row_id FROM a) ORDER BY score DESC, row_id LIMIT 1), c AS (SELECT row_id FROM predictions WHERE row_id NOT IN (SELECT row_id FROM a UNION ALL SELECT row_id FROM b) ORDER BY abs(score - 0.5), row_id LIMIT 1) SELECT 'true_high' AS role, row_id FROM a UNION ALL SELECT 'high', row_id FROM b UNION ALL SELECT 'middle', row_id FROM c")
def g20(spark, sf):
    p = inputs.predictions(spark, sf)
    roles = [("true_high", F.col("truth") == 1, [F.desc("score"), F.col("row_id")]), ("high", F.lit(True), [F.desc("score"), F.col("row_id")]), ("middle", F.lit(True), [F.abs(F.col("score") - 0.5), F.col("row_id")])]
    return mosaic.representatives(p, "row_id", roles)


@query("g21_private_counts", f"WITH {MEMBERSHIPS}, c AS (SELECT pixel, count(DISTINCT label) AS labels, count(DISTINCT field_uid) AS fields FROM memberships GROUP BY pixel) SELECT field_uid, count(DISTINCT pixel) AS pixels, count(DISTINCT CASE WHEN fields <= 25 THEN pixel END) AS private_pixels FROM memberships JOIN c USING (pixel) GROUP BY field_uid")
def g21(spark, sf):
    m = cohort.with_group_counts(inputs.memberships(spark, sf), ["pixel"], labels="label", fields="field_uid")
    return joins.dealt(m.select("field_uid", "pixel", "fields"), ["field_uid"]).groupBy("field_uid").agg(F.count_distinct("pixel").alias("pixels"), F.count_distinct(F.when(F.col("fields") <= 25, F.col("pixel"))).alias("private_pixels"))


@query("g22_first_available", "SELECT l_orderkey, arg_min(l_shipmode, p) AS w FROM (SELECT l_orderkey, CASE l_linenumber WHEN 2 THEN 'w2' WHEN 3 THEN 'w3' WHEN 1 THEN 'w1' WHEN 4 THEN 'w4' END AS l_shipmode, CASE l_linenumber WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 1 THEN 3 WHEN 4 THEN 4 END AS p FROM lineitem WHERE l_linenumber <= 4) GROUP BY l_orderkey")
def g22(spark, sf):
    li = inputs.table(spark, sf, "lineitem").select("l_orderkey", F.concat(F.lit("w"), "l_linenumber").alias("w"))
    return windows.first_available(li, ["l_orderkey"], "w", ["w2", "w3", "w1", "w4"]).select("l_orderkey", "w")


@query("h1_canonical_order", f"WITH {OBSERVATIONS} SELECT obs_id, row_number() OVER (ORDER BY sample_id, epoch_day, orbit, obs_id) AS place FROM observations")
def h1(spark, sf):
    return windows.placed(inputs.observations(spark, sf), ["sample_id", "epoch_day", "orbit", "obs_id"]).select("obs_id", "place")


@query("h2_manifest_order", f"WITH {CANDIDATES} SELECT country, stratum, candidate_id, row_number() OVER (ORDER BY country, stratum, candidate_id) AS place FROM candidates")
def h2(spark, sf):
    return windows.placed(inputs.candidates(spark, sf).select("country", "stratum", "candidate_id"), ["country", "stratum", "candidate_id"])


@query("h3_recent_failures", f"WITH {TASKS} SELECT task_id, due FROM tasks WHERE status = 'pending' ORDER BY due DESC, task_id LIMIT 20")
def h3(spark, sf):
    return inputs.tasks(spark, sf).where("status = 'pending'").orderBy(F.desc("due"), "task_id").limit(20).select("task_id", "due")


@query("h4_first_due_group", f"WITH {TASKS}, p AS (SELECT * FROM tasks WHERE status = 'pending'), g AS (SELECT tile FROM p ORDER BY due, tile, task_id LIMIT 1) SELECT task_id, tile FROM p WHERE tile IN (SELECT tile FROM g) ORDER BY due, task_id LIMIT 10")
def h4(spark, sf):
    p = inputs.tasks(spark, sf).where("status = 'pending'")
    g = p.agg(F.min(F.struct("due", "tile")).alias("m")).select("m.tile")
    return p.join(g, "tile", "left_semi").orderBy("due", "task_id").limit(10).select("task_id", "tile")


@query("h5_top_labels", f"WITH {MEMBERSHIPS} SELECT label, count(DISTINCT field_uid) AS fields FROM memberships GROUP BY label ORDER BY fields DESC, label LIMIT 3")
def h5(spark, sf):
    return inputs.memberships(spark, sf).groupBy("label").agg(F.count_distinct("field_uid").alias("fields")).orderBy(F.desc("fields"), "label").limit(3)


@query("h6_dataset_order", f"WITH {VECTORS} SELECT block, crop, row_id, row_number() OVER (ORDER BY block, crop, row_id) AS place FROM vectors")
def h6(spark, sf):
    return windows.placed(inputs.vectors(spark, sf).select("block", "crop", "row_id"), ["block", "crop", "row_id"])


@query("i1_common_rows", f"WITH {WINDOWED} SELECT row_id FROM windowed WHERE NOT (w = 3 AND row_id % 7 = 0) GROUP BY row_id HAVING count(DISTINCT w) = 4")
def i1(spark, sf):
    return cohort.in_all_windows(inputs.windowed_vectors(spark, sf).where("NOT (w = 3 AND row_id % 7 = 0)"), ["row_id"], "w", 4)


@query("i2_common_references", f"WITH {WINDOWED}, k AS (SELECT DISTINCT row_id % 300 AS pixel, w, crop FROM windowed WHERE NOT (w = 2 AND row_id % 5 = 0)), c AS (SELECT pixel FROM k GROUP BY pixel HAVING count(DISTINCT crop) = 1) SELECT pixel FROM k WHERE pixel IN (SELECT pixel FROM c) GROUP BY pixel HAVING count(DISTINCT w) = 4")
def i2(spark, sf):
    k = inputs.windowed_vectors(spark, sf).where("NOT (w = 2 AND row_id % 5 = 0)").select((F.col("row_id") % 300).alias("pixel"), "w", "crop")
    one = k.groupBy("pixel").agg(F.count_distinct("crop").alias("n")).where("n = 1").select("pixel")
    return cohort.in_all_windows(k.join(one, "pixel", "left_semi"), ["pixel"], "w", 4)


@query("i3_fully_published", f"WITH {WINDOWED}, e AS (SELECT field, count(*) AS expected FROM vectors GROUP BY field), g AS (SELECT field, w, count(*) AS n FROM windowed WHERE NOT (w = 4 AND row_id % 31 = 0) GROUP BY ALL) SELECT field FROM g JOIN e USING (field) WHERE n = expected GROUP BY field HAVING count(*) = 4")
def i3(spark, sf):
    want = inputs.vectors(spark, sf).groupBy("field").agg(F.count("*").alias("expected"))
    return cohort.fully_published(inputs.windowed_vectors(spark, sf).where("NOT (w = 4 AND row_id % 31 = 0)"), want, "field", "w", 4)


@query("i4_upsert", f"WITH {OBSERVATIONS}, n AS (SELECT obs_id, -1.0::DOUBLE AS value FROM observations WHERE obs_id % 5 = 0 UNION ALL SELECT obs_id + 10000000, -2.0 FROM observations WHERE obs_id % 50 = 0) SELECT obs_id, value FROM n UNION ALL SELECT obs_id, value FROM observations WHERE obs_id NOT IN (SELECT obs_id FROM n)")
def i4(spark, sf):
    o = inputs.observations(spark, sf).select("obs_id", "value")
    new = o.where("obs_id % 5 = 0").withColumn("value", F.lit(-1.0)).unionByName(o.where("obs_id % 50 = 0").select((F.col("obs_id") + 10000000).alias("obs_id"), F.lit(-2.0).alias("value")))
    return a.upsert(o, new, "obs_id")


@query("i5_extend_timeline", f"WITH {OBSERVATIONS} SELECT obs_id, epoch_day FROM observations")
def i5(spark, sf):
    o = inputs.observations(spark, sf).select("obs_id", "sample_id", "epoch_day")
    return mosaic.extended_timeline(o.where("epoch_day < 19735"), o, "epoch_day", 19735).select("obs_id", "epoch_day")


@query("i6_union_with_source", f"WITH {VECTORS} SELECT row_id, 'a' AS source FROM vectors WHERE block < 3 UNION ALL SELECT row_id, 'b' FROM vectors WHERE block > 4")
def i6(spark, sf):
    v = inputs.vectors(spark, sf).select("row_id", "block")
    return v.where("block < 3").withColumn("source", F.lit("a")).unionByName(v.where("block > 4").withColumn("source", F.lit("b"))).drop("block")


@query("i7_fallback_overlay", f"WITH {OBSERVATIONS}, v AS (SELECT sample_id, min(obs_id) AS o FROM observations WHERE valid AND kind = 'signup' GROUP BY 1), x AS (SELECT sample_id, min(obs_id) AS o FROM observations GROUP BY 1) SELECT sample_id, coalesce(v.o, x.o) AS obs FROM x LEFT JOIN v USING (sample_id)")
def i7(spark, sf):
    o = inputs.observations(spark, sf)
    pick = F.min(F.when(F.col("valid") & (F.col("kind") == "signup"), F.col("obs_id")))
    return o.groupBy("sample_id").agg(F.coalesce(pick, F.min("obs_id")).alias("obs"))


@query("i8_missing_and_extra", f"WITH {MEMBERSHIPS} SELECT 'missing' AS side, p_partkey AS pixel FROM part WHERE p_partkey NOT IN (SELECT pixel FROM memberships WHERE line = 1) UNION ALL SELECT 'extra', pixel FROM (SELECT DISTINCT pixel FROM memberships WHERE line = 1) WHERE pixel NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def i8(spark, sf):
    p = inputs.table(spark, sf, "part").select(F.col("p_partkey").alias("pixel"), "p_size")
    m = inputs.memberships(spark, sf).where("line = 1").select("pixel").distinct()
    return p.select("pixel").exceptAll(m).select(F.lit("missing").alias("side"), "pixel").unionByName(m.exceptAll(p.where("p_size < 25").select("pixel")).select(F.lit("extra").alias("side"), "pixel"))


@query("i9_replicas", f"WITH {FIELDS} SELECT field_uid FROM fields WHERE field_uid NOT IN (SELECT min(field_uid) FROM fields GROUP BY geometry_sha256)")
def i9(spark, sf):
    f = inputs.fields(spark, sf)
    return f.select("field_uid").join(f.groupBy("geometry_sha256").agg(F.min("field_uid").alias("field_uid")), "field_uid", "left_anti")


_I10 = f"""WITH {TASKS}, e AS (SELECT l_orderkey AS task_id, arg_max(CASE l_returnflag WHEN 'A' THEN 'retry' WHEN 'R' THEN 'fatal' ELSE 'complete' END, printf('%010d', l_linenumber * 1000000 + l_partkey) || CASE l_returnflag WHEN 'A' THEN 'retry' WHEN 'R' THEN 'fatal' ELSE 'complete' END) AS o FROM lineitem GROUP BY 1)
SELECT task_id, CASE WHEN o = 'complete' THEN 'succeeded' WHEN o = 'retry' THEN CASE WHEN attempts < 4 THEN 'pending' ELSE 'failed' END WHEN o = 'fatal' THEN 'failed' ELSE status END AS new_status,
 CASE WHEN o = 'retry' AND attempts < 4 THEN least(100.0::DOUBLE, 30 * pow(2.0, attempts - 1)) END AS delay FROM tasks LEFT JOIN e USING (task_id)"""


@query("i10_apply_outcomes", _I10)
def i10(spark, sf):
    o = F.when(F.col("l_returnflag") == "A", "retry").when(F.col("l_returnflag") == "R", "fatal").otherwise("complete")
    e = inputs.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task_id"), o.alias("outcome"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("at"))
    return a.apply_outcomes(inputs.tasks(spark, sf), e, "task_id", 4, 30.0, 100.0).select("task_id", "new_status", "delay")

