"""Hand-made cases: exact values, recoveries, contracts and order-independence."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlight.functions import calendar, grid, radiometry, scalars
from fieldlight.operators import aggregates, calls, cohort, contracts, evaluation, geometry, joins, linear, mixture, mosaic, sampling, windows
from fieldlight.sources import io
from fieldlight.streaming import streams


def polygons(spark, *wkts):
    return spark.createDataFrame([(i, w) for i, w in enumerate(wkts)], "k long, wkt string")


def test_box_and_hole_rasterise(spark):
    box = "POLYGON ((0 0, 20 0, 20 20, 0 20, 0 0))"
    hole = "POLYGON ((0 0, 30 0, 30 30, 0 30, 0 0), (10 10, 20 10, 20 20, 10 20, 10 10))"
    e = geometry.edges(polygons(spark, box, hole), "k")
    cells = {(r.k, r.ix, r.iy) for r in geometry.rasterised(e, "k", 10.0).collect()}
    assert {c for c in cells if c[0] == 0} == {(0, x, y) for x in (0, 1) for y in (0, 1)}
    assert {c for c in cells if c[0] == 1} == {(1, x, y) for x in range(3) for y in range(3)} - {(1, 1, 1)}
    assert {r.k: r.touched for r in geometry.touched_count(e, "k", 10.0).collect()} == {0: 4, 1: 8}
    assert {r.k: round(r.area) for r in geometry.boxes(e, "k").collect()} == {0: 400, 1: 800}


def test_coverage_sums_to_the_area_of_a_star(spark):
    r = random.Random(4)
    spokes = [(t, 10 + 30 * r.random()) for t in sorted(r.random() * 6.28 for _ in range(25))]
    ring = [(50 + d * math.cos(t), 50 + d * math.sin(t)) for t, d in spokes]
    ring.append(ring[0])
    e = geometry.edges(polygons(spark, "POLYGON ((" + ", ".join(f"{x:.6f} {y:.6f}" for x, y in ring) + "))"), "k")
    area = geometry.boxes(e, "k").head().area
    total = geometry.coverage(e, "k", 7.0).agg(F.sum("covered")).head()[0] * 49
    assert total == pytest.approx(area, rel=1e-9)
    assert geometry.coverage(e, "k", 7.0).where("covered > 1 + 1e-9 OR covered < 0").count() == 0


def test_geometry_hash_ignores_start_and_direction(spark):
    same = ["POLYGON ((0 0, 4 0, 4 3, 0 3, 0 0))", "POLYGON ((4 3, 4 0, 0 0, 0 3, 4 3))", "POLYGON ((0 0, 5 0, 4 3, 0 3, 0 0))"]
    h = {r.k: r.geometry_sha256 for r in geometry.canonical_hash(geometry.edges(polygons(spark, *same), "k"), "k").collect()}
    assert h[0] == h[1] != h[2]
    bad = polygons(spark, "POINT (1 1)", None, "POLYGON ((0 0, 1 0, 1 1))", "POLYGON ((0 0, 1 0, 1 1, 0 1))")
    assert [r[0] for r in bad.select(geometry.geometry_status(F.col("wkt"))).collect()] == ["not_a_polygon", "missing", "ring_too_short", "ring_not_closed"]


def test_boundary_ties_and_gaps_of_regions(spark):
    e = geometry.edges(polygons(spark, "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))", "POLYGON ((10 0, 20 0, 20 10, 10 10, 10 0))"), "k")
    p = spark.createDataFrame([("in", 5.0, 5.0), ("edge", 10.0, 5.0), ("out", 30.0, 5.0)], "p string, px double, py double")
    got = {r.p: (r.k, r.ambiguous) for r in geometry.regions_of(p, e, "p", "k", 7.0).collect()}
    assert got == {"in": (0, False), "edge": (0, True), "out": (-1, False)}


def test_local_indices_and_windows(spark):
    df = spark.createDataFrame([(0, 0), (255, 255)], "x long, y long")
    got = [(r.local_row, r.local_col) for r in df.select(*grid.chunk_local(F.col("x"), F.col("y"))).collect()]
    assert got == [(255, 0), (0, 255)]
    w = spark.createDataFrame([(1, 10, 20), (1, 12, 23)], "g int, x long, y long")
    assert [(r.width, r.height, r.local_row, r.local_col) for r in windows.raster_window(w, ["g"], "x", "y").orderBy("x").collect()] == [(3, 4, 3, 0), (3, 4, 0, 2)]


def test_utm_of_a_known_point(spark):
    df = spark.createDataFrame([(30.0, -2.0)], "lon double, lat double").withColumn("epsg", grid.utm_epsg(F.col("lon"), F.col("lat")))
    e, n = grid.to_utm(F.col("lon"), F.col("lat"), F.col("epsg"))
    r = df.select("epsg", e.alias("e"), n.alias("n")).head()
    assert r.epsg == 32736 and 166000 < r.e < 167000 and 9778000 < r.n < 9779500


def test_resample_and_buckets(spark):
    def got(n, k):
        df = spark.createDataFrame([(1, i) for i in range(n)], "g int, i int")
        return [r.i for r in windows.resampled(df, ["g"], ["i"], k).orderBy("seq").collect()]

    assert got(3, 3) == [0, 1, 2] and got(4, 2) == [1, 3] and got(2, 4) == [0, 1, 0, 1]
    b = spark.createDataFrame([(0,), (9,), (999,)], "n int").select(scalars.bucket_size(F.col("n"))).collect()
    assert [r[0] for r in b] == [8, 16, 256]


def test_transforms(spark):
    row = spark.createDataFrame([([1.0, 0.1, 0.0, float("nan")], [2500.0, 900.0, 1000.0])], "a array<double>, b array<double>")
    r = row.select(radiometry.amplitude_scaled(F.col("a")), radiometry.harmonised(F.col("b")), radiometry.harmonised(F.col("b"), F.lit("2022-01-25").cast("timestamp"))).head()
    assert r[0] == [10000, 6000, 0, 0] and r[1] == [1500, 900, 0] and r[2] == [2500, 900, 1000]
    t = spark.createDataFrame([("2024-01-01T00:00:00",), ("2024-01-01T00:00:00Z",), ("x",), (None,)], "t string")
    assert [r[0] for r in t.select(calendar.iso_instant("t")[1]).collect()] == ["no_zone_or_malformed", None, "no_zone_or_malformed", "missing"]


def test_mosaics(spark):
    df = spark.createDataFrame([(1, 1, "a", False, [9.0, 9.0]), (1, 2, "b", True, [2.0, 3.0]), (2, 1, "c", False, [5.0, 5.0])], "p int, t int, i string, ok boolean, bands array<double>")
    m = {r.p: (r.valid, r["item"], list(r.bands)) for r in mosaic.daily_first_valid(df, ["p"], ["t", "i"], "ok", "bands", "i").collect()}
    assert m == {1: (True, "b", [2.0, 3.0]), 2: (False, "c", [0.0, 0.0])}
    s = spark.createDataFrame([(1, 1, "x", 7.0, 0.0), (1, 2, "y", 8.0, 6.0)], "p int, t int, i string, vv double, vh double")
    r = mosaic.first_nonzero_each(s, ["p"], ["t"], ["vv", "vh"], "i").head()
    assert (r.vv, r.vh, r.composite) == (7.0, 6.0, True)


def rounds_by_hand(counts, total, floor, power):
    """Targets by exact rules on a handful of strata: shares rounded down, then one each by remainder, share and key."""
    have = {k: min(floor, n) for k, n in counts.items()}
    while (left := total - sum(have.values())) > 0:
        free = [k for k in counts if have[k] < counts[k]]
        power_of = {k: (counts[k] - have[k]) ** power for k in free}
        exact = {k: left * (power_of[k] / sum(power_of.values())) for k in free}
        gain = {k: min(int(exact[k]), counts[k] - have[k]) for k in free}
        if not sum(gain.values()):
            gain = dict.fromkeys(sorted(free, key=lambda k: (exact[k] - int(exact[k]), power_of[k], k))[::-1][:left], 1)
        for k, n in gain.items():
            have[k] += n
    return have


def test_allocation(spark):
    def targets(counts, *how):
        rows = [(g, k, n) for g, own in counts.items() for k, n in own.items()]
        out = aggregates.power_allocation(spark.createDataFrame(rows, "g string, k string, n long"), ["g"], ["k"], *how)
        return {g: {r.k: r.target for r in out.where(F.col("g") == g).collect()} for g in counts}

    got = targets({"one": {"common": 900, "rare": 100}}, 200, 0, 0.5)["one"]
    assert sum(got.values()) == 200 and 20 < got["rare"] <= 100
    assert targets({"x": {"a": 5, "b": 5, "c": 5}}, 2, 0, 0.5)["x"] == {"a": 0, "b": 1, "c": 1}  # ties go to the greater key
    dice = np.random.default_rng(4)
    for floor, power in ((0, 1.0), (2, 0.5), (3, 0.0)):
        counts = {g: {f"s{i:02}": int(n) for i, n in enumerate(dice.integers(5, 400, 12))} for g in ("p", "q")}
        assert targets(counts, 50, floor, power) == {g: rounds_by_hand(own, 50, floor, power) for g, own in counts.items()}
    for bad in (({"x": {"a": 30, "b": 30}}, 10, 20, 0.5), ({"x": {"a": 3, "b": 2}}, 100, 1, 0.5), ({"x": {"a": 3}}, 0, 0, 0.5), ({}, 5, 0, 0.5), ({"x": {"a": 3}}, 1, 0, 2.0)):
        with pytest.raises(ValueError):
            targets(*bad)


def test_candidates_are_selected_per_country_with_a_distance_guard(spark):
    rows = [(f"{c}-{i}", c, f"block-{i // 2}", "forest" if i < 15 else "water", 30.0 + i / 100, -2.0 + i / 100 + k) for k, c in enumerate(("A", "B")) for i in range(20)]
    ddl = "candidate_id string, country string, spatial_block string, stratum string, longitude double, latitude double"
    df = spark.createDataFrame(rows, ddl)
    how = (2, 0.5, "7", {"train": 0.8, "validation": 0.1, "test": 0.1}, ["A", "B"])
    got = sampling.select_candidates(df, 10, *how).collect()
    assert sorted(map(str, got)) == sorted(map(str, sampling.select_candidates(df.repartition(5), 10, *how).collect()))
    assert {c: sum(r.country == c for r in got) for c in ("A", "B")} == {"A": 10, "B": 10} and all(0 < r.inclusion_probability <= 1 for r in got)
    assert sampling.select_candidates(df, None, *how).count() == 40
    near = df.unionByName(spark.createDataFrame([("x", "A", "b", "forest", 30.001, -2.0)], ddl))
    for bad, said in ((near, "minimum_distance"), (df.unionByName(df.limit(1)), "unique_id"), (df.withColumn("country", F.lit("C")), "country")):
        with pytest.raises(contracts.ContractError, match=said):
            sampling.select_candidates(bad, None, *how)


def test_best_split_scores_sizes_and_mean_class_shares(spark):
    dice = np.random.default_rng(8)
    rows = [(int(b), int(c)) for b, c in zip(dice.integers(0, 25, 400), dice.integers(0, 3, 400), strict=True)]
    df = spark.createDataFrame(rows, "b int, c int")
    ratios = {"train": 0.6, "validation": 0.2, "test": 0.2}
    scores = {}
    for seed in range(30):
        draw = {b: int(hashlib.sha256(f"{seed}:{b}".encode()).hexdigest()[:16], 16) / 2**64 for b, _ in rows}
        split = [0 if draw[b] < 0.6 else 1 if draw[b] < 0.8 else 2 for b, _ in rows]
        n = np.zeros((3, 3))
        np.add.at(n, (split, [c for _, c in rows]), 1)
        if n.min() > 0:
            r = np.array(list(ratios.values()))
            scores[seed] = np.abs(n.sum(1) / 400 - r).sum() + np.abs(n / n.sum(0) - r[:, None]).mean(1).sum()
    best = min(scores, key=lambda k: (round(scores[k], 9), k))
    got = sampling.best_split(df, "b", "c", 30, ratios).head()
    assert (got.seed, got.score) == (best, pytest.approx(scores[best], abs=1e-8))
    assert sampling.best_split(df.where("b = 0"), "b", "c", 5, ratios).head().seed is None


def test_group_folds(spark):
    df = spark.createDataFrame([(i % 12, i % 2) for i in range(100)] + [(3, 0)], "g int, y int")
    got, k = sampling.group_folds(df, "g", "y", 5)
    assert k and got.select("g", "fold").distinct().count() == 12 and got.select("fold", "y").distinct().count() == 2 * k
    assert sampling.group_folds(df.where("g = 1"), "g", "y", 5)[1] is None


def test_stated_quantiles(spark):
    dice = np.random.default_rng(2)
    x = np.round(dice.normal(size=101), 1)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 1.0), ("c", None)], "k string, x double")
    got = {r.k: r for r in aggregates.stated_quantiles(df, ["k"], "x", 0.37, ["lower", "higher", "linear"]).collect()}
    for m in ("lower", "higher", "linear"):
        assert got["a"][m] == pytest.approx(np.quantile(x, 0.37, method=m)) and got["b"][m] == 1.0
    assert set(got) == {"a", "b"} and got["a"].n == 101


def density_by_hand(x, y, field, shrinkage):
    """Centres and inverse covariance with labels, fields of a label and rows of a field counting the same."""
    w = np.array([1 / (len(set(y)) * len(set(field[y == k])) * (field == f).sum()) for k, f in zip(y, field, strict=True)])
    labels = sorted(set(y))
    centres = np.array([np.average(x[y == k], axis=0, weights=w[y == k]) for k in labels])
    r = x - centres[np.searchsorted(labels, y)]
    cov = (r * w[:, None]).T @ r / w.sum()
    cov = (1 - shrinkage) * cov + shrinkage * np.trace(cov) / len(cov) * np.eye(len(cov))
    return centres, np.linalg.inv(cov), w


def test_validated_density_matches_numpy(spark):
    r = np.random.default_rng(6)
    y = np.repeat([0, 1, 2], 80)
    field = y * 10 + r.integers(0, 4, 240)
    x = r.normal(size=(240, 4)) * (1, 2, 0.3, 1) + y[:, None] * 1.2 + (field % 10)[:, None] * 0.4
    fold = field % 10 % 4
    df = spark.createDataFrame([(i, int(a), int(f), int(o), v.tolist()) for i, (a, f, o, v) in enumerate(zip(y, field, fold, x, strict=True))], "i int, y int, field int, fold int, v array<double>").repartition(5)
    model, rows, losses = linear.validated_density(df, "y", "field", "v", "fold")
    _, _, w = density_by_hand(x, y, field, 0.5)
    loss = lambda s, t: float(np.sum(w * (np.log(np.exp((s - s.max(1, keepdims=True)) / t).sum(1)) - (s[np.arange(240), y] - s.max(1)) / t)))
    oof = {}
    for shrinkage in linear.SHRINKAGES:
        s = np.empty((240, 3))
        for k in range(4):
            c, inv, _ = density_by_hand(x[fold != k], y[fold != k], field[fold != k], shrinkage)
            d = x[fold == k][:, None, :] - c
            s[fold == k] = -0.5 * np.einsum("ncd,de,nce->nc", d, inv, d)
        oof[shrinkage] = s
    assert [b for _, b in losses] == pytest.approx([loss(oof[a], 1.0) for a in linear.SHRINKAGES])
    chosen = min(linear.SHRINKAGES, key=lambda a: loss(oof[a], 1.0))
    grid = np.geomspace(0.25, 8.0, 65)
    t = grid[np.argmin([loss(oof[chosen], g) for g in grid])]
    assert model.shrinkage == chosen and model.temperature == pytest.approx(t)
    got = {row.i: (row.log_scores, row.weight) for row in rows.collect()}
    assert np.array([got[i][0] for i in range(240)]) == pytest.approx(oof[chosen] / t) and [got[i][1] for i in range(240)] == pytest.approx(w.tolist())
    c, inv, _ = density_by_hand(x, y, field, chosen)
    d = x[:, None, :] - c
    assert model.log_scores(x) == pytest.approx(-0.5 * np.einsum("ncd,de,nce->nc", d, inv, d) / t)
    with pytest.raises(ValueError):
        linear.fit_density([(0, 1.0, [0.0], [0.0])], 0.0)


def test_weights_are_equal_per_level(spark):
    v = spark.createDataFrame([("a", 1, i) for i in range(4)] + [("a", 2, 9), ("b", 3, 10)], "c string, f int, r int")
    w = aggregates.balanced_weights(v, ["c", "f"])
    assert {r.c: round(r.s, 9) for r in w.groupBy("c").agg(F.sum("weight").alias("s")).collect()} == {"a": 0.5, "b": 0.5}
    assert {r.f: round(r.s, 9) for r in w.groupBy("f").agg(F.sum("weight").alias("s")).collect()} == {1: 0.25, 2: 0.25, 3: 0.5}


def test_linear_models_match_numpy(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 5)) @ r.normal(size=(5, 5))
    y = r.integers(0, 3, 300)
    x += y[:, None]
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(y, x, strict=True)], "y int, v array<double>").repartition(5)
    mean, axes, share = linear.principal_axes(df, "v", 3)
    values, vecs = np.linalg.eigh(np.cov(x.T, bias=True))
    assert mean == pytest.approx(x.mean(0)) and share == pytest.approx(values[::-1][:3] / values.sum())
    for a, b in zip(axes, vecs.T[::-1], strict=False):
        assert abs(a @ b) == pytest.approx(1)
    d = linear.fit_density(linear.label_stats(df, "y", "v"), 0.1)
    c = np.array([x[y == k].mean(0) for k in range(3)])
    within = sum((x[y == k] - c[k]).T @ (x[y == k] - c[k]) for k in range(3)) / 300
    within = 0.9 * within + 0.1 * np.trace(within) / 5 * np.eye(5)
    want = np.array([[-0.5 * (p - q) @ np.linalg.solve(within, p - q) for q in c] for p in x])
    assert d.log_scores(x) == pytest.approx(want)


def test_shares_are_recovered(spark):
    r = np.random.default_rng(1)
    rows = []
    for share in (0.0, 0.3, 0.5, 1.0):
        src = r.random(4000) < share
        z = np.where(src, r.normal(2, 1, 4000), r.normal(-2, 1, 4000))
        rows += [(share, float(-((v - 2) ** 2) / 2), float(-((v + 2) ** 2) / 2)) for v in z]
    df = spark.createDataFrame(rows, "g double, a double, b double")
    for x in mixture.mosaic_share(df, ["g"], "a", "b").collect():
        assert abs(x.share - x.g) < 0.04
    tie = spark.createDataFrame([(1, 0.0, 0.0)], "g int, a double, b double")
    assert mixture.mosaic_share(tie, ["g"], "a", "b").head().share == 0.5


def test_simplex_projection(spark):
    r = np.random.default_rng(2)
    p = r.normal(size=(4, 12))
    w = r.dirichlet(np.ones(4), 20)
    df = spark.createDataFrame([(i, (a @ p).tolist()) for i, a in enumerate(w)], "i int, v array<double>")
    for x in df.select("i", mixture.simplex_projection(F.col("v"), p).alias("w")).collect():
        assert x.w == pytest.approx(w[x.i].tolist(), abs=1e-6)
    out = spark.createDataFrame([(0, (p[0] * 3 - p[1] * 2).tolist())], "i int, v array<double>").select(mixture.simplex_projection(F.col("v"), p)).head()[0]
    assert sum(out) == pytest.approx(1) and min(out) >= 0


def test_draws_repeat_and_keep_size(spark):
    g = spark.createDataFrame([(k, b) for k in range(3) for b in range(5)], "k int, b int")
    a = mixture.draws(g, ["k"], "b", 6).orderBy("k", "replicate", "b").collect()
    assert a == mixture.draws(g.repartition(4), ["k"], "b", 6).orderBy("k", "replicate", "b").collect()
    assert {r.s for r in mixture.draws(g, ["k"], "b", 6).groupBy("k", "replicate").agg(F.sum("weight").alias("s")).collect()} == {5.0}


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "a int, p int")
    o = evaluation.overall_metrics(evaluation.class_metrics(evaluation.confusion(df, "a", "p"), "a", "p")).head()
    assert (o.accuracy, o.balanced_accuracy) == (0.75, 0.75)
    s = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "truth int, score double")
    m = evaluation.ranking_metrics(s, [], "truth", "score").head()
    assert m.auroc == pytest.approx(0.875) and m.average_precision == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert evaluation.ranking_metrics(s.where("truth = 1"), [], "truth", "score").head().auroc is None


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", 2)], "k int, s string, x int")
    with pytest.raises(contracts.ContractError):
        contracts.enforce(contracts.unique(df, ["k"]))
    assert {(r.rule, r.key) for r in contracts.violations(df, "k", {"x": F.col("x") > 0}).collect()} == {("x", "1")}
    assert contracts.constant(df, ["k"], "s", "c").count() == 1
    contracts.enforce(contracts.unique(df, ["s"]))


def test_cohort(spark):
    f = spark.createDataFrame([(1, "g", "m"), (2, "g", "m"), (3, "h", "m"), (4, "h", "b")], "f int, g string, l string")
    got = {r.f: (r.canonical, r.conflict) for r in cohort.canonical_fields(f, "g", "l", "f").collect()}
    assert got == {1: (1, False), 2: (1, False), 3: (3, True), 4: (4, True)}


def test_windows_and_late_rows(spark):
    w = streams.window_table(spark, 100, 114, 7, 7)
    assert [(r.start, r.end) for r in w.orderBy("w").collect()] == [(100, 107), (107, 114)]
    rows = spark.createDataFrame([(1, "s", 100, 1.0)], "i int, k string, d int, v double")
    late = spark.createDataFrame([(2, "s", 110, 5.0)], "i int, k string, d int, v double")
    old = joins.observations_in_windows(rows, w, "d").groupBy("k", "w").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    assert [(r.k, r.w) for r in streams.touched(late, w, "k", "d").collect()] == [("s", 1)]
    assert sorted((r.w, r.n, r.total) for r in streams.recomputed(old, rows, late, w, "k", "d", "i", "v").collect()) == [(0, 1, 1.0), (1, 1, 5.0)]


def test_micro_batches_equal_one_batch(spark, tmp_path):
    rows = [(i, i % 5, 100 + i * 7 % 30, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, k int, d int, v double")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    w = streams.window_table(spark, 100, 130, 10, 5)
    s = streams.event_stream(spark, str(tmp_path / "in"), df.schema)
    streams.micro_batches(s, str(tmp_path / "state"), str(tmp_path / "out"), w, "k", "d", "i", "v", str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = joins.observations_in_windows(df, w, "d").groupBy("k", "w").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    assert sorted(map(tuple, got.select("k", "w", "n", "total").collect())) == sorted(map(tuple, want.collect()))


def test_sinks_refuse_other_content(spark, tmp_path):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    path = str(tmp_path / "t")
    assert io.write_once(df, path) == 10 == io.write_once(df.repartition(3), path)
    with pytest.raises(contracts.ContractError):
        io.write_once(df.withColumn("x", F.col("id")), path)
    df.coalesce(1).write.option("header", True).csv(str(tmp_path / "c"))
    with pytest.raises(contracts.ContractError):
        io.read_csv(spark, str(tmp_path / "c"), "id long, y long")


def test_statuses_in_order(spark):
    base = {"passed": True, "rows": 9, "named": True, "blocks": 3, "far": 1.0, "far_threshold": 2.0, "named_mass": 0.9, "mass_threshold": 0.5, "margin": 1.0,
            "evidence_per_row": 0.5, "evidence_threshold": 0.1, "share": 0.4, "low": 0.2, "high": 0.6}
    cases = [
        ({"passed": None}, 0), ({"passed": False, "rows": 1}, 0), ({"rows": 1, "blocks": 1}, 1), ({"blocks": 1, "far": 9.0}, 2), ({"named": False, "blocks": 1}, 5), ({"far": 9.0, "margin": -1.0}, 3),
        ({"margin": -0.1}, 4), ({"named_mass": 0.4}, 4), ({}, 5), ({"low": 0.01}, 6), ({"low": None, "high": None}, 6), ({"named": False, "low": None}, 5),
        ({"share": 0.99}, 7), ({"share": 0.0}, 8), ({"evidence_per_row": 0.1}, 9), ({"evidence_per_row": 0.0, "share": 0.98}, 7),
    ]
    kinds = {"passed": "boolean", "rows": "long", "named": "boolean", "blocks": "long"}
    df = spark.createDataFrame([(i, *(base | c).values()) for i, (c, _) in enumerate(cases)], "i int, " + ", ".join(f"{k} {kinds.get(k, 'double')}" for k in base))
    got = {r.i: r.status for r in df.withColumn("status", calls.status()).collect()}
    assert got == {i: calls.STATUSES[n] for i, (_, n) in enumerate(cases)}


def test_thresholds_and_gates(spark):
    dice = np.random.default_rng(9)
    rows = [(p, f"{p}-{i}", p * 2 + i % 2, 3 if i < 8 else 9, float(1 - i % 2), *map(float, np.round(dice.random(4), 6))) for p in (0, 1) for i in range(11)]
    df = spark.createDataFrame(rows, "pair int, field string, label int, rows long, truth double, share double, evidence_per_row double, named_mass double, far double").withColumn("bin", scalars.count_bin(F.col("rows")))
    got = {(r.pair, r.bin): r for r in calls.thresholds(df, "pair").collect()}
    assert len(got) == 2 * len(calls.BINS)
    for p in (0, 1):
        own = [r for r in rows if r[0] == p]
        few, every = [r[6] for r in own if r[3] == 3], [r[6] for r in own]
        assert got[p, "3-4"].evidence_threshold == np.quantile(few, 0.95, method="higher") and got[p, "3-4"].source == "matching_bin"
        assert got[p, "9-16"].evidence_threshold == np.quantile(every, 0.95, method="higher") and got[p, "9-16"].source == "all_controls"
        assert got[p, "1"].mass_threshold == np.quantile([r[7] for r in own], 0.05, method="lower") and got[p, "1"].far_threshold == np.quantile([r[8] for r in own], 0.95, method="higher")
    made = spark.createDataFrame([(0, 0.5, 0.4)], "pair int, truth double, share double")
    limits = {"fields": 5, "accuracy": 0.5, "endpoint": 0.9, "synthetic": 0.2}
    gate = {r.pair: r for r in calls.gates(df, made, "pair", 5, 0.6, limits).collect()}
    assert gate[0].passed and not gate[1].passed and gate[0].endpoint_mae == pytest.approx(np.mean([abs(r[5] - r[4]) for r in rows if r[0] == 0]))
    assert not calls.gates(df, made, "pair", 5, 0.4, limits).where("passed").count() and not calls.gates(df, made, "pair", 1, 0.6, limits).where("passed").count()


def test_simplex_residuals_match_numpy(spark):
    dice = np.random.default_rng(5)
    protos, x = dice.normal(size=(4, 6)), np.vstack([dice.normal(size=(40, 6)), np.zeros((1, 6))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>")
    grid = np.array([(a, b, c, 40 - a - b - c) for a in range(41) for b in range(41 - a) for c in range(41 - a - b)]) / 40
    for r in mixture.with_simplex(df, "v", protos).collect():
        w = np.array(r.weights)
        rest = x[r.i] - w @ protos
        assert w.min() >= 0 and w.sum() == pytest.approx(1) and r.residual_norm == pytest.approx(np.linalg.norm(rest))
        assert r.residual_norm <= np.linalg.norm(x[r.i] - grid @ protos, axis=1).min() + 1e-9
        assert r.residual_rmse == pytest.approx(np.sqrt((rest**2).mean())) and r.active_count == (w > 1e-9).sum()
        assert r.relative_residual == (None if r.i == 40 else pytest.approx(np.linalg.norm(rest) / np.linalg.norm(x[r.i])))


def test_nearest_equals_brute_force(spark):
    dice = np.random.default_rng(7)
    p = [(i, "ab"[i % 2], float(x), float(y)) for i, (x, y) in enumerate(zip(dice.uniform(-180, 180, 60), dice.uniform(-88, 88, 60), strict=True))]
    q = [(f"r{i}", "abc"[i % 3], float(x), float(y)) for i, (x, y) in enumerate(zip(dice.uniform(-180, 180, 30), dice.uniform(-88, 88, 30), strict=True))]
    df = spark.createDataFrame([*p, (99, "z", 0.0, 0.0)], "id int, k string, longitude double, latitude double")
    refs = spark.createDataFrame(q, "ref string, k string, rlon double, rlat double")
    d = grid.great_circle_m(F.col("longitude"), F.col("latitude"), F.col("rlon"), F.col("rlat"))
    want = df.join(refs, "k").groupBy("id").agg(F.min(F.struct(F.round(d, 3).alias("m"), "ref")).alias("b")).select("id", "b.m", "b.ref")
    got = joins.nearest(df, refs, ["k"], "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 60
