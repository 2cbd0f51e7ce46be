"""Work that must not grow beyond the input: passes of fits, pairs that are shuffled, boxes that meet by cell."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldlight.functions.grid import great_circle_m
from fieldlight.operators import cohort, contracts, encoding, joins, logistic, mixture
from fieldlight.plans import inputs
from fieldlight.sources import bundles


def shuffled(df, what="shuffleRecordsWritten"):
    """Rows (or another metric) written by each exchange of the plan, after the action."""
    plan, out = [df._jdf.queryExecution().executedPlan()], []
    while plan:
        p = plan.pop()
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            plan.append(p.executedPlan())
            continue
        if p.nodeName().endswith("QueryStage"):
            plan.append(p.plan())
            continue
        if p.nodeName() == "Exchange":
            out.append(p.metrics().get(what).get().value())
        plan += [p.children().apply(i) for i in range(p.children().size())]
    return out


def test_fits_compute_their_rows_once(spark):
    rng = np.random.default_rng(1)
    rows = [(rng.normal(size=3).tolist(), int(i % 2)) for i in range(100)]
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield pd.DataFrame({"x": f["x"], "y": f["y"]})

    df = spark.createDataFrame(rows, "x array<double>, y int").mapInPandas(counted, "x array<double>, y int")
    models = logistic.fitted(df.withColumn("fits", F.array(F.struct(F.lit("a").alias("fit"), F.lit(1.0).alias("weight")))), "x", "y")
    assert models["a"].steps > 2 and seen.value == 100


def test_pairs_of_places_are_not_shuffled(spark):
    """Many keys at one place, a repeated row, keys with several places: pairs as by hand, exchanges hold points only."""
    dice = random.Random(4)
    rows = [(f"k{i:03}", 10.0, 20.0) for i in range(120)] + [(f"p{i:02}", dice.uniform(-180, 180), dice.uniform(-89, 89)) for i in range(60)]
    rows += [rows[0], ("k001", 10.5, 20.0), ("k001", 9.5, 20.0), ("k002", 179.9, 0.0), ("k003", -179.9, 0.0), (None, 10.0, 20.0), ("n", None, 1.0)]
    points = spark.createDataFrame(rows, "key string, lon double, lat double").repartition(3)
    got = joins.too_close(points, "key", "lon", "lat", 100_000.0)
    found = [(r.a, r.b, round(r.metres, 6)) for r in got.collect()]
    one = points.distinct()
    both = one.select(F.col("key").alias("a"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1")).crossJoin(one.select(F.col("key").alias("b"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2")))
    metres = great_circle_m(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))
    want = both.where("a < b").select("a", "b", metres.alias("metres")).where("metres < 100000").distinct()
    assert sorted(found) == sorted((r.a, r.b, round(r.metres, 6)) for r in want.collect()) and len(found) > 7000
    df = joins.too_close(spark.createDataFrame(rows[:120], "key string, lon double, lat double"), "key", "lon", "lat", 100_000.0)
    assert len(df.collect()) == 7140 and max(shuffled(df)) <= 120 * 15


def test_boxes_meet_by_cell(spark):
    """Boxes of all sizes, touching, unknown, over the antimeridian: as by the plain condition, and the join has cells among its keys."""
    dice = random.Random(8)
    box = lambda: (lambda w, s, a, b: (w, s, w + a, s + b))(dice.randint(-150, 150) * 1.0, dice.randint(-80, 80) * 1.0, dice.choice([0.0, 5.0, 15.0, 30.0, 200.0]), dice.choice([0.0, 5.0, 15.0, 90.0]))
    items = [(i, i % 2, *box()) for i in range(300)] + [(900, 0, None, 0.0, 5.0, 5.0), (901, 1, 170.0, 0.0, -170.0, 9.0), (902, 0, None, None, None, None), (903, 1, 0.0, None, 5.0, 5.0), (904, 1, 0.0, 0.0, None, 5.0)]
    items = spark.createDataFrame(items, "item int, tile int, west double, south double, east double, north double")
    shift = [(k, k % 2, *box()) for k in range(150)] + [(950, 1, 5.0, 5.0, 1.0, 1.0), (951, 0, None, 0.0, 1.0, 1.0)]
    windows = spark.createDataFrame(shift, "grp int, tile int, w0 double, s0 double, w1 double, s1 double")
    ok = "west IS NULL OR west > east OR (w0 < east AND west < w1 AND s0 < north AND south < s1)"
    want = sorted((r.grp, r.item) for r in windows.join(items, "tile").where(ok).collect())
    got = joins.overlapping(windows, items, "tile")
    assert sorted((r.grp, r.item) for r in got.collect()) == want and len(want) > 1000
    assert "_gx" in got._jdf.queryExecution().optimizedPlan().toString()


def test_small_boxes_are_not_spread(spark):
    """Boxes of all sizes, on cell edges, unknown and turned round: as by the plain condition; boxes of a cell's size are shuffled once."""
    dice = random.Random(3)
    box = lambda: (lambda w, s, a, b: (w, s, w + a, s + b))(dice.randint(-150, 150) * 1.0, dice.randint(-80, 80) * 1.0, dice.choice([-5.0, 0.0, 5.0, 10.0, 200.0]), dice.choice([0.0, 5.0, 20.0, 90.0]))
    items = [(i, i % 2, *box()) for i in range(300)] + [(900, 0, None, 0.0, 5.0, 5.0), (901, 1, 9.7, -0.1, 19.7, 9.9)]
    items = spark.createDataFrame(items, "item int, tile int, west double, south double, east double, north double")
    points = [(k, k % 2, dice.choice([dice.randint(-15, 15) * 10.0, dice.uniform(-180, 180)]), dice.randint(-90, 90) * 1.0) for k in range(300)] + [(950, 1, None, 0.0), (951, 1, 19.7, 9.9), (952, 1, 9.7, -0.1)]
    points = spark.createDataFrame(points, "point int, tile int, lon double, lat double")
    ok = "lon BETWEEN west AND east AND lat BETWEEN south AND north"
    want = sorted((r.point, r.item) for r in points.join(items, "tile").where(ok).collect())
    assert sorted((r.point, r.item) for r in joins.point_in_boxes(points, items, ["tile"], "lon", "lat").collect()) == want and len(want) > 500
    small = spark.range(3000).selectExpr("id AS item", "0 AS tile", "id % 300 - 150.0D AS west", "id % 90 - 60.0D AS south").selectExpr("*", "west + 10 AS east", "south + 8 AS north")
    df = joins.point_in_boxes(points.limit(100), small.repartition(2), ["tile"], "lon", "lat")
    df.collect()
    assert max(shuffled(df)) <= 3000


def test_items_of_a_snapshot_do_not_meet_what_was_asked_for(spark):
    """A snapshot of 3000 items: rules of snapshots shuffle what it says of itself, not its items."""
    items = ",".join(f'{{"id":"i{k}","collection":"c","raw_item_sha256":"{k:064x}"}}' for k in range(3000))
    head = '"schema_version":1,"modality":"s2","tile":"t","year":2020,"collection":"c","band_order":["B1"]'
    snapshots = spark.createDataFrame([("q", f"{{{head},\"items\":[{items}]}}", "0"), ("r", f"{{{head},\"items\":[]}}", "0"), ("s", "no", "0")], "query string, doc string, receipt string").repartition(2)
    expected = spark.createDataFrame([("q", 1, "s2", "t", 2021, "c", ["B1"]), ("r", 1, "s2", "t", 2020, "c", ["B1"]), ("u", 1, "s2", "t", 2020, "c", ["B1"])], "query string, schema_version int, modality string, tile string, year int, collection string, band_order array<string>")
    raw = spark.createDataFrame([], "digest string, doc string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = bundles.catalog_snapshot(snapshots, expected, raw)[1].where("rule IN ('receipt', 'json', 'identity', 'items', 'expected', 'absent')")
        got = sorted((r.rule, r.key) for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [("absent", "u"), ("expected", "s"), ("identity", "q"), ("items", "r"), ("json", "s"), ("receipt", "q"), ("receipt", "r"), ("receipt", "s")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert " AS s#" not in plan[plan.index("Join FullOuter"):].splitlines()[1]


def test_likelihoods_of_small_groups_are_shuffled_as_rows(spark):
    """Groups of few rows, one hot group, a null key, as by NumPy; a small group gives one array where it has met, not one a task."""
    dice = random.Random(5)
    rows = [(None if k == 0 else k, -dice.random(), -dice.random()) for k in range(40) for _ in range(12)] + [(99, -dice.random(), -dice.random()) for _ in range(4000)]
    df = mixture.grid_likelihoods(spark.createDataFrame(rows, "k int, a double, b double").repartition(8), ["k"], "a", "b", 101)
    found, grid = {r.k: r for r in df.collect()}, np.linspace(0, 1, 101)
    sizes = shuffled(df)
    for k in {r[0] for r in rows}:
        a, b = np.array([r[1:] for r in rows if r[0] == k]).T[:, :, None]
        assert found[k].rows == len(a) and np.allclose(found[k].ll, np.log(grid * np.exp(a) + (1 - grid) * np.exp(b)).sum(0))
    assert len(found) == 41 and min(sizes) <= 41 + 8  # what is added at last: one array a small group, at most one a task of the hot one


def test_series_are_views_of_a_batch():
    """Series of a slice of a batch: no Python object an observation; unknown values are NaN, uneven bands an error."""
    kind = pa.list_(pa.struct([("day", pa.int32()), ("item", pa.int64()), ("bands", pa.list_(pa.float64()))]))
    one = lambda day, *bands: {"day": day, "item": day, "bands": list(bands)}
    column = pa.array([[one(9, 9.0)], [one(1, 1.0, 2.0), one(2, 3.0, None)], [one(3, 5.0)]], kind)
    (b, d), (c, e) = encoding._series(column.slice(1))
    assert b.base is not None and np.array_equal(b, [[1, 2], [3, np.nan]], equal_nan=True) and d.tolist() == [1, 2]
    assert c.tolist() == [[5]] and e.tolist() == [3]
    with pytest.raises(ValueError, match="same number"):
        list(encoding._series(pa.array([[one(1, 1.0), one(2, 1.0, 2.0)]], kind)))


def test_small_rows_are_not_merged_into_one_task(spark):
    """Memberships, counts beside rows and references are made in as many tasks as shuffles have, not in one by their bytes."""
    tasks = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    rows = spark.range(4000).selectExpr("id % 1000 AS pixel", "id % 7 AS field", "id % 3 AS label")
    assert tasks(inputs.memberships(spark, "/root/testdata/sf0.001")) == 4
    assert tasks(cohort.with_group_counts(rows, ["pixel"], n="field")) == 4
    assert tasks(contracts.references(rows, "pixel", rows.where("pixel > 500"), "r")) == 4
    assert tasks(contracts.unique(rows, ["pixel"], "u")) == 4
    own = cohort.private_pixels(spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (2, 2, "a"), (3, 2, "a"), (4, 3, "a"), (4, 3, "b"), (5, 4, None), (None, 5, "a"), (6, 6, "a"), (6, 6, None), (9, 7, "a")], "field int, pixel int, label string"), spark.createDataFrame([(9,)], "field int"), "field", "pixel", "label")
    assert sorted((r.field, r.pixel, r.label or "") for r in own.collect()) == [(1, 1, "a"), (1, 1, "a"), (6, 6, ""), (6, 6, "a")]


def test_networks_train_in_parts_by_rows_not_by_input_parts(spark):
    """Each iteration's tasks report to the driver; an input of 60 small parts trains in as many tasks as there are cores."""
    from fieldlight.operators import models

    rows = spark.createDataFrame([(i, i % 2, [float(i % 2) + i % 7 / 9, float(i % 5)]) for i in range(600)], "id long, y int, v array<double>").repartition(60)
    for hidden in (3, None):
        spark.sparkContext.setJobGroup(f"network {hidden}", "")
        got = models.vector_classifier(rows, rows, "v", "y", 2, hidden, (20,)).where("predicted = y").count()
        tracker, wide = spark.sparkContext.statusTracker(), 0
        for job in tracker.getJobIdsForGroup(f"network {hidden}"):
            stages = [tracker.getStageInfo(s) for s in tracker.getJobInfo(job).stageIds]
            wide += any(s is not None and s.numTasks >= 60 and s.numCompletedTasks for s in stages)
        spark.sparkContext.setJobGroup("after", "")
        assert got > 500 and wide <= 8, (got, wide)  # the table's own scans; iterations are narrower
