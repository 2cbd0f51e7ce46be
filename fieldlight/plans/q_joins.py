"""Queries of joins (E)."""

from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import cohort, joins
from . import inputs
from .inputs import CANDIDATES, FIELDS, ITEMS, MEMBERSHIPS, OBSERVATIONS, PREDICTIONS, VECTORS, WINDOWED
from .registry import query

WINDOWS = "windows(w, \"start\", \"end\") AS (VALUES (1, 19723, 19730), (2, 19723, 19740), (3, 19730, 19755), (4, 19800, 19810))"


def windows(spark):
    return spark.createDataFrame([(1, 19723, 19730), (2, 19723, 19740), (3, 19730, 19755), (4, 19800, 19810)], "w int, start int, end int")


@query("e1_points_by_years", f"WITH {CANDIDATES} SELECT candidate_id, CAST(year AS INTEGER) AS year, CASE WHEN year = 2024 THEN 'held' ELSE 'train' END AS year_role FROM candidates, (SELECT unnest([2022, 2023, 2024]) AS year)")
def e1(spark, sf):
    c = joins.cross_small(inputs.candidates(spark, sf).select("candidate_id"), [2022, 2023, 2024], "year")
    return c.withColumn("year_role", F.when(F.col("year") == 2024, "held").otherwise("train"))


@query("e2_task_matrix", f"WITH {CANDIDATES} SELECT candidate_id, modality, substr(sha256(candidate_id || ':' || modality), 1, 28) AS task_id FROM candidates, (SELECT unnest(['s1', 's2']) AS modality)")
def e2(spark, sf):
    c = joins.cross_small(inputs.candidates(spark, sf).select("candidate_id"), ["s1", "s2"], "modality")
    return c.withColumn("task_id", hashing.stable_id("candidate_id", "modality", length=28))


@query("e3_tasks_in_items", f"WITH {CANDIDATES}, {ITEMS} SELECT candidate_id, item_id, i.doc FROM candidates c JOIN items i ON i.tile = c.c_custkey % 50 AND longitude BETWEEN west AND east AND latitude BETWEEN south AND north")
def e3(spark, sf):
    c = inputs.candidates(spark, sf).withColumn("tile", F.col("c_custkey") % 50)
    return joins.point_in_boxes(c, inputs.items(spark, sf), ["tile"], "longitude", "latitude").select("candidate_id", "item_id", "doc")


@query("e4_items_over_window", f"WITH {ITEMS}, g AS (SELECT s_suppkey AS grp, s_suppkey % 50 AS tile, s_suppkey % 100 - 50.0 AS w0, s_suppkey % 100 - 45.0 AS w1, s_nationkey - 20.0 AS s0, s_nationkey - 10.0 AS s1 FROM supplier) SELECT grp, item_id, doc FROM g JOIN items USING (tile) WHERE w0 < east AND west < w1 AND s0 < north AND south < s1")
def e4(spark, sf):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    g = inputs.table(spark, sf, "supplier").select(k.alias("grp"), (k % 50).alias("tile"), (k % 100 - 50.0).alias("w0"), (k % 100 - 45.0).alias("w1"), (n - 20.0).alias("s0"), (n - 10.0).alias("s1"))
    return joins.overlapping(g, inputs.items(spark, sf), "tile").select("grp", "item_id", "doc")


@query("e5_memberships_pixels", f"WITH {MEMBERSHIPS} SELECT field_uid, line, pixel, p_size AS size FROM memberships LEFT JOIN part ON p_partkey = pixel")
def e5(spark, sf):
    p = inputs.table(spark, sf, "part").select(F.col("p_partkey").alias("pixel"), F.col("p_size").alias("size"))
    return inputs.memberships(spark, sf).join(p, "pixel", "left").select("field_uid", "line", "pixel", "size")


@query("e6_scan_units_flags", f"WITH {VECTORS} SELECT row_id, v.field, u.n, f.row_id2 IS NOT NULL AS flagged FROM vectors v JOIN (SELECT field, count(*) AS n FROM vectors GROUP BY field HAVING count(*) > 5) u USING (field) LEFT JOIN (SELECT row_id AS row_id2 FROM vectors WHERE block = 3) f ON f.row_id2 = v.row_id")
def e6(spark, sf):
    v = inputs.vectors(spark, sf)
    units = v.groupBy("field").agg(F.count("*").alias("n")).where("n > 5")
    flags = v.where("block = 3").select("row_id", F.lit(True).alias("flagged"))
    return v.join(units, "field").join(flags, "row_id", "left").select("row_id", "field", "n", F.coalesce("flagged", F.lit(False)).alias("flagged"))


_E7 = f"""WITH {FIELDS}, c AS (SELECT *, min(field_uid) OVER (PARTITION BY geometry_sha256, landcover) AS canonical FROM fields), x AS (SELECT field_uid, canonical, w FROM c, (SELECT unnest([1, 2]) AS w))
SELECT field_uid, CAST(w AS INTEGER) AS w, CASE WHEN canonical % 7 = 0 THEN 'unavailable' WHEN canonical % 3 = 0 THEN 'no_score' WHEN canonical <> field_uid THEN 'inherited' ELSE 'scored' END AS status FROM x"""


@query("e7_source_expansion", _E7)
def e7(spark, sf):
    f = cohort.canonical_fields(inputs.fields(spark, sf), "geometry_sha256", "landcover", "field_uid")
    own = f.where(F.col("field_uid") == F.col("canonical")).select("field_uid")
    every = joins.cross_small(own, [1, 2], "w")
    scores = every.where("field_uid % 3 <> 0").withColumn("score", F.lit(1.0))
    available = every.where("field_uid % 7 <> 0").withColumn("available", F.lit(True))
    status = F.when(F.col("available").isNull(), "unavailable").when(F.col("score").isNull(), "no_score").when(F.col("canonical") != F.col("field_uid"), "inherited").otherwise("scored")
    return joins.expansion(f, [1, 2], scores, available, "field_uid", "canonical", status).select("field_uid", "w", "status")


_DIST = "2 * 6371008.8::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2))))"


@query("e8_minimum_distance", f"WITH {CANDIDATES} SELECT a.candidate_id AS a, b.candidate_id AS b FROM candidates a JOIN candidates b ON a.candidate_id < b.candidate_id AND {_DIST} < 300000 * (1 - 0.005)")
def e8(spark, sf):
    return joins.too_close(inputs.candidates(spark, sf), "candidate_id", "longitude", "latitude", 300000.0, 0.005).select("a", "b")


@query("e9_cell_neighbours", f"WITH {VECTORS} SELECT b.x, b.y, a.row_id AS a, b.row_id AS b FROM vectors a JOIN vectors b ON (b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)")
def e9(spark, sf):
    return joins.neighbours(inputs.vectors(spark, sf), [], "x", "y", "row_id")


_CELLS = "cells AS (SELECT x, y, any_value(floor(x / 4) + floor(y / 5) * 7) AS kind FROM vectors GROUP BY x, y)"


@query("e10_pure_cells", f"WITH {VECTORS}, {_CELLS} SELECT a.x, a.y, CAST(any_value(a.kind) AS BIGINT) AS kind FROM cells a JOIN cells b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.x, a.y HAVING count(*) = 9 AND min(b.kind) = max(b.kind)")
def e10(spark, sf):
    cells = inputs.vectors(spark, sf).select("x", "y", (F.floor(F.col("x") / 4) + F.floor(F.col("y") / 5) * 7).alias("kind")).distinct()
    return joins.pure_cells(cells, "x", "y", "kind")


@query("e11_nearest_reference", f"WITH {CANDIDATES}, r AS (SELECT * FROM candidates WHERE c_custkey < 100), d AS (SELECT a.candidate_id, round({_DIST}, 3) AS metres, b.candidate_id AS ref FROM candidates a JOIN r b USING (country)) SELECT candidate_id, metres FROM (SELECT candidate_id, min(metres) AS metres FROM d GROUP BY candidate_id)")
def e11(spark, sf):
    c = inputs.candidates(spark, sf)
    refs = c.where("c_custkey < 100").select("country", F.col("candidate_id").alias("ref"), F.col("longitude").alias("rlon"), F.col("latitude").alias("rlat"))
    return joins.nearest(c, refs, ["country"], "candidate_id").select("candidate_id", "metres")


@query("e12_paired_predictions", f"WITH {PREDICTIONS} SELECT row_id, score AS a, round(1 - score, 2) AS b FROM predictions")
def e12(spark, sf):
    p = inputs.predictions(spark, sf)
    other = p.select("row_id", F.round(1 - F.col("score"), 2).alias("b"))
    return p.select("row_id", F.col("score").alias("a")).join(other, "row_id")


@query("e13_drop_shared", f"WITH {MEMBERSHIPS}, a AS (SELECT * FROM memberships WHERE line = 1), b AS (SELECT * FROM memberships WHERE line = 7) SELECT 'a' AS side, field_uid, pixel FROM a WHERE pixel NOT IN (SELECT pixel FROM b) UNION ALL SELECT 'b', field_uid, pixel FROM b WHERE pixel NOT IN (SELECT pixel FROM a)")
def e13(spark, sf):
    m = inputs.memberships(spark, sf)
    a, b = joins.only_in_one(m.where("line = 1"), m.where("line = 7"), "pixel")
    one = lambda d, s: d.select(F.lit(s).alias("side"), "field_uid", "pixel")
    return one(a, "a").unionByName(one(b, "b"))


@query("e14_one_block_groups", f"WITH {MEMBERSHIPS} SELECT field_uid, pixel, line FROM memberships WHERE field_uid IN (SELECT field_uid FROM memberships GROUP BY field_uid HAVING count(DISTINCT tile % 10) = 1)")
def e14(spark, sf):
    m = inputs.memberships(spark, sf).withColumn("block", F.col("tile") % 10)
    return joins.one_block_groups(m, "field_uid", "block").select("field_uid", "pixel", "line")


@query("e15_retained_fields", f"WITH {MEMBERSHIPS} SELECT field_uid, pixel, line FROM memberships WHERE field_uid IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def e15(spark, sf):
    keep = inputs.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("field_uid"))
    return inputs.memberships(spark, sf).join(keep, "field_uid", "left_semi").select("field_uid", "pixel", "line")


@query("e16_lookup_fallback", f"WITH {PREDICTIONS}, f AS (SELECT lang, block, count(*) AS n, round(avg(score), 6) AS t FROM predictions GROUP BY ALL), w AS (SELECT lang, round(avg(score), 6) AS t FROM predictions GROUP BY lang) SELECT row_id, coalesce(f.t, w.t) AS t FROM predictions p LEFT JOIN f ON f.lang = p.lang AND f.block = p.block AND f.n >= 5 LEFT JOIN w ON w.lang = p.lang")
def e16(spark, sf):
    p = inputs.predictions(spark, sf)
    fine = p.groupBy("lang", "block").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("t"))
    wide = p.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("t")).withColumn("block", F.lit(None).cast("int"))
    return joins.with_fallback(p, fine.unionByName(wide), ["lang"], "block", "t", 5).select("row_id", "t")


@query("e17_feature_table", f"WITH {VECTORS}, a AS (SELECT field, count(*) AS n FROM vectors GROUP BY field), b AS (SELECT field, round(avg(v[1]), 6) AS m FROM vectors GROUP BY field), c AS (SELECT field, max(x) AS x FROM vectors GROUP BY field), d AS (SELECT field, min(y) AS y FROM vectors WHERE block = 1 GROUP BY field) SELECT field, n, m, x, y FROM a JOIN b USING (field) JOIN c USING (field) LEFT JOIN d USING (field)")
def e17(spark, sf):
    v = inputs.vectors(spark, sf)
    a = v.groupBy("field").agg(F.count("*").alias("n"), F.round(F.avg(F.col("v")[0]), 6).alias("m"), F.max("x").alias("x"))
    return a.join(v.where("block = 1").groupBy("field").agg(F.min("y").alias("y")), "field", "left")


@query("e18_observations_in_windows", f"WITH {OBSERVATIONS}, {WINDOWS} SELECT obs_id, w FROM observations JOIN windows ON epoch_day >= \"start\" AND epoch_day < \"end\"")
def e18(spark, sf):
    o = inputs.observations(spark, sf).select("obs_id", "epoch_day")
    return joins.observations_in_windows(o, windows(spark), "epoch_day").select("obs_id", "w")


@query("e19_member_task_key", f"WITH {MEMBERSHIPS} SELECT field_uid, line, pixel, substr(sha256(tile % 10 || ':' || pixel % 16), 1, 24) AS task_key FROM memberships")
def e19(spark, sf):
    key = hashing.stable_id((F.col("tile") % 10).cast("string"), (F.col("pixel") % 16).cast("string"))
    return inputs.memberships(spark, sf).select("field_uid", "line", "pixel", key.alias("task_key"))


@query("e20_aligned_matrix", f"WITH {WINDOWED} SELECT row_id, round(max(v[2]) FILTER (w = 1), 6) AS w1, round(max(v[2]) FILTER (w = 2), 6) AS w2, round(max(v[2]) FILTER (w = 3), 6) AS w3, round(max(v[2]) FILTER (w = 4), 6) AS w4 FROM windowed GROUP BY row_id")
def e20(spark, sf):
    p = inputs.windowed_vectors(spark, sf).groupBy("row_id").pivot("w", [1, 2, 3, 4]).agg(F.round(F.first(F.col("v")[1]), 6))
    return p.select("row_id", *[F.col(str(i)).alias(f"w{i}") for i in (1, 2, 3, 4)])


@query("e21_canonical_crosswalk", f"WITH {FIELDS} SELECT field_uid, min(field_uid) OVER (PARTITION BY geometry_sha256, landcover) AS canonical, min(landcover) OVER (PARTITION BY geometry_sha256) <> max(landcover) OVER (PARTITION BY geometry_sha256) AS conflict FROM fields")
def e21(spark, sf):
    return cohort.canonical_fields(inputs.fields(spark, sf), "geometry_sha256", "landcover", "field_uid").select("field_uid", "canonical", "conflict")


@query("e22_features_vectors_members", f"WITH {VECTORS}, {MEMBERSHIPS}, m AS (SELECT DISTINCT pixel AS row_id, tile FROM memberships), f AS (SELECT block, count(*) AS phase_n FROM vectors GROUP BY block) SELECT row_id, tile, phase_n, round(v[1], 6) AS head FROM vectors JOIN m USING (row_id) JOIN f USING (block)")
def e22(spark, sf):
    v = inputs.vectors(spark, sf)
    m = inputs.memberships(spark, sf).select(F.col("pixel").alias("row_id"), "tile").distinct()
    f = v.groupBy("block").agg(F.count("*").alias("phase_n"))
    return v.join(m, "row_id").join(f, "block").select("row_id", "tile", "phase_n", F.round(F.col("v")[0], 6).alias("head"))
