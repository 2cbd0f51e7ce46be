"""Queries of geometry as relational jobs (C): one box per supplier, points from customers."""

from pyspark.sql import functions as F

from ..functions import grid
from ..operators import geometry as g
from . import inputs
from .inputs import CANDIDATES
from .registry import query

POLYS = """polys AS (SELECT k, x0, y0, x0 + 3 + k % 4 AS x1, y0 + 2 + k % 3 AS y1 FROM (SELECT s_suppkey AS k, (s_suppkey % 37) * 6.5::DOUBLE + 0.3::DOUBLE AS x0, floor(s_suppkey / 37) * 5.5::DOUBLE + 0.7::DOUBLE AS y0 FROM supplier)),
cells AS (SELECT k, x0, x1, y0, y1, ix, unnest(range(CAST(floor(y0) AS BIGINT), CAST(ceil(y1) AS BIGINT))) AS iy FROM (SELECT *, unnest(range(CAST(floor(x0) AS BIGINT), CAST(ceil(x1) AS BIGINT))) AS ix FROM polys)),
cover AS (SELECT k, ix, iy, x0 <= ix + 0.5 AND ix + 0.5 <= x1 AND y0 <= iy + 0.5 AND iy + 0.5 <= y1 AS centre, (least(x1, ix + 1) - greatest(x0, ix)) * (least(y1, iy + 1) - greatest(y0, iy)) AS covered FROM cells)"""


def polys(spark, sf):
    k = F.col("s_suppkey")
    s = inputs.table(spark, sf, "supplier").select(k.alias("k"), (k % 37 * 6.5 + 0.3).alias("x0"), (F.floor(k / 37) * 5.5 + 0.7).alias("y0"), "s_nationkey")
    s = s.withColumns({"x1": F.col("x0") + 3 + F.col("k") % 4, "y1": F.col("y0") + 2 + F.col("k") % 3})
    at = [F.col(c) for c in ("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1", "x0", "y0")]
    return s.withColumn("wkt", F.format_string("POLYGON ((%.4f %.4f, %.4f %.4f, %.4f %.4f, %.4f %.4f, %.4f %.4f))", *at))


def points(spark, sf):
    c = inputs.candidates(spark, sf)
    return c.select("candidate_id", "stratum", "country", ((F.col("longitude") + 180) * 0.7).alias("px"), ((F.col("latitude") + 85) * 0.4).alias("py"))


POINTS = CANDIDATES + ", points AS (SELECT candidate_id, stratum, country, (longitude + 180) * 0.7::DOUBLE AS px, (latitude + 85) * 0.4::DOUBLE AS py FROM candidates)"


@query("c1_wkt_edges", f"WITH {POLYS} SELECT k, 4 AS n_edges, round(2 * ((x1 - x0) + (y1 - y0)), 6) AS perimeter FROM polys")
def c1(spark, sf):
    e = g.edges(polys(spark, sf), "k")
    return e.groupBy("k").agg(F.count("*").cast("int").alias("n_edges"), F.round(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), 6).alias("perimeter"))


@query("c1_geometry_status", "SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 1 THEN 'not_a_polygon' WHEN 2 THEN 'ring_too_short' WHEN 3 THEN 'ring_not_closed' WHEN 4 THEN 'missing' END AS reason FROM supplier")
def c1b(spark, sf):
    k = F.col("k") % 5
    wkt = F.when(k == 1, "POINT (1 2)").when(k == 2, "POLYGON ((0 0, 1 1, 0 0))").when(k == 3, "POLYGON ((0 0, 1 0, 1 1, 0 1))").when(k == 0, F.col("wkt"))
    return polys(spark, sf).select("k", g.geometry_status(wkt).alias("reason"))


@query("c2_rasterise", f"WITH {POLYS} SELECT k, ix, iy FROM cover WHERE centre")
def c2(spark, sf):
    return g.rasterised(g.edges(polys(spark, sf), "k"), "k", 1.0)


@query("c3_touched_cells", f"WITH {POLYS} SELECT k, count(*) AS touched FROM cover WHERE covered > 1e-9 GROUP BY k")
def c3(spark, sf):
    return g.touched_count(g.edges(polys(spark, sf), "k"), "k", 1.0)


@query("c4_coverage", f"WITH {POLYS} SELECT k, ix, iy, round(covered, 6) AS covered FROM cover WHERE covered > 1e-9")
def c4(spark, sf):
    return g.coverage(g.edges(polys(spark, sf), "k"), "k", 1.0).withColumn("covered", F.round("covered", 6))


@query("c4_coverage_context", f"WITH {POLYS} SELECT k, round(quantile_cont(covered, 0.5), 6) AS median_cover, round(min(covered), 6) AS min_cover, round(avg(CASE WHEN covered < 1 - 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS edge_share FROM cover WHERE covered > 1e-9 GROUP BY k")
def c4b(spark, sf):
    c = g.context(g.coverage(g.edges(polys(spark, sf), "k"), "k", 1.0), "k")
    return c.select("k", *[F.round(x, 6).alias(x) for x in ("median_cover", "min_cover", "edge_share")])


@query("c5_area_box", f"WITH {POLYS} SELECT k, round((x1 - x0) * (y1 - y0), 6) AS area, round(x1 - x0, 6) AS width, round(y1 - y0, 6) AS height, round(ln((x1 - x0) * (y1 - y0)), 6) AS log_area FROM polys")
def c5(spark, sf):
    b = g.boxes(g.edges(polys(spark, sf), "k"), "k")
    return b.select("k", *[F.round(x, 6).alias(x) for x in ("area", "width", "height", "log_area")])


@query("c6_boundary_filter", f"WITH {POLYS}, {POINTS}, h AS (SELECT DISTINCT candidate_id FROM points JOIN polys ON px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1) SELECT candidate_id, candidate_id IN (SELECT candidate_id FROM h) AS kept FROM points")
def c6(spark, sf):
    r = g.regions_of(points(spark, sf), g.edges(polys(spark, sf), "k"), "candidate_id", "k", 8.0)
    return r.select("candidate_id", (F.col("k") >= 0).alias("kept"))


@query("c7_region_join", f"WITH {POLYS}, {POINTS}, h AS (SELECT candidate_id, min(k) AS k, count(*) > 1 AS ambiguous FROM points JOIN polys ON px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 GROUP BY candidate_id) SELECT candidate_id, coalesce(k, -1) AS k, coalesce(ambiguous, false) AS ambiguous FROM points LEFT JOIN h USING (candidate_id)")
def c7(spark, sf):
    return g.regions_of(points(spark, sf), g.edges(polys(spark, sf), "k"), "candidate_id", "k", 8.0)


@query("c8_lattice", "WITH n AS (SELECT CAST(count(*) AS BIGINT) AS c FROM supplier), r AS (SELECT unnest(range(0, c * 50)) AS id FROM n) SELECT id, id % 50 AS ix, CAST(floor(id / 50) AS BIGINT) AS iy, round(10 + (id % 50 + 0.5) * 0.2::DOUBLE, 6) AS px, round(20 + (floor(id / 50) + 0.5) * 0.2::DOUBLE, 6) AS py FROM r")
def c8(spark, sf):
    rows = inputs.table(spark, sf, "supplier").count()
    return g.lattice(spark, 10.0, 20.0, 50, rows, 0.2).withColumns({"px": F.round("px", 6), "py": F.round("py", 6)})


@query("c9_area_minus_excluded", f"WITH {POLYS}, {POINTS}, h AS (SELECT DISTINCT candidate_id, k % 3 = 0 AS bad FROM points JOIN polys ON px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1) SELECT candidate_id FROM h GROUP BY candidate_id HAVING NOT bool_or(bad)")
def c9(spark, sf):
    p = polys(spark, sf)
    e = g.edges(p, "k")
    inside = g.regions_of(points(spark, sf), e.where("k % 3 <> 0"), "candidate_id", "k", 8.0).where("k >= 0")
    out = g.regions_of(points(spark, sf), e.where("k % 3 = 0"), "candidate_id", "k", 8.0).where("k >= 0")
    return inside.join(out, "candidate_id", "left_anti").select("candidate_id")


@query("c10_buffer_filter", f"WITH {POLYS}, {POINTS}, t AS (SELECT candidate_id, CAST(CAST(candidate_id AS BIGINT) % (SELECT count(*) FROM supplier) AS BIGINT) AS k, px, py FROM points), d AS (SELECT candidate_id, k, greatest(x0 - px, px - x1, 0) AS dx, greatest(y0 - py, py - y1, 0) AS dy, least(abs(px - x0), abs(px - x1), abs(py - y0), abs(py - y1)) AS inner_d FROM t JOIN polys USING (k)) SELECT candidate_id, k, round(CASE WHEN dx > 0 OR dy > 0 THEN sqrt(dx * dx + dy * dy) ELSE inner_d END, 6) AS distance FROM d")
def c10(spark, sf):
    p = polys(spark, sf)
    n = p.agg(F.count("*").alias("n"))  # one row
    t = points(spark, sf).crossJoin(n).withColumn("k", F.col("candidate_id").cast("long") % F.col("n"))
    d = g.edge_distance(t.select("candidate_id", "k", "px", "py"), g.edges(p, "k"), "candidate_id", "k")
    return d.withColumn("distance", F.round("distance", 6))


@query("c11_cell_corners", f"WITH {CANDIDATES} SELECT candidate_id, true AS around FROM candidates WHERE latitude BETWEEN -80 AND 84")
def c11(spark, sf):
    c = inputs.candidates(spark, sf).withColumn("epsg", grid.utm_epsg(F.col("longitude"), F.col("latitude"))).where("epsg IS NOT NULL")
    x, y = grid.to_utm(F.col("longitude"), F.col("latitude"), F.col("epsg"))
    c = c.withColumns({"ux": F.floor(x / 10) * 10.0, "uy": F.floor(y / 10) * 10.0})
    corner = [grid.from_utm(F.col("ux") + a, F.col("uy") + b, F.col("epsg")) for a, b in ((0, 0), (10, 0), (10, 10), (0, 10))]
    lons, lats = F.array(*[p[0] for p in corner]), F.array(*[p[1] for p in corner])
    c = c.select("candidate_id", "longitude", "latitude", lons.alias("lons"), lats.alias("lats"))
    tight = (F.array_max("lons") - F.array_min("lons") < 0.01) & (F.array_max("lats") - F.array_min("lats") < 0.001)
    hit = F.col("longitude").between(F.array_min("lons") - 1e-7, F.array_max("lons") + 1e-7) & F.col("latitude").between(F.array_min("lats") - 1e-7, F.array_max("lats") + 1e-7)
    return c.select("candidate_id", (tight & hit).alias("around"))


@query("c12_square_wkt", "SELECT s_suppkey AS k, 'POLYGON ((' || concat_ws(', ', printf('%.1f %.1f', a, b), printf('%.1f %.1f', c, b), printf('%.1f %.1f', c, d), printf('%.1f %.1f', a, d), printf('%.1f %.1f', a, b)) || '))' AS wkt FROM (SELECT s_suppkey, (s_suppkey - 2) * 10.0::DOUBLE AS a, (s_nationkey - 2) * 10.0::DOUBLE AS b, (s_suppkey + 3) * 10.0::DOUBLE AS c, (s_nationkey + 3) * 10.0::DOUBLE AS d FROM supplier)")
def c12(spark, sf):
    s = inputs.table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("k"), g.square_wkt(F.col("s_suppkey"), F.col("s_nationkey"), 5, 10.0).alias("wkt"))


@query("c13_canonical_hash", f"WITH {POLYS} SELECT k, true AS same FROM polys")
def c13(spark, sf):
    p = polys(spark, sf)
    at = [F.col(c) for c in ("x1", "y1", "x1", "y0", "x0", "y0", "x0", "y1", "x1", "y1")]
    turned = p.withColumn("wkt", F.format_string("POLYGON ((%.4f %.4f, %.4f %.4f, %.4f %.4f, %.4f %.4f, %.4f %.4f))", *at))
    a, b = g.canonical_hash(g.edges(p, "k"), "k"), g.canonical_hash(g.edges(turned, "k"), "k").withColumnRenamed("geometry_sha256", "other")
    return a.join(b, "k").select("k", (F.col("geometry_sha256") == F.col("other")).alias("same"))


@query("c14_bounds_audit", f"WITH {POLYS} SELECT k, CASE WHEN k % 4 = 0 THEN 'outside_bounds' ELSE 'valid' END AS coordinate_status, floor((x0 + 180) / 6) <> floor((x1 + 180) / 6) AS crosses_zone FROM polys")
def c14(spark, sf):
    p = polys(spark, sf).withColumns({"lon": F.when(F.col("k") % 4 == 0, F.col("x1") + 1).otherwise(F.col("x0")), "lat": F.col("y0")})
    return g.bounds_audit(p, g.edges(p, "k"), "k", "lon", "lat")


@query("c15_field_pixels", f"WITH {POLYS}, t AS (SELECT k, count(*) FILTER (centre) AS pixel_count, count(*) FILTER (covered > 1e-9) AS touched, round(any_value((x1 - x0) * (y1 - y0)), 6) AS area FROM (SELECT c.*, x0, x1, y0, y1 FROM cover c JOIN polys USING (k)) GROUP BY k) SELECT k, CASE WHEN k % 9 = 0 THEN 'not_a_polygon' ELSE 'valid' END AS geometry_status, CASE WHEN k % 9 = 0 THEN 0 ELSE pixel_count END AS pixel_count, CASE WHEN k % 9 <> 0 THEN touched END AS touched, CASE WHEN k % 9 <> 0 THEN area END AS area FROM t")
def c15(spark, sf):
    p = polys(spark, sf).withColumn("wkt", F.when(F.col("k") % 9 == 0, "LINE (0 0)").otherwise(F.col("wkt"))).withColumn("label", F.col("s_nationkey"))
    f, _ = g.field_pixels(p, "k", 1.0)
    return f.select("k", "geometry_status", "pixel_count", "touched", F.round("area", 6).alias("area"))


@query("c15_memberships", f"WITH {POLYS}, m AS (SELECT k, ix, iy FROM cover WHERE centre) SELECT k, ix, iy, count(*) OVER (PARTITION BY ix, iy) AS overlap_field_count FROM m")
def c15b(spark, sf):
    _, m = g.field_pixels(polys(spark, sf).withColumn("label", F.col("s_nationkey")), "k", 1.0)
    return m.select("k", "ix", "iy", F.col("overlap_field_count").cast("long").alias("overlap_field_count"))


@query("l5_cells_of_polygon", f"WITH {POLYS} SELECT k, count(*) AS cells, sum(ix * 31 + iy) AS mark FROM cover WHERE centre GROUP BY k")
def l5(spark, sf):
    """One polygon in, many cells out, as an explode."""
    cells = g.rasterised(g.edges(polys(spark, sf), "k"), "k", 1.0)
    return cells.groupBy("k").agg(F.count("*").alias("cells"), F.sum(F.col("ix") * 31 + F.col("iy")).alias("mark"))
