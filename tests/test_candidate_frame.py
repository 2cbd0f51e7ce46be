"""The candidate frame: each cell has one outcome, in the order of the rules."""

from collections import Counter

from pyspark.sql import functions as F

from fieldlight.operators import geometry

SQUARE = "POLYGON (({0} {1}, {2} {1}, {2} {3}, {0} {3}, {0} {1}))"


def frame(spark, countries, regions):
    shapes = lambda rows, key: geometry.edges(spark.createDataFrame(rows, f"{key} int, wkt string"), key)
    e = shapes(countries, "country")
    land = F.when(F.col("ix") == 3, F.lit(None).cast("int")).when(F.col("iy") == 3, 0).when(F.col("ix") == 2, 80).otherwise(40)
    return geometry.candidate_frame(geometry.envelope_lattice(e, "country", 1.0), e, "country", land, {"nodata": [0], "water": [80]}, shapes(regions, "region"), "region", 8.0)


def test_each_cell_counts_once(spark):
    triangle = "POLYGON ((0 0, 4 0, 0 4, 0 0))"
    rows = frame(spark, [(1, SQUARE.format(0, 0, 4, 4)), (2, triangle)], [(7, SQUARE.format(0, 0, 2, 1)), (5, SQUARE.format(0, 0, 1, 1))]).collect()
    assert len(rows) == len({(r.country, r.ix, r.iy) for r in rows}) == 32
    got = Counter((r.country, r.outcome) for r in rows)
    # column 3 has no class, of the other columns row 3 no data, column 2 water; of the rest, two cells lie in regions
    assert {k[1]: n for k, n in got.items() if k[0] == 1} == {"no_land_cover": 4, "nodata": 3, "water": 3, "candidate": 2, "missing_region": 4}
    # cells on the slope count as inside: ix + iy <= 3
    assert {k[1]: n for k, n in got.items() if k[0] == 2} == {"outside_boundary": 6, "no_land_cover": 1, "nodata": 1, "water": 2, "candidate": 2, "missing_region": 4}
    named = {(r.ix, r.iy): (r.region, r.ambiguous) for r in rows if r.outcome == "candidate" and r.country == 1}
    assert named == {(0, 0): (5, True), (1, 0): (7, False)}


def test_no_countries_no_regions_and_a_shape_between_centres(spark):
    assert frame(spark, [], [(7, SQUARE.format(0, 0, 2, 1))]).count() == 0
    assert {r.outcome for r in frame(spark, [(1, SQUARE.format(0, 0, 2, 2))], []).collect()} == {"missing_region"}
    assert frame(spark, [(1, SQUARE.format(0.6, 0.6, 0.9, 0.9))], []).count() == 0


def test_cells_are_made_in_many_tasks(spark):
    """Few tall columns: their cells are whole, once each, and not all made in the one task that their few rows would be merged into."""
    shapes = spark.createDataFrame([("a", "POLYGON ((0.2 0.2, 2.1 0.2, 2.1 20000.1, 0.2 20000.1, 0.2 0.2))"), ("b", "POLYGON ((5.6 0, 5.7 0, 5.7 9, 5.6 0))")], "k string, wkt string")
    cells = geometry.envelope_lattice(geometry.edges(shapes, "k"), "k", 1.0).withColumn("task", F.spark_partition_id()).persist()
    by = cells.groupBy("task").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in by) == cells.select("k", "ix", "iy").distinct().count() == 2 * 20000 and len(by) > 1 and max(r.n for r in by) < 30000
    assert tuple(cells.agg(F.min("ix"), F.max("ix"), F.min("iy"), F.max("iy")).head()) == (0, 1, 0, 19999)
    cells.unpersist()
