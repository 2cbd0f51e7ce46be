"""Polygons as edge tables: every predicate is a join and an aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import spread_over

_NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
_RING = rf"\(\s*({_NUMBER}\s+{_NUMBER}(?:\s*,\s*{_NUMBER}\s+{_NUMBER})*)\s*\)"


def geometry_status(wkt: Column) -> Column:
    """Null for a polygon or multipolygon of closed rings, else why not."""
    text = F.upper(F.trim(wkt))
    rings = F.regexp_extract_all(wkt, F.lit(_RING))
    points = lambda r: F.split(F.trim(r), r"\s*,\s*")
    plain = lambda p: F.regexp_replace(F.trim(p), r"\s+", " ")
    return (
        F.when(wkt.isNull() | (F.trim(wkt) == ""), "missing")
        .when(~text.startswith("POLYGON") & ~text.startswith("MULTIPOLYGON"), "not_a_polygon")
        .when(F.size(rings) == 0, "no_rings")
        .when(F.exists(rings, lambda r: F.size(points(r)) < 4), "ring_too_short")
        .when(F.exists(rings, lambda r: plain(F.element_at(points(r), 1)) != plain(F.element_at(points(r), -1))), "ring_not_closed")
    )


def edges(df: DataFrame, key: str, wkt: str = "wkt") -> DataFrame:
    """(key, ring, seq, x1, y1, x2, y2) of the rows with a valid geometry."""
    rings = df.where(geometry_status(F.col(wkt)).isNull()).select(key, F.posexplode(F.regexp_extract_all(wkt, F.lit(_RING))).alias("ring", "r"))
    points = F.transform(F.split(F.trim("r"), r"\s*,\s*"), lambda p: F.transform(F.split(F.trim(p), r"\s+"), lambda x: x.cast("double")))
    pairs = rings.withColumn("p", points)
    each = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(i.alias("seq"), F.element_at("p", i)[0].alias("x1"), F.element_at("p", i)[1].alias("y1"), F.element_at("p", i + 1)[0].alias("x2"), F.element_at("p", i + 1)[1].alias("y2")))
    return pairs.select(key, "ring", F.explode(each).alias("e")).select(key, "ring", "e.*")


def _crossings() -> tuple[Column, Column]:
    """For a point (px, py) and an edge: 1 if a ray to the right meets it, and whether the point is on it."""
    px, py, x1, y1, x2, y2 = (F.col(c) for c in ("px", "py", "x1", "y1", "x2", "y2"))
    meets = ((y1 <= py) != (y2 <= py)) & (px < x1 + (py - y1) * (x2 - x1) / F.when(y1 != y2, y2 - y1).otherwise(1.0))
    cross = (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)
    on = (cross == 0) & (px >= F.least(x1, x2)) & (px <= F.greatest(x1, x2)) & (py >= F.least(y1, y2)) & (py <= F.greatest(y1, y2))
    return meets.cast("int"), on


def boxes(e: DataFrame, key: str) -> DataFrame:
    """Box, signed-ring area and size of each geometry (holes wind the other way or are counted by ring parity)."""
    area = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    ring = e.groupBy(key, "ring").agg((F.abs(F.sum(area)) / 2).alias("a"), F.min("x1").alias("x0"), F.max("x1").alias("x9"), F.min("y1").alias("y0"), F.max("y1").alias("y9"))
    sign = F.when(F.col("ring") == 0, F.col("a")).otherwise(-F.col("a"))
    out = ring.groupBy(key).agg(F.sum(sign).alias("area"), F.min("x0").alias("x_min"), F.max("x9").alias("x_max"), F.min("y0").alias("y_min"), F.max("y9").alias("y_max"))
    return out.withColumns({"width": F.col("x_max") - F.col("x_min"), "height": F.col("y_max") - F.col("y_min"), "log_area": F.log(F.greatest(F.col("area"), F.lit(1e-9)))})


def rasterised(e: DataFrame, key: str, size: float) -> DataFrame:
    """(key, ix, iy) of grid cells whose centre is inside or on the polygon.

    By scan lines: an edge gives one crossing for each row of centres that it passes; sorted crossings of a
    row pair up, and the cells between two of a pair are inside. Work grows with the edges' rows and the
    cells that come out, not with boxes times edges.
    """
    meets, on = _crossings()
    row = lambda y, d: F.floor(y / size - 0.5).cast("long") + d
    tall = e.select(key, "x1", "y1", "x2", "y2", F.explode(F.sequence(row(F.least("y1", "y2"), 0), row(F.greatest("y1", "y2"), 1))).alias("iy"))
    tall = tall.withColumn("py", (F.col("iy") + 0.5) * size)
    passes = (F.col("y1") <= F.col("py")) != (F.col("y2") <= F.col("py"))
    at = F.col("x1") + (F.col("py") - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.when(F.col("y1") != F.col("y2"), F.col("y2") - F.col("y1")).otherwise(1.0)
    w = W.partitionBy(key, "iy").orderBy("_x")
    pairs = tall.where(passes).select(key, "iy", at.alias("_x")).withColumns({"_i": F.row_number().over(w), "_to": F.lead("_x").over(w)}).where("_i % 2 = 1")
    span = F.sequence(F.floor(F.col("_x") / size - 0.5).cast("long"), F.floor(F.col("_to") / size - 0.5).cast("long") + 1)
    within = pairs.withColumn("ix", F.explode(span)).withColumn("px", (F.col("ix") + 0.5) * size).where("px >= _x AND px < _to").select(key, "ix", "iy")
    # centres on an edge: at its crossing with the row, or along it where it lies in the row
    level = F.col("y1") == F.col("y2")
    left, right = F.when(level, F.least("x1", "x2")).otherwise(at), F.when(level, F.greatest("x1", "x2")).otherwise(at)
    touched = tall.where((F.col("py") >= F.least("y1", "y2")) & (F.col("py") <= F.greatest("y1", "y2")))
    touched = touched.withColumn("ix", F.explode(F.sequence(F.floor(left / size - 0.5).cast("long"), F.floor(right / size - 0.5).cast("long") + 1)))
    touched = touched.withColumn("px", (F.col("ix") + 0.5) * size).where(on).select(key, "ix", "iy")
    return within.unionByName(touched).distinct()


def inside(points: DataFrame, e: DataFrame, columns: list[str], key: str, band: float) -> DataFrame:
    """Rows of points (px, py, key) that lie inside or on the geometry with their key.

    Both meet by key and band of y, so a point sees only the edges at its own height, and a large geometry is many keys.
    """
    meets, on = _crossings()
    at = lambda y: F.floor(y / band).cast("long")
    near = e.select(key, "x1", "y1", "x2", "y2", F.explode(F.sequence(at(F.least("y1", "y2")), at(F.greatest("y1", "y2")))).alias("_band"))
    hit = points.withColumn("_band", at(F.col("py"))).join(near, [key, "_band"]).groupBy(*columns).agg(F.sum(meets).alias("_n"), F.bool_or(on).alias("_on"))
    return hit.where("_n % 2 = 1 OR _on").drop("_n", "_on")


def edge_cells(e: DataFrame, key: str, size: float) -> DataFrame:
    """Edges cut into the columns of cells that they pass, with the cell columns' bounds."""
    lo, hi = F.least("x1", "x2"), F.greatest("x1", "x2")
    return e.withColumn("ix", F.explode(F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))))


def touched_count(e: DataFrame, key: str, size: float) -> DataFrame:
    """Number of cells that overlap the polygon with positive area: coverage above zero."""
    return coverage(e, key, size).where("covered > 1e-12").groupBy(key).agg(F.count("*").alias("touched"))


def coverage(e: DataFrame, key: str, size: float) -> DataFrame:
    """(key, ix, iy, covered): share of each cell's area inside the polygon.

    Signed trapezoids: an edge, cut to a column of cells, covers in each row of that column the area
    below it clamped to the row; summed over all edges this is exact. Rings wind as written in the
    first ring's sense; holes are turned to the other sense first. An edge gives a row only for the cells
    it passes and one mark below them, which a running sum down the column carries on; the wholly covered
    cells between two such rows come from that sum alone.
    """
    ring_area = e.groupBy(key, "ring").agg(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).alias("_s"))
    want = F.when(F.col("ring") == 0, F.lit(-1)).otherwise(F.lit(1))  # outer rings clockwise: area below counts positive
    turn = F.when(F.signum("_s") == want, 1.0).otherwise(-1.0)
    cut = edge_cells(e.where("x1 <> x2"), key, size).join(ring_area, [key, "ring"])
    a, z = F.greatest(F.least("x1", "x2"), F.col("ix") * size), F.least(F.greatest("x1", "x2"), (F.col("ix") + 1) * size)
    slope = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    cut = cut.withColumns({"_a": a, "_z": z, "_k": slope}).where("_z > _a").withColumns({
        "_ya": F.col("y1") + (F.col("_a") - F.col("x1")) * F.col("_k"), "_yz": F.col("y1") + (F.col("_z") - F.col("x1")) * F.col("_k"), "_way": F.signum(F.col("x2") - F.col("x1")) * turn,
    })
    row = lambda c: F.floor(c / size).cast("long")
    cut = cut.withColumn("_first", row(F.least("_ya", "_yz"))).withColumn("iy", F.explode(F.sequence(F.col("_first") - 1, row(F.greatest("_ya", "_yz")))))
    low = F.col("iy") * size
    lo_y, hi_y = F.least("_ya", "_yz") - low, F.greatest("_ya", "_yz") - low

    def ramp(t: Column) -> Column:  # integral of clamp(t, 0, size)
        return F.when(t <= 0, 0.0).when(t >= size, size * size / 2 + size * (t - size)).otherwise(t * t / 2)

    mean = F.when(hi_y - lo_y > 1e-12, (ramp(hi_y) - ramp(lo_y)) / (hi_y - lo_y)).otherwise(F.greatest(F.lit(0.0), F.least(lo_y, F.lit(size))))
    wide = F.col("_way") * (F.col("_z") - F.col("_a"))
    below = F.col("iy") < F.col("_first")  # from here on down the edge covers whole rows
    rows = cut.groupBy(key, "ix", "iy").agg((F.sum(F.when(below, 0.0).otherwise(wide * mean)) / (size * size)).alias("_part"), (F.sum(F.when(below, wide * size).otherwise(0.0)) / (size * size)).alias("_full"))
    down = W.partitionBy(key, "ix").orderBy(F.desc("iy"))
    rows = rows.withColumns({"_sum": F.sum("_full").over(down), "_next": F.lead("iy").over(down)})
    own = rows.select(key, "ix", "iy", (F.col("_part") + F.col("_sum")).alias("covered"))
    between = rows.where("_sum > 1e-12 AND _next < iy - 1").select(key, "ix", F.explode(F.sequence(F.col("_next") + 1, F.col("iy") - 1)).alias("iy"), F.col("_sum").alias("covered"))
    return own.unionByName(between).where("covered > 1e-12")


def context(cover: DataFrame, key: str) -> DataFrame:
    """Median and least coverage of a geometry's cells, and the share of cells on its edge."""
    edge = F.avg((F.col("covered") < 1 - 1e-9).cast("double"))
    return cover.groupBy(key).agg(F.percentile("covered", F.lit(0.5)).alias("median_cover"), F.min("covered").alias("min_cover"), edge.alias("edge_share"))


def regions_of(points: DataFrame, e: DataFrame, point: str, region: str, size: float, missing: int = -1) -> DataFrame:
    """(point, region, ambiguous): lowest region that holds the point, missing where none does.

    Points and region boxes meet by grid bucket, so no point sees a region whose box is elsewhere.
    """
    b = boxes(e, region)
    spans = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size).cast("long"), F.floor(F.col(hi) / size).cast("long"))
    b = b.select(region, "x_min", "x_max", "y_min", "y_max", F.explode(spans("x_min", "x_max")).alias("_gx"), spans("y_min", "y_max").alias("_ys")).withColumn("_gy", F.explode("_ys"))
    p = points.withColumns({"_gx": F.floor(F.col("px") / size).cast("long"), "_gy": F.floor(F.col("py") / size).cast("long")})
    near = p.join(b, ["_gx", "_gy"]).where("px BETWEEN x_min AND x_max AND py BETWEEN y_min AND y_max").select(point, "px", "py", region)
    got = inside(near, e, [point, region], region, size).groupBy(point).agg(F.min(region).alias(region), (F.count("*") > 1).alias("ambiguous"))
    return points.select(point).join(got, point, "left").select(point, F.coalesce(region, F.lit(missing)).alias(region), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def lattice(spark, west: float, south: float, columns: int, rows: int, size: float) -> DataFrame:
    """Every cell centre of a projected box, from a range: nothing is listed on the driver."""
    r = spark.range(columns * rows)
    ix, iy = F.col("id") % columns, F.floor(F.col("id") / columns)
    return r.select("id", ix.alias("ix"), iy.alias("iy"), (F.lit(west) + (ix + 0.5) * size).alias("px"), (F.lit(south) + (iy + 0.5) * size).alias("py"))


#: Cells of a lattice that one row stands for before they are made.
STRIP = 4096


def envelope_lattice(e: DataFrame, key: str, size: float) -> DataFrame:
    """(key, ix, iy, px, py): the lattice's cell centres in each shape's envelope.

    Strips of a column are spread before they become cells, so a large shape or a tall column is many tasks. Their number of tasks is
    given, as Spark would merge rows as small as strips into one task by their bytes, and all cells would be made there.
    """
    first = lambda c: F.ceil(F.col(c) / size - 0.5).cast("long")
    last = lambda c: F.floor(F.col(c) / size - 0.5).cast("long")
    some = lambda lo, hi, step=1: F.explode(F.when(hi >= lo, F.sequence(lo, hi, F.lit(step).cast("long"))))
    columns = boxes(e, key).select(key, first("y_min").alias("_lo"), last("y_max").alias("_hi"), some(first("x_min"), last("x_max")).alias("ix"))
    strips = columns.select(key, "ix", "_hi", some(F.col("_lo"), F.col("_hi"), STRIP).alias("_lo"))
    strips = strips.repartition(spread_over(e.sparkSession), key, "ix", "_lo")
    cells = strips.select(key, "ix", some(F.col("_lo"), F.least(F.col("_hi"), F.col("_lo") + STRIP - 1)).alias("iy"))
    return cells.select(key, "ix", "iy", ((F.col("ix") + 0.5) * size).alias("px"), ((F.col("iy") + 0.5) * size).alias("py"))


def candidate_frame(centres: DataFrame, boundary: DataFrame, country: str, land: Column, excluded: dict[str, list[int]], regions: DataFrame, region: str, size: float) -> DataFrame:
    """Every centre with its outcome: outside_boundary, the reason its land cover is excluded for, missing_region, or candidate.

    Reasons go in this order, so each centre counts once; a centre without a land-cover class has the reason no_land_cover. centres as of
    envelope_lattice; boundary and regions are edges. A point on several regions takes the lowest and is marked ambiguous.
    Only centres inside their boundary and on wanted land look for a region. Group by country and outcome for the counters.
    Cells are small rows that sorts and maps make large, so the shuffles in which they meet keep their number of tasks.
    """
    cell, tasks = [country, "ix", "iy"], spread_over(centres.sparkSession)
    within = inside(centres, boundary, cell, country, size).select(*cell).distinct().withColumn("_in", F.lit(True))
    reason = F.when(F.col("_in").isNull(), "outside_boundary").when(F.col("_land").isNull(), "no_land_cover")
    for name, classes in excluded.items():
        reason = reason.when(F.col("_land").isin(classes), name)
    judged = centres.repartition(tasks, *cell).withColumn("_land", land).join(within, cell, "left").withColumn("_why", reason)
    named = judged.where("_why IS NULL").select(F.struct(*cell).alias("_cell"), "px", "py").repartition(tasks, "_cell")
    found = regions_of(named, regions, "_cell", region, size).where(F.col(region) >= 0).select(*[F.col("_cell")[c].alias(c) for c in cell], region, "ambiguous")
    out = judged.join(found, cell, "left")
    outcome = F.coalesce("_why", F.when(F.col(region).isNull(), "missing_region").otherwise("candidate"))
    return out.select(*cell, "px", "py", F.col("_land").alias("land"), region, F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), outcome.alias("outcome"))


def _occupied(e: DataFrame, key: str) -> DataFrame:
    """Edges with the cells (ix, iy) of a grid of their own geometry that they pass: about as many cells as the root of its edges on each side."""
    ends = [F.least("x1", "x2"), F.greatest("x1", "x2"), F.least("y1", "y2"), F.greatest("y1", "y2")]
    box = e.groupBy(key).agg(F.min(ends[0]).alias("_x0"), F.max(ends[1]).alias("_x9"), F.min(ends[2]).alias("_y0"), F.max(ends[3]).alias("_y9"), F.count("*").alias("_e"))
    side = F.greatest(F.col("_x9") - F.col("_x0"), F.col("_y9") - F.col("_y0"))
    box = box.withColumn("_s", F.greatest(side / F.sqrt("_e"), F.lit(1e-12))).select(key, "_x0", "_y0", "_s")
    cell = lambda v, start: F.floor((v - F.col(start)) / F.col("_s")).cast("long")
    columns = e.join(box, key).withColumn("ix", F.explode(F.sequence(cell(ends[0], "_x0"), cell(ends[1], "_x0"))))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    near, far = F.col("_x0") + F.col("ix") * F.col("_s"), F.col("_x0") + (F.col("ix") + 1) * F.col("_s")
    at = lambda x: F.when(dx == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.col("x1")) / F.when(dx != 0, dx).otherwise(1.0))))
    t1, t2 = at(near), F.when(dx == 0, 1.0).otherwise(at(far))
    ya, yb = F.col("y1") + t1 * dy, F.col("y1") + t2 * dy
    return columns.withColumn("iy", F.explode(F.sequence(cell(F.least(ya, yb), "_y0"), cell(F.greatest(ya, yb), "_y0"))))


def edge_distance(points: DataFrame, e: DataFrame, point: str, key: str) -> DataFrame:
    """(point, key, distance) to the nearest edge of the geometry with the point's key.

    Each geometry has a grid of its own with about as many cells as the root of its edges on a side. A point first meets the occupied cells: the least of
    their greatest distances bounds its distance, and only cells that begin within the bound give their edges. So a point looks at
    about the root of the edges, not at all of them, however far away it is.
    """
    passed = _occupied(e, key)
    cells = passed.select(key, "ix", "iy", "_x0", "_y0", "_s").distinct()
    low, high = lambda i, z: F.col(z) + F.col(i) * F.col("_s"), lambda i, z: F.col(z) + (F.col(i) + 1) * F.col("_s")
    gap = lambda p, i, z: F.greatest(F.lit(0.0), low(i, z) - F.col(p), F.col(p) - high(i, z))
    reach = lambda p, i, z: F.greatest(F.abs(F.col(p) - low(i, z)), F.abs(F.col(p) - high(i, z)))
    met = points.select(point, key, "px", "py").join(cells, key)
    bound = met.groupBy(point, key).agg((F.min(F.hypot(reach("px", "ix", "_x0"), reach("py", "iy", "_y0"))) * (1 + 1e-9)).alias("_most"))
    kept = met.join(bound, [point, key]).where(F.hypot(gap("px", "ix", "_x0"), gap("py", "iy", "_y0")) <= F.col("_most")).select(point, key, "px", "py", "ix", "iy")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = ((F.col("px") - F.col("x1")) * dx + (F.col("py") - F.col("y1")) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-300))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    d = F.hypot(F.col("px") - (F.col("x1") + t * dx), F.col("py") - (F.col("y1") + t * dy))
    return kept.join(passed.select(key, "ix", "iy", "x1", "y1", "x2", "y2"), [key, "ix", "iy"]).groupBy(point, key).agg(F.min(d).alias("distance"))


def square_wkt(ix: Column, iy: Column, cells: int, size: float) -> Column:
    """Square of an odd number of cells around a cell."""
    h = cells // 2
    x0, y0, x1, y1 = (ix - h) * size, (iy - h) * size, (ix + h + 1) * size, (iy + h + 1) * size
    return F.format_string("POLYGON ((%.1f %.1f, %.1f %.1f, %.1f %.1f, %.1f %.1f, %.1f %.1f))", *(c.cast("double") for c in (x0, y0, x1, y0, x1, y1, x0, y1, x0, y0)))


def canonical_hash(e: DataFrame, key: str) -> DataFrame:
    """Digest of the rings, each turned one way, begun at its least vertex, and sorted."""
    area = e.groupBy(key, "ring").agg(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).alias("_s"), F.count("*").alias("_n"))
    v = e.join(area, [key, "ring"]).withColumn("_i", F.when(F.col("_s") >= 0, F.col("seq") - 1).otherwise(F.col("_n") - F.col("seq")))
    w = W.partitionBy(key, "ring")
    first = F.min_by("_i", F.struct("x1", "y1", "_i")).over(w)
    v = v.withColumn("_i", F.pmod(F.col("_i") - first, F.col("_n")))
    text = F.transform(F.array_sort(F.collect_list(F.struct("_i", "x1", "y1"))), lambda p: F.format_string("%.9f %.9f", p["x1"], p["y1"]))
    rings = v.groupBy(key, "ring").agg(F.array_join(text, ",").alias("t"))
    return rings.groupBy(key).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("t")), ";"), 256).alias("geometry_sha256"))


def bounds_audit(df: DataFrame, e: DataFrame, key: str, lon: str, lat: str, tolerance: float = 1e-9) -> DataFrame:
    """(key, coordinate_status, crosses_zone): whether the given point lies in the geometry's box, and whether that box spans UTM zones."""
    b = boxes(e, key)
    ok = F.col(lon).between(F.col("x_min") - tolerance, F.col("x_max") + tolerance) & F.col(lat).between(F.col("y_min") - tolerance, F.col("y_max") + tolerance)
    zone = lambda c: F.floor((F.col(c) + 180) / 6)
    return df.join(b, key).select(key, F.when(ok, "valid").otherwise("outside_bounds").alias("coordinate_status"), (zone("x_min") != zone("x_max")).alias("crosses_zone"))


def field_pixels(df: DataFrame, key: str, size: float, wkt: str = "wkt", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(fields with audit columns, invalid ones kept; membership with overlap and conflict counts)."""
    e = edges(df, key, wkt)
    member = rasterised(e, key, size).join(df.select(key, label), key)
    shared = member.groupBy("ix", "iy").agg(F.count_distinct(key).cast("int").alias("overlap_field_count"), (F.count_distinct(label) > 1).alias("label_conflict"))
    member = member.join(shared, ["ix", "iy"])
    counts = member.groupBy(key).agg(F.count("*").alias("pixel_count"))
    out = df.withColumn("geometry_status", F.coalesce(geometry_status(F.col(wkt)), F.lit("valid"))).join(boxes(e, key).select(key, "area"), key, "left").join(counts, key, "left")
    out = out.join(touched_count(e, key, size), key, "left").join(canonical_hash(e, key), key, "left")
    dup = W.partitionBy(F.coalesce("geometry_sha256", F.col(key).cast("string")))
    return out.withColumns({"pixel_count": F.coalesce("pixel_count", F.lit(0)), "duplicate_count": F.count("*").over(dup), "duplicate_ordinal": F.row_number().over(dup.orderBy(key)) - 1}), member
