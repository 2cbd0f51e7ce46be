"""Join operators: bucketed range joins, offset and neighbourhood joins, lookups with fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import great_circle_m


def spread_over(spark) -> int:
    """Tasks of a shuffle that is not to be merged by the bytes of its rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """df shuffled by keys into the set number of tasks, for sorts and maps that take much more room than the rows' bytes.

    Joins and groups by these keys and others need no further shuffle.
    """
    return df.repartition(spread_over(df.sparkSession), *keys)


def cross_small(df: DataFrame, values: list[tuple[str, object]] | list, name: str) -> DataFrame:
    """Rows times a short literal list, as an explode: no join at all."""
    return df.withColumn(name, F.explode(F.array(*map(F.lit, values))))


def point_in_boxes(points: DataFrame, items: DataFrame, keys: list[str], lon: str, lat: str, size: float = 10.0) -> DataFrame:
    """Points joined to boxes (west, south, east, north) that hold them; both sides meet by keys and grid cell.

    A box that ends in the cell after its lower corner's at most is one row, in that corner's cell, and points go to the four cells whose
    boxes may reach them; only larger boxes are spread over the cells that they pass. Boxes stream past the points of a cell, which are fewer.
    """
    at = lambda v: F.floor(v / size).cast("long")
    w, s, e, n = (F.col(c) for c in ("west", "south", "east", "north"))
    cell = lambda x, y, large: F.struct(x.alias("_gx"), y.alias("_gy"), F.lit(large).alias("_large"))
    spread = F.flatten(F.transform(F.sequence(at(w), at(e)), lambda x: F.transform(F.sequence(at(s), at(n)), lambda y: cell(x, y, True))))
    own = F.when((at(e) - at(w) <= 1) & (at(n) - at(s) <= 1), F.array(cell(at(w), at(s), False))).otherwise(spread)
    x, y = at(F.col(lon)), at(F.col(lat))
    near = F.array(cell(x, y, True), *[cell(x - i, y - j, False) for i in (0, 1) for j in (0, 1)])
    hit = items.where((w <= e) & (s <= n)).select("*", F.inline(own)).join(points.select("*", F.inline(near)), [*keys, "_gx", "_gy", "_large"])
    return hit.where((F.col(lon) >= w) & (F.col(lon) <= e) & (F.col(lat) >= s) & (F.col(lat) <= n)).drop("_gx", "_gy", "_large")


def overlapping(windows: DataFrame, items: DataFrame, key: str, size: float = 15.0) -> DataFrame:
    """Boxes of one key that overlap with positive area; unknown boxes and boxes over the antimeridian stay.

    Both sides meet by key and grid cell, a pair in the cell of its overlap's lower corner; only boxes that stay in any case meet by key alone.
    """
    always = F.coalesce(F.col("west").isNull() | (F.col("west") > F.col("east")), F.lit(False))
    at = lambda c: F.floor(F.greatest(F.lit(-720.0), F.least(F.lit(720.0), c)) / size).cast("long")
    cells = lambda df, w, s, e, n: df.withColumn("_gx", F.explode(F.sequence(at(F.col(w)), at(F.col(e))))).withColumn("_gy", F.explode(F.sequence(at(F.col(s)), at(F.col(n)))))
    near = cells(windows, "w0", "s0", "w1", "s1").join(cells(items.where(~always), "west", "south", "east", "north"), [key, "_gx", "_gy"])
    ok = (F.col("w0") < F.col("east")) & (F.col("west") < F.col("w1")) & (F.col("s0") < F.col("north")) & (F.col("south") < F.col("s1"))
    corner = (F.col("_gx") == at(F.greatest("w0", "west"))) & (F.col("_gy") == at(F.greatest("s0", "south")))
    return near.where(ok & corner).drop("_gx", "_gy").unionByName(windows.join(items.where(always), key))


def _grid_pairs(own: DataFrame, far: DataFrame, keys: list[str], metres: float) -> DataFrame:
    """Rows of own (lon1, lat1) with those of far (lon2, lat2) of the same keys that may be nearer than metres.

    Every row of own goes into its cell, those of far also into the cells around. Cells are as high as the
    distance; near the poles, where cells of longitude get narrow, as wide as it needs.
    """
    size = metres / 111000.0
    row = lambda lat: F.floor(F.col(lat) / size).cast("long")
    # cells of one latitude row share a width that holds the distance at the row's poleward edge, one row further
    edge = lambda r: F.least(F.lit(89.9), F.greatest(F.abs(r * size), F.abs((r + 1) * size)) + size)
    width = lambda r: F.least(F.lit(360.0), size / F.cos(F.radians(edge(r))))
    column = lambda lon: F.floor((F.col(lon) + 180) / width(F.col("_gy"))).cast("long")
    own = own.withColumn("_gy", row("lat1")).withColumn("_gx", column("lon1"))
    far = far.withColumn("_gy", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: row("lat2") + d)))
    last = F.floor(F.lit(360.0) / width(F.col("_gy"))).cast("long")
    # two cells each way, around the globe: the last cell of a row may be a narrow rest
    at = column("lon2")
    far = far.withColumn("_gx", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda d: F.pmod(at + d, last + 1)))))
    return own.join(far, [*keys, "_gy", "_gx"]).drop("_gy", "_gx").withColumn("metres", great_circle_m(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")))


def too_close(points: DataFrame, key: str, lon: str, lat: str, metres: float, tolerance: float = 0.0) -> DataFrame:
    """Pairs (a, b), a < b, nearer than metres.

    A pair of places meets in one cell, so only pairs of keys with several places can repeat; no others are compared for that.
    """
    places = points.select(key, lon, lat).distinct()
    many = places.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    once, more = places.join(many, key, "left_anti"), places.join(many, key, "left_semi")
    side = lambda df, name, i: df.select(F.col(key).alias(name), F.col(lon).alias(f"lon{i}"), F.col(lat).alias(f"lat{i}"))
    met = lambda one, two: _grid_pairs(side(one, "a", 1), side(two, "b", 2), [], metres).where("a < b").select("a", "b", "metres")
    pairs = met(once, once).unionByName(met(more, places).unionByName(met(once, more)).distinct())
    return pairs.where(F.col("metres") < metres * (1 - tolerance))


def neighbours(df: DataFrame, keys: list[str], x: str, y: str, value: str) -> DataFrame:
    """Right and upper neighbours of each cell in its group, with both values."""
    step = F.explode(F.array(F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy")), F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dy"))))
    a = df.select(*keys, x, y, F.col(value).alias("a"), step.alias("_s")).withColumns({x: F.col(x) + F.col("_s.dx"), y: F.col(y) + F.col("_s.dy")}).drop("_s")
    return a.join(df.select(*keys, x, y, F.col(value).alias("b")), [*keys, x, y])


def pure_cells(df: DataFrame, x: str, y: str, kind: str, halo: int = 1) -> DataFrame:
    """Cells whose whole neighbourhood exists and has one class."""
    side = F.sequence(F.lit(-halo), F.lit(halo))
    spread = df.select(F.col(kind), F.col(x), F.col(y), F.explode(side).alias("dx")).withColumn("dy", F.explode(side))
    by = spread.groupBy((F.col(x) + F.col("dx")).alias(x), (F.col(y) + F.col("dy")).alias(y)).agg(F.count("*").alias("_n"), F.min(kind).alias("_a"), F.max(kind).alias("_b"))
    return by.where((F.col("_n") == (2 * halo + 1) ** 2) & (F.col("_a") == F.col("_b"))).select(x, y, F.col("_a").alias(kind))


def nearest(df: DataFrame, refs: DataFrame, keys: list[str], key: str, first: float = 50_000.0) -> DataFrame:
    """(key, metres, ref) of the nearest reference with the same keys; refs: keys, ref, rlon, rlat.

    Both sides meet by grid cell within a distance that grows fourfold for those that found nothing, so neither
    side is collected and no row sees all references. A row has a few distances to go; only the last one, for
    rows whose references are a quarter of the globe away, joins by keys alone.
    """
    far = refs.select(*keys, "ref", F.col("rlon").alias("lon2"), F.col("rlat").alias("lat2"))
    left = df.select(*keys, key, F.col("longitude").alias("lon1"), F.col("latitude").alias("lat1")).join(refs.select(*keys).distinct(), keys, "left_semi").persist()
    out, metres = None, first
    while True:
        last = metres >= 5_000_000
        if last:
            pairs = left.join(far, keys).withColumn("metres", great_circle_m(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")))
        else:
            pairs = _grid_pairs(left, far, keys, metres).where(F.col("metres") < metres)
        found = pairs.groupBy(key).agg(F.min(F.struct(F.round("metres", 3).alias("metres"), "ref")).alias("m")).select(key, "m.metres", "m.ref").persist()
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select(key), key, "left_anti").persist()
        if last or left.isEmpty():
            return out
        metres *= 4


def with_fallback(df: DataFrame, table: DataFrame, keys: list[str], narrow: str, value: str, least: int, count: str = "n") -> DataFrame:
    """value looked up by keys and narrow where that row has enough cases, else by keys alone (narrow is null there)."""
    fine = table.where(F.col(narrow).isNotNull() & (F.col(count) >= least)).select(*keys, narrow, F.col(value).alias("_f"))
    wide = table.where(F.col(narrow).isNull()).select(*keys, F.col(value).alias("_w"))
    return df.join(fine, [*keys, narrow], "left").join(wide, keys, "left").withColumn(value, F.coalesce("_f", "_w")).drop("_f", "_w")


def observations_in_windows(obs: DataFrame, windows: DataFrame, day: str, keys: list[str] | None = None, size: int = 30) -> DataFrame:
    """Observations times the half-open windows they lie in; both sides meet by a grid of days."""
    span = F.sequence(F.floor(F.col("start") / size).cast("long"), F.floor((F.col("end") - 1) / size).cast("long"))
    w = windows.where("end > start").withColumn("_g", F.explode(span))
    o = obs.withColumn("_g", F.floor(F.col(day) / size).cast("long"))
    return o.join(w, [*(keys or []), "_g"]).where((F.col(day) >= F.col("start")) & (F.col(day) < F.col("end"))).drop("_g")


def only_in_one(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides without the keys that are in both."""
    return a.join(b.select(key).distinct(), key, "left_anti"), b.join(a.select(key).distinct(), key, "left_anti")


def one_block_groups(df: DataFrame, group: str, block: str) -> DataFrame:
    """Rows of groups that touch one block only."""
    many = df.groupBy(group).agg(F.min(block).alias("_a"), F.max(block).alias("_b")).where("_a <> _b").select(group)
    return df.join(many, group, "left_anti")


def expansion(source: DataFrame, windows: list[int], scores: DataFrame, available: DataFrame, key: str, canonical: str, status: Column) -> DataFrame:
    """Every source row times window, left-joined to its canonical row's score and availability, with a status."""
    every = cross_small(source, windows, "w")
    out = every.join(scores.withColumnRenamed(key, canonical), [canonical, "w"], "left").join(available.withColumnRenamed(key, canonical), [canonical, "w"], "left")
    return out.withColumn("status", status)
