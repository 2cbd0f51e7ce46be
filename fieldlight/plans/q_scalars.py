"""Queries of projections and scalar functions (B)."""

from pyspark.sql import functions as F

from ..functions import calendar, grid, hashing, radiometry, scalars, vectors
from . import inputs
from .inputs import CANDIDATES, ITEMS, OBSERVATIONS, VECTORS, WINDOWED
from .registry import query


def r6(c):
    return F.round(c, 6)


@query("b1_stable_ids", f"WITH {CANDIDATES} SELECT candidate_id, substr(sha256(country || ':' || candidate_id || ':2024'), 1, 24) AS sample_id, substr(sha256(country || ':' || candidate_id || ':2024:s2'), 1, 28) AS task_id FROM candidates")
def b1(spark, sf):
    return inputs.candidates(spark, sf).select("candidate_id", hashing.stable_id("country", "candidate_id", F.lit("2024")).alias("sample_id"), hashing.stable_id("country", "candidate_id", F.lit("2024"), F.lit("s2"), length=28).alias("task_id"))


@query("b2_unit_interval", f"WITH {CANDIDATES} SELECT candidate_id, CAST('0x' || substr(sha256('7:' || candidate_id), 1, 16) AS UBIGINT)::DOUBLE / 18446744073709551616 AS u FROM candidates")
def b2(spark, sf):
    return inputs.candidates(spark, sf).select("candidate_id", hashing.unit_interval(F.lit("7"), "candidate_id").alias("u"))


@query("b3_hash_rank", f"WITH {CANDIDATES} SELECT candidate_id, CAST(CAST('0x' || substr(sha256('rank:' || candidate_id), 1, 16) AS UBIGINT) AS VARCHAR) AS rank FROM candidates")
def b3(spark, sf):
    return inputs.candidates(spark, sf).select("candidate_id", hashing.hash_rank(F.lit("rank"), "candidate_id").cast("string").alias("rank"))


@query("b4_day_arithmetic", "SELECT event_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch_day, CAST(dayofyear(ts) AS INTEGER) AS day_of_year, CAST(ts AS DATE) AS day FROM events")
def b4(spark, sf):
    e = inputs.table(spark, sf, "events").select("event_id", calendar.epoch_day("ts").alias("epoch_day"), F.dayofyear("ts").alias("day_of_year"))
    return e.withColumn("day", F.date_from_unix_date("epoch_day"))


_ISO_SQL = """WITH t AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS base, event_id % 4 AS kind, ts FROM events)
SELECT event_id, CASE kind WHEN 0 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) WHEN 1 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 7200 END AS seconds,
 CASE WHEN kind IN (0, 1) THEN NULL ELSE 'no_zone_or_malformed' END AS reason FROM t"""


@query("b5_iso_parse", _ISO_SQL)
def b5(spark, sf):
    e = inputs.table(spark, sf, "events")
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.concat(base, F.lit("Z"))).when(kind == 1, F.concat(base, F.lit("+02:00"))).when(kind == 2, base).otherwise("bad")
    ts, reason = calendar.iso_instant("text")
    return e.select("event_id", text.alias("text")).select("event_id", F.unix_seconds(ts).alias("seconds"), reason.alias("reason"))


@query("b6_lattice", "SELECT n_nationkey, CAST(ceil((n_nationkey - 12.3::DOUBLE) / 0.7::DOUBLE - 0.5::DOUBLE) AS BIGINT) AS first, CAST(floor((n_nationkey + 2.9::DOUBLE) / 0.7::DOUBLE - 0.5::DOUBLE) AS BIGINT) AS last, round((ceil((n_nationkey - 12.3::DOUBLE) / 0.7::DOUBLE - 0.5::DOUBLE) + 0.5::DOUBLE) * 0.7::DOUBLE, 6) AS centre FROM nation")
def b6(spark, sf):
    lo, hi = grid.lattice_bounds(F.col("n_nationkey") - 12.3, F.col("n_nationkey") + 2.9, 0.7)
    return inputs.table(spark, sf, "nation").select("n_nationkey", lo.alias("first"), hi.alias("last")).withColumn("centre", r6(grid.centre_of(F.col("first"), 0.7)))


@query("b7_grid_ids", f"WITH {CANDIDATES} SELECT candidate_id, country || '-' || CAST(floor(longitude / 10) AS BIGINT) || '-' || CAST(floor(latitude / 10) AS BIGINT) AS block10, country || '-' || CAST(floor(longitude / 5) AS BIGINT) || '-' || CAST(floor(latitude / 5) AS BIGINT) AS block5 FROM candidates")
def b7(spark, sf):
    x, y = F.col("longitude"), F.col("latitude")
    return inputs.candidates(spark, sf).select("candidate_id", grid.block_id(F.col("country"), x, y, 10).alias("block10"), grid.block_id(F.col("country"), x, y, 5).alias("block5"))


_TILE_SQL = f"""WITH {CANDIDATES}, t AS (SELECT candidate_id, CAST(ceil(latitude / 3) * 3 - 3 AS INTEGER) AS s, CAST(floor(longitude / 3) * 3 AS INTEGER) AS w FROM candidates)
SELECT candidate_id, CASE WHEN s < 0 THEN 'S' ELSE 'N' END || lpad(CAST(abs(s) AS VARCHAR), 2, '0') || CASE WHEN w < 0 THEN 'W' ELSE 'E' END || lpad(CAST(abs(w) AS VARCHAR), 3, '0') AS tile, w AS west, s AS south, w + 3 AS east, s + 3 AS north FROM t"""


@query("b8_tile3", _TILE_SQL)
def b8(spark, sf):
    t = inputs.candidates(spark, sf).select("candidate_id", grid.tile3_id(F.col("longitude"), F.col("latitude")).alias("tile"))
    return t.select("candidate_id", "tile", *grid.tile3_bounds(F.col("tile")))


@query("b9_great_circle", f"WITH {CANDIDATES} SELECT candidate_id, round(2 * 6371008.8::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(0.0::DOUBLE - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(0.0::DOUBLE)) * pow(sin(radians(30.0::DOUBLE - longitude) / 2), 2)))), 3) AS metres FROM candidates")
def b9(spark, sf):
    return inputs.candidates(spark, sf).select("candidate_id", F.round(grid.great_circle_m(F.col("longitude"), F.col("latitude"), F.lit(30.0), F.lit(0.0)), 3).alias("metres"))


@query("b10_utm_zone", f"WITH {CANDIDATES} SELECT candidate_id, CASE WHEN latitude BETWEEN -80 AND 84 THEN CAST(CASE WHEN latitude >= 0 THEN 32600 ELSE 32700 END + floor((least(longitude, 179.999999999::DOUBLE) + 180) / 6) + 1 AS INTEGER) END AS epsg FROM candidates")
def b10(spark, sf):
    return inputs.candidates(spark, sf).select("candidate_id", grid.utm_epsg(F.col("longitude"), F.col("latitude")).cast("int").alias("epsg"))


@query("b11_utm_round_trip", f"WITH {CANDIDATES} SELECT candidate_id, round(longitude, 6) AS lon, round(latitude, 6) AS lat, true AS inside FROM candidates WHERE latitude BETWEEN -80 AND 84")
def b11(spark, sf):
    c = inputs.candidates(spark, sf).withColumn("epsg", grid.utm_epsg(F.col("longitude"), F.col("latitude"))).where("epsg IS NOT NULL")
    e, n = grid.to_utm(F.col("longitude"), F.col("latitude"), F.col("epsg"))
    c = c.select("candidate_id", "epsg", e.alias("e"), n.alias("n"))
    lon, lat = grid.from_utm(F.col("e"), F.col("n"), F.col("epsg"))
    return c.select("candidate_id", r6(lon).alias("lon"), r6(lat).alias("lat"), ((F.col("e") > 100000) & (F.col("e") < 900000)).alias("inside"))


@query("b12_snap_centre", "SELECT l_orderkey, l_linenumber, floor(round_even(l_extendedprice, 3) / 10) * 10 + 5 AS x, ceil(round_even(l_extendedprice, 3) / 10) * 10 - 5 AS y FROM lineitem")
def b12(spark, sf):
    x, y = grid.snap_centre(F.col("l_extendedprice"), F.col("l_extendedprice"))
    return inputs.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"))


@query("b13_pixel_chunks", f"WITH {VECTORS} SELECT row_id, 'utm-32636-10m-' || (x - 10) * 31 || '-' || y AS pixel_id, CAST(floor((x - 10) * 31 / 256) AS BIGINT) AS chunk_x, CAST(floor(y / 256) AS BIGINT) AS chunk_y, CAST(255 - (y - floor(y / 256) * 256) AS BIGINT) AS local_row, CAST((x - 10) * 31 - floor((x - 10) * 31 / 256) * 256 AS BIGINT) AS local_col FROM vectors")
def b13(spark, sf):
    x = ((F.col("x") - 10) * 31).alias("x")
    v = inputs.vectors(spark, sf).select("row_id", x, "y")
    return v.select("row_id", grid.pixel_id(F.lit(32636), F.col("x"), F.col("y")).alias("pixel_id"), *grid.chunk_local(F.col("x"), F.col("y")))


@query("b14_raster_windows", f"WITH {VECTORS}, g AS (SELECT field, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM vectors GROUP BY field) SELECT row_id, x1 - x0 + 1 AS width, y1 - y0 + 1 AS height, y1 - y AS local_row, x - x0 AS local_col FROM vectors JOIN g USING (field)")
def b14(spark, sf):
    from ..operators.windows import raster_window

    return raster_window(inputs.vectors(spark, sf), ["field"], "x", "y").select("row_id", "width", "height", "local_row", "local_col")


@query("b15_antimeridian", f"""WITH {ITEMS}, i AS (SELECT item_id, acquired, doc, west + 35 AS w, CASE WHEN east + 35 > 180 THEN east + 35 - 360 ELSE east + 35 END AS e, south, north FROM items),
p AS (SELECT item_id, doc, w AS west, CASE WHEN w > e THEN 180.0 ELSE e END AS east, south, north FROM i WHERE w <= 180 UNION ALL SELECT item_id, doc, -180.0, e, south, north FROM i WHERE w > e AND w <= 180)
SELECT item_id, doc, west, south, east, north FROM p""")
def b15(spark, sf):
    i = inputs.items(spark, sf).withColumn("w", F.col("west") + 35).withColumn("e", F.col("east") + 35).where("w <= 180")
    i = i.withColumn("e", F.when(F.col("e") > 180, F.col("e") - 360).otherwise(F.col("e")))
    parts = grid.antimeridian_parts(F.col("w"), F.col("south"), F.col("e"), F.col("north"))
    return i.select("item_id", "doc", F.explode(parts).alias("b")).select("item_id", "doc", "b.*")


@query("b16_harmonise", f"WITH {OBSERVATIONS} SELECT obs_id, CAST(CASE WHEN value * 20 >= 1000 THEN value * 20 - 1000 ELSE value * 20 END AS DOUBLE) AS raw, CAST(trunc(CASE WHEN value * 20 >= 1000 THEN value * 20 - 1000 ELSE value * 20 END) AS INTEGER) AS b1, CAST(trunc(k) AS INTEGER) AS b2 FROM observations")
def b16(spark, sf):
    o = inputs.observations(spark, sf)
    b = radiometry.harmonised(F.array(F.col("value") * 20, F.col("k")), F.col("acquired"))
    raw = F.when(F.col("value") * 20 >= 1000, F.col("value") * 20 - 1000).otherwise(F.col("value") * 20)
    return o.select("obs_id", raw.alias("raw"), b[0].alias("b1"), b[1].alias("b2"))


@query("b17_amplitude", f"WITH {OBSERVATIONS} SELECT obs_id, CAST(trunc(CASE WHEN value > 0 THEN least(greatest((20 * log10(value / 100) + 50) * 200, 0), 32767) ELSE 0 END) AS INTEGER) AS vv, CAST(trunc(CASE WHEN k > 0 THEN least(greatest((20 * log10(k / 1000) + 50) * 200, 0), 32767) ELSE 0 END) AS INTEGER) AS vh FROM observations")
def b17(spark, sf):
    b = radiometry.amplitude_scaled(F.array(F.col("value") / 100, F.col("k") / 1000))
    return inputs.observations(spark, sf).select("obs_id", b[0].alias("vv"), b[1].alias("vh"))


@query("b18_validity", f"WITH {OBSERVATIONS} SELECT obs_id, CAST(k AS INTEGER) % 12 NOT IN (0, 1, 2, 3, 8, 9) AS s2_valid, (value <> 0 OR k <> 0) AS s1_valid FROM observations")
def b18(spark, sf):
    return inputs.observations(spark, sf).select("obs_id", radiometry.class_valid(F.col("k").cast("int") % 12).alias("s2_valid"), radiometry.any_nonzero(F.col("bands")).alias("s1_valid"))


@query("b19_standardise", f"WITH {OBSERVATIONS} SELECT obs_id, round((value - 50) / (30 + 1e-9), 6) AS z1, round((k - 45.5) / (26 + 1e-9), 6) AS z2 FROM observations")
def b19(spark, sf):
    z = radiometry.standardised(F.col("bands"), [50.0, 45.5], [30.0, 26.0])
    return inputs.observations(spark, sf).select("obs_id", r6(z[0]).alias("z1"), r6(z[1]).alias("z2"))


@query("b20_ratio_index", f"WITH {OBSERVATIONS} SELECT obs_id, round(CASE WHEN abs(value + k) > 1e-6 THEN (value - k) / (value + k) END, 6) AS ndvi, round(value / 10000, 6) AS reflectance, round(k / 200 - 50, 6) AS db FROM observations")
def b20(spark, sf):
    return inputs.observations(spark, sf).select("obs_id", r6(radiometry.ratio(F.col("value"), F.col("k"))).alias("ndvi"), r6(F.col("value") / 10000).alias("reflectance"), r6(radiometry.decibels(F.col("k"))).alias("db"))


@query("b21_bucket_size", "SELECT p_partkey, CAST(greatest(8, least(256, ceil((p_size * 7 % 300) / 8.0) * 8)) AS INTEGER) AS bucket FROM part")
def b21(spark, sf):
    return inputs.table(spark, sf, "part").select("p_partkey", scalars.bucket_size(F.col("p_size") * 7 % 300).alias("bucket"))


@query("b22_window_columns", "SELECT o_orderkey, o_custkey % 400 AS days, o_custkey % 400 BETWEEN 1 AND 366 AS in_contract FROM orders")
def b22(spark, sf):
    o = inputs.table(spark, sf, "orders").select("o_orderkey", F.unix_date(F.to_date("o_orderdate")).alias("s"), "o_custkey").withColumn("e", F.col("s") + F.col("o_custkey") % 400)
    return o.select("o_orderkey", calendar.duration_days("s", "e").alias("days"), calendar.in_contract("s", "e").alias("in_contract"))


@query("b23_relative_day", f"WITH {OBSERVATIONS} SELECT obs_id, CAST(CASE WHEN valid THEN epoch_day - 19723 ELSE 0 END AS INTEGER) AS day FROM observations")
def b23(spark, sf):
    return inputs.observations(spark, sf).withColumn("start", F.lit(19723)).select("obs_id", calendar.relative_day("epoch_day", "start", "valid").alias("day"))


_COUNTS = f"WITH {OBSERVATIONS}, c AS (SELECT sample_id, count(*) FILTER (valid) AS a, count(*) FILTER (kind = 'purchase') AS b, max(epoch_day) - min(epoch_day) + 1 AS days FROM observations GROUP BY sample_id)"


def _counts(spark, sf):
    o = inputs.observations(spark, sf)
    return o.groupBy("sample_id").agg(F.count_if("valid").alias("a"), F.count_if(F.col("kind") == "purchase").alias("b"), (F.max("epoch_day") - F.min("epoch_day") + 1).alias("days"))


@query("b24_context_features", _COUNTS + " SELECT sample_id, round(ln(1 + days) / ln(367), 6) AS duration_feature, round(ln(1 + a) / ln(65), 6) AS a_feature, round(ln(1 + b) / ln(65), 6) AS b_feature, CAST(a = 0 AS INTEGER) AS a_empty, CAST(b = 0 AS INTEGER) AS b_empty FROM c")
def b24(spark, sf):
    c = _counts(spark, sf)
    out = c.select("sample_id", *calendar.context_features(F.col("days"), F.col("a"), F.col("b")))
    return out.withColumns({k: r6(F.col(k)) for k in ("duration_feature", "a_feature", "b_feature")})


@query("b25_evidence_weight", _COUNTS + " SELECT sample_id, round(least(1.0::DOUBLE, days / 90.0::DOUBLE) * least(1.0::DOUBLE, greatest(a, b) / 10.0::DOUBLE), 6) AS weight FROM c")
def b25(spark, sf):
    return _counts(spark, sf).select("sample_id", r6(calendar.evidence_weight(F.col("days"), F.col("a"), F.col("b"))).alias("weight"))


@query("b26_unit_vectors", f"WITH {VECTORS} SELECT row_id, len(v) = 64 AS ok, round(list_sum(list_transform(v, lambda e: e / sqrt(list_dot_product(v, v)))), 6) AS total, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS head FROM vectors")
def b26(spark, sf):
    v = inputs.vectors(spark, sf).select("row_id", vectors.is_finite(F.col("v"), 64).alias("ok"), vectors.unit(F.col("v")).alias("u"))
    return v.select("row_id", "ok", r6(F.aggregate("u", F.lit(0.0), lambda s, x: s + x)).alias("total"), r6(F.col("u")[0]).alias("head"))


@query("b27_vector_algebra", f"WITH {VECTORS} SELECT a.row_id, round(list_dot_product(a.v, b.v), 6) AS dot, round(sqrt(list_dot_product(a.v, a.v)), 6) AS norm, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)), 6) AS cosine, round(sqrt(greatest(0, 2 - 2 * list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)))), 6) AS chord, round(list_distance(a.v, b.v), 6) AS distance FROM vectors a JOIN vectors b ON b.row_id = a.row_id + 1")
def b27(spark, sf):
    a = inputs.vectors(spark, sf).select("row_id", "v")
    b = a.select((F.col("row_id") - 1).alias("row_id"), F.col("v").alias("u"))
    v, u = F.col("v"), F.col("u")
    return a.join(b, "row_id").select("row_id", r6(vectors.dot(v, u)).alias("dot"), r6(vectors.norm(v)).alias("norm"), r6(vectors.cosine(v, u)).alias("cosine"), r6(vectors.chord(v, u)).alias("chord"), r6(vectors.distance(v, u)).alias("distance"))


@query("b28_label_targets", f"WITH {inputs.FIELDS} SELECT field_uid, CAST(contains(landcover, '/') AS INTEGER) AS is_mixture, CAST(list_contains(string_split(landcover, '/'), 'beans') AS INTEGER) AS has_part FROM fields")
def b28(spark, sf):
    return inputs.fields(spark, sf).select("field_uid", *scalars.mixture_targets(F.col("landcover"), "beans"))


@query("b29_count_bins", "SELECT p_partkey, CASE WHEN n <= 1 THEN '1' WHEN n = 2 THEN '2' WHEN n <= 4 THEN '3-4' WHEN n <= 8 THEN '5-8' WHEN n <= 16 THEN '9-16' WHEN n <= 32 THEN '17-32' WHEN n <= 64 THEN '33-64' ELSE '65+' END AS bin, regexp_replace(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM (SELECT *, p_partkey % 90 AS n FROM part)")
def b29(spark, sf):
    return inputs.table(spark, sf, "part").select("p_partkey", scalars.count_bin(F.col("p_partkey") % 90).alias("bin"), scalars.slug(F.concat_ws(" ", "p_brand", "p_name")).alias("slug"))


@query("b30_redact_queries", r"SELECT page_id, substr(regexp_replace(url, '(https?://[^\s?]+)\?\S*', '\1?redacted', 'g'), 1, 60) AS url FROM pages")
def b30(spark, sf):
    return inputs.table(spark, sf, "pages").select("page_id", scalars.without_queries(F.col("url"), 60).alias("url"))


@query("b31_clean_text", "SELECT doc_id, sha256(trim(coalesce(text, ''))) AS cleaned_sha256, length(trim(coalesce(text, ''))) AS chars, trim(coalesce(text, '')) <> '' AS filled FROM documents")
def b31(spark, sf):
    text = scalars.clean_text(F.col("text"))
    return inputs.table(spark, sf, "documents").select("doc_id", F.sha2(text, 256).alias("cleaned_sha256"), F.length(text).cast("long").alias("chars"), (text != "").alias("filled"))


@query("b32_stage_deltas", f"WITH {WINDOWED}, s AS (SELECT field, w, avg(v[2]) AS m FROM windowed GROUP BY field, w) SELECT a.field, round(b.m - a.m, 6) AS d21, round(c.m - b.m, 6) AS d32 FROM s a JOIN s b ON b.field = a.field AND b.w = 2 JOIN s c ON c.field = a.field AND c.w = 3 WHERE a.w = 1")
def b32(spark, sf):
    p = inputs.windowed_vectors(spark, sf).groupBy("field").pivot("w", [1, 2, 3]).agg(F.avg(F.col("v")[1]))
    return p.select("field", r6(F.col("2") - F.col("1")).alias("d21"), r6(F.col("3") - F.col("2")).alias("d32"))


@query("b33_canonical_json", "SELECT s_suppkey, sha256('{\"key\":' || s_suppkey || ',\"name\":\"' || s_name || '\",\"nation\":' || s_nationkey || '}') AS digest FROM supplier")
def b33(spark, sf):
    j = hashing.canonical_json(nation="s_nationkey", key="s_suppkey", name="s_name")
    return inputs.table(spark, sf, "supplier").select("s_suppkey", F.sha2(j, 256).alias("digest"))


@query("b34_share_guard", f"WITH {OBSERVATIONS} SELECT obs_id, round(CASE WHEN a + b > 1e-12 THEN a / (a + b) ELSE 0.5 END, 6) AS share FROM (SELECT obs_id, CASE WHEN valid THEN value ELSE 0 END AS a, CASE WHEN valid THEN k ELSE 0 END AS b FROM observations)")
def b34(spark, sf):
    z = lambda c: F.when(F.col("valid"), F.col(c)).otherwise(0.0)
    return inputs.observations(spark, sf).select("obs_id", r6(scalars.share(z("value"), z("k"))).alias("share"))
