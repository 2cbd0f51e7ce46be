"""Queries of sampling, densities, mixtures and encoders (F17, F18, F38, F39, J)."""

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashing, vectors
from ..operators import aggregates, calls, encoding, geometry, joins, linear, mixture, mosaic, sampling
from . import inputs
from .inputs import CANDIDATES, OBSERVATIONS, VECTORS
from .q_geometry import POLYS, polys
from .q_relations import ALLOCATION
from .registry import query

RATIOS = {"train": 0.6, "validation": 0.2, "test": 0.2}
_U = "CAST('0x' || substr(sha256({}), 1, 16) AS UBIGINT)"
_SPLIT = "CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'validation' ELSE 'test' END"
_EACH = "each AS (SELECT * EXCLUDE (v), unnest(v) AS e, unnest(range(len(v))) AS d FROM vectors)"


def total(c):
    return F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6)


@query("f17_pooled_covariance", f"WITH {VECTORS}, {_EACH}, nf AS (SELECT crop, field, count(*) AS n FROM vectors GROUP BY ALL), nc AS (SELECT crop, count(*) AS f FROM nf GROUP BY crop), wt AS (SELECT row_id, 1.0::DOUBLE / ((SELECT count(*) FROM nc) * f * n) AS w FROM vectors JOIN nf USING (crop, field) JOIN nc USING (crop)), m AS (SELECT crop, d, sum(w * e) / sum(w) AS m FROM each JOIN wt USING (row_id) GROUP BY ALL), r AS (SELECT row_id, w, d, e - m AS r FROM each JOIN wt USING (row_id) JOIN m USING (crop, d)) SELECT CAST(a.d AS INTEGER) AS i, CAST(b.d AS INTEGER) AS j, round(sum(a.w * a.r * b.r), 6) + 0.0 AS cov FROM r a JOIN r b USING (row_id) GROUP BY ALL")
def f17(spark, sf):
    """Over all dimensions, crops equal, fields equal in a crop, rows in a field."""
    w = aggregates.balanced_weights(inputs.vectors(spark, sf), ["crop", "field"])
    m = linear.moments(w, ["crop"], "v", F.col("weight"))
    cell = m.select("mass", "total", F.posexplode("gram").alias("p", "x")).withColumn("_d", F.size("total"))
    cell = cell.withColumns({"i": F.floor(F.col("p") / F.col("_d")).cast("int"), "j": (F.col("p") % F.col("_d")).cast("int")})
    cell = cell.withColumn("x", F.col("x") - F.get("total", F.col("i")) * F.get("total", F.col("j")) / F.col("mass"))
    return cell.groupBy("i", "j").agg((F.round(F.sum("x") / F.sum("mass"), 6) + 0.0).alias("cov"))


@query("f18_weighted_pca")
def f18(spark, sf):
    v = inputs.vectors(spark, sf)
    w = aggregates.balanced_weights(v, ["crop", "field"])
    mean, axes, _ = linear.principal_axes(w, "v", 3, F.col("weight"))
    out = linear.scores_on(w, "v", mean, axes)
    return out.select("row_id", F.transform("pc", lambda x: F.round(x, 6)).alias("pc"), F.round("residual", 6).alias("residual"))


_F38 = f"""WITH {VECTORS}, p AS (SELECT row_id, crop, v, list_transform(v, lambda e, i: e + ((row_id + i - 1) % 5) * 0.01::DOUBLE) AS u FROM vectors),
q AS (SELECT row_id, crop, v, u, list_transform(v, lambda e: e / sqrt(list_dot_product(v, v))) AS s, list_transform(u, lambda e: e / sqrt(list_dot_product(u, u))) AS t FROM p),
co AS (SELECT crop, avg(1 - list_dot_product(s, t)) AS cosine_distance FROM q GROUP BY crop),
re AS (SELECT a.crop, avg((list_dot_product(a.s, b.s) - list_dot_product(a.t, b.t)) ** 2) AS relational FROM q a JOIN q b USING (crop) GROUP BY a.crop),
e AS (SELECT row_id, crop, unnest(v) AS x, unnest(u) AS y, unnest(range(len(v))) AS d FROM p),
z AS (SELECT row_id, crop, d, x - avg(x) OVER w AS x, (x - avg(x) OVER w) / greatest(stddev_pop(x) OVER w, 1e-4) AS zx, (y - avg(y) OVER w) / greatest(stddev_pop(y) OVER w, 1e-4) AS zy FROM e WINDOW w AS (PARTITION BY crop, d)),
cc AS (SELECT a.crop, a.d AS i, b.d AS j, avg(a.zx * b.zy) AS c, sum(a.x * b.x) / (count(*) - 1) AS k, avg(a.x * b.x) AS k0 FROM z a JOIN z b ON a.crop = b.crop AND a.row_id = b.row_id GROUP BY ALL),
ba AS (SELECT crop, sum(CASE WHEN i = j THEN (c - 1) ** 2 ELSE 0.005::DOUBLE * c * c END) AS cross_correlation, sum(CASE WHEN i = j THEN greatest(0, 1 - sqrt(k0 + 1e-4)) ELSE 0 END) / 64 AS variance_floor, sum(CASE WHEN i <> j THEN k * k ELSE 0 END) / 64 AS covariance_penalty FROM cc GROUP BY crop)"""


def _two_sets(spark, sf):
    return inputs.vectors(spark, sf).withColumn("u", F.transform("v", lambda x, i: x + (F.col("row_id") + i) % 5 * 0.01))


@query("f38_embedding_health", _F38 + " SELECT crop, round(cosine_distance, 6) AS cosine_distance, round(relational, 6) AS relational FROM co JOIN re USING (crop)")
def f38(spark, sf):
    h = linear.embedding_health(_two_sets(spark, sf), ["crop"], "v", "u")
    return h.select("crop", *[F.round(c, 6).alias(c) for c in ("cosine_distance", "relational")])


@query("f38_redundancy_terms", _F38 + " SELECT crop, round(cross_correlation, 6) AS cross_correlation, round(variance_floor, 6) AS variance_floor, round(covariance_penalty, 6) AS covariance_penalty FROM ba")
def f38b(spark, sf):
    h = linear.embedding_health(_two_sets(spark, sf), ["crop"], "v", "u")
    return h.select("crop", *[F.round(c, 6).alias(c) for c in ("cross_correlation", "variance_floor", "covariance_penalty")])


@query("f39_separation", f"WITH {VECTORS}, {_EACH}, m AS (SELECT crop, d, avg(e) AS m FROM each GROUP BY ALL), c AS (SELECT crop, list(m ORDER BY d) AS c FROM m GROUP BY crop), r AS (SELECT sqrt(avg(list_distance(v, c) ** 2)) AS r FROM vectors JOIN c USING (crop)) SELECT a.crop AS a, b.crop AS b, round(list_distance(a.c, b.c) / r, 6) AS separation FROM c a JOIN c b ON a.crop < b.crop, r")
def f39(spark, sf):
    v = inputs.vectors(spark, sf)
    c = aggregates.mean_vectors(v, ["crop"], "v").withColumnRenamed("v", "c")
    r = v.join(c, "crop").agg(F.sqrt(F.avg(F.pow(vectors.distance(F.col("v"), F.col("c")), 2))).alias("r"))
    pairs = c.select(F.col("crop").alias("a"), F.col("c").alias("ca")).join(c.select(F.col("crop").alias("b"), F.col("c").alias("cb")), F.col("a") < F.col("b"))  # one row per label
    return pairs.crossJoin(r).select("a", "b", F.round(vectors.distance(F.col("ca"), F.col("cb")) / F.col("r"), 6).alias("separation"))


@query("j1_stratified_sample", f"WITH RECURSIVE {CANDIDATES}, {ALLOCATION}, r AS (SELECT *, row_number() OVER (PARTITION BY country, stratum ORDER BY {_U.format(chr(39) + '1:' + chr(39) + ' || candidate_id')}, candidate_id) AS k, {_U.format(chr(39) + '1:' + chr(39) + ' || spatial_block')}::DOUBLE / 18446744073709551616 AS u FROM candidates JOIN allocation USING (country, stratum)) SELECT candidate_id, country, stratum, {_SPLIT} AS spatial_split, round(target / n, 6) AS inclusion_probability FROM r WHERE k <= target")
def j1(spark, sf):
    """The stand-in places repeat after 6120 customers; a step of latitude keeps them apart."""
    c = inputs.candidates(spark, sf).withColumn("latitude", F.col("latitude") + F.floor(F.col("c_custkey") / 6120) * 0.005)
    countries = [r.country for r in c.select("country").distinct().collect()]  # names of regions
    c = sampling.select_candidates(c, 20, 3, 0.5, "1", RATIOS, countries)
    return c.select("candidate_id", "country", "stratum", "spatial_split", F.round("inclusion_probability", 6).alias("inclusion_probability"))


@query("j2_block_split", f"WITH {CANDIDATES}, b AS (SELECT DISTINCT spatial_block, {_U.format(chr(39) + '1:' + chr(39) + ' || spatial_block')}::DOUBLE / 18446744073709551616 AS u FROM candidates) SELECT spatial_block, {_SPLIT} AS spatial_split FROM b")
def j2(spark, sf):
    return inputs.candidates(spark, sf).select("spatial_block").distinct().withColumn("spatial_split", sampling.split_of(F.col("spatial_block"), "1", RATIOS))


@query("j3_full_lattice", f"WITH {CANDIDATES} SELECT candidate_id, 1.0::DOUBLE AS inclusion_probability FROM candidates")
def j3(spark, sf):
    return sampling.full_lattice(inputs.candidates(spark, sf), "1", RATIOS).select("candidate_id", "inclusion_probability")


@query("j4_candidate_frame", f"WITH {POLYS}, n AS (SELECT CAST(count(*) AS BIGINT) AS c FROM supplier), r AS (SELECT unnest(range(0, c * 60)) AS id FROM n), p AS (SELECT id, (id % 60 + 0.5) * 4.0::DOUBLE AS px, (floor(id / 60) + 0.5) * 0.3::DOUBLE AS py FROM r), h AS (SELECT id, px, py, min(k) AS region FROM p JOIN polys ON px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 GROUP BY ALL) SELECT id, region, CAST((floor(px) * 31 + floor(py) * 17) % 11 AS BIGINT) AS land, 'sup-' || CAST(floor(px / 50) AS BIGINT) || '-' || CAST(floor(py / 50) AS BIGINT) AS spatial_block FROM h WHERE (floor(px) * 31 + floor(py) * 17) % 11 <> 8")
def j4(spark, sf):
    n = inputs.table(spark, sf, "supplier").count()
    p = geometry.lattice(spark, 0.0, 0.0, 60, n, 1.0).select("id", (F.col("ix") + 0.5) .alias("a"), (F.col("iy") + 0.5).alias("b"))
    p = p.select("id", (F.col("a") * 4.0).alias("px"), (F.col("b") * 0.3).alias("py"))
    r = geometry.regions_of(p, geometry.edges(polys(spark, sf), "k"), "id", "k", 8.0).where("k >= 0")
    land = F.pmod(F.floor("px") * 31 + F.floor("py") * 17, F.lit(11))
    block = F.concat(F.lit("sup-"), F.floor(F.col("px") / 50).cast("string"), F.lit("-"), F.floor(F.col("py") / 50).cast("string"))
    return p.join(r, "id").select("id", F.col("k").alias("region"), land.alias("land"), block.alias("spatial_block")).where("land <> 8")


_FRAME = f"""WITH {POLYS}, ct AS (SELECT n_nationkey AS country, n_nationkey * 9.7::DOUBLE + 0.1307::DOUBLE AS a, 0.1307::DOUBLE AS b, (SELECT (floor(count(*) / 37) + 1) * 5.5::DOUBLE FROM supplier) AS h FROM nation),
gx AS (SELECT *, unnest(range(CAST(ceil(a / 0.5::DOUBLE - 0.5) AS BIGINT), CAST(floor((a + 9.5::DOUBLE) / 0.5::DOUBLE - 0.5) AS BIGINT) + 1)) AS ix FROM ct),
gy AS (SELECT *, unnest(range(CAST(ceil(b / 0.5::DOUBLE - 0.5) AS BIGINT), CAST(floor((b + h) / 0.5::DOUBLE - 0.5) AS BIGINT) + 1)) AS iy FROM gx),
p AS (SELECT *, (ix + 0.5) * 0.5::DOUBLE AS px, (iy + 0.5) * 0.5::DOUBLE AS py FROM gy), q AS (SELECT *, (floor(px) * 31 + floor(py) * 17) % 11 AS land, (px - a) / 9.5::DOUBLE + (py - b) / h <= 1 AS inside FROM p),
rg AS (SELECT country, ix, iy, min(k) AS region, count(*) > 1 AS ambiguous FROM q JOIN polys ON px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 WHERE inside AND land NOT IN (0, 8) GROUP BY ALL),
fr AS (SELECT country, ix, iy, region, coalesce(ambiguous, false) AS ambiguous, CASE WHEN NOT inside THEN 'outside_boundary' WHEN land = 0 THEN 'land_nodata' WHEN land = 8 THEN 'permanent_water' WHEN region IS NULL THEN 'missing_region' ELSE 'candidate' END AS outcome FROM q LEFT JOIN rg USING (country, ix, iy))"""


def _frame(spark, sf):
    """Countries are triangles over the supplier polygons, which are the regions; the lattice has half a unit."""
    suppliers = inputs.table(spark, sf, "supplier").agg(((F.floor(F.count("*") / 37) + 1) * 5.5).alias("h"))
    n = inputs.table(spark, sf, "nation").select(F.col("n_nationkey").alias("country"), (F.col("n_nationkey") * 9.7 + 0.1307).alias("a"), F.lit(0.1307).alias("b")).crossJoin(F.broadcast(suppliers))
    corners = [F.col("a"), F.col("b"), F.col("a") + 9.5, F.col("b"), F.col("a"), F.col("b") + F.col("h"), F.col("a"), F.col("b")]
    e = geometry.edges(n.withColumn("wkt", F.format_string("POLYGON ((%.4f %.4f, %.4f %.4f, %.4f %.4f, %.4f %.4f))", *corners)), "country")
    land = F.pmod(F.floor("px") * 31 + F.floor("py") * 17, F.lit(11))
    centres = geometry.envelope_lattice(e, "country", 0.5)
    return geometry.candidate_frame(centres, e, "country", land, {"land_nodata": [0], "permanent_water": [8]}, geometry.edges(polys(spark, sf), "k"), "k", 8.0)


@query("j4_frame_rows", _FRAME + " SELECT country, ix, iy, region, ambiguous FROM fr WHERE outcome = 'candidate'")
def j4_rows(spark, sf):
    return _frame(spark, sf).where("outcome = 'candidate'").select("country", "ix", "iy", F.col("k").alias("region"), "ambiguous")


@query("j4_frame_counters", _FRAME + " SELECT country, outcome, count(*) AS n, count(*) FILTER (ambiguous) AS ambiguous FROM fr GROUP BY ALL")
def j4_counters(spark, sf):
    """What each country's lattice lost and why, and what it kept."""
    return _frame(spark, sf).groupBy("country", "outcome").agg(F.count("*").alias("n"), F.count_if("ambiguous").alias("ambiguous"))


def _best_split(rows: str, block: str, label: str, seeds: int) -> str:
    """CTEs up to best (seed, score): the deviation of sizes, and of the classes' shares in the mean."""
    return f"""bn AS (SELECT {block} AS b, {label} AS crop, count(*) AS n FROM {rows} GROUP BY ALL), bt AS (SELECT crop, sum(n) AS t FROM bn GROUP BY crop), sd AS (SELECT unnest(range({seeds})) AS seed),
bu AS (SELECT seed, crop, n, {_U.format("seed || ':' || b")}::DOUBLE / 18446744073709551616 AS u FROM bn, sd), bc AS (SELECT seed, {_SPLIT} AS split, crop, sum(n) AS n FROM bu GROUP BY ALL),
bs AS (SELECT seed, split, CASE split WHEN 'train' THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END AS want, count(*) AS cells, sum(n) AS n, avg(abs(n / t - CASE split WHEN 'train' THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END)) AS off FROM bc JOIN bt USING (crop) GROUP BY seed, split),
best AS (SELECT seed, round(sum(off + abs(n / (SELECT sum(t) FROM bt) - want)), 9) AS score FROM bs GROUP BY seed HAVING sum(cells) = 3 * (SELECT count(*) FROM bt) ORDER BY score, seed LIMIT 1)"""


@query("j5_best_split", f"WITH {VECTORS}, {_best_split('vectors', 'row_id % 60', 'crop', 64)} SELECT CAST(seed AS INTEGER) AS seed, score FROM best")
def j5(spark, sf):
    v = inputs.vectors(spark, sf).withColumn("b", (F.col("row_id") % 60).cast("int"))
    return sampling.best_split(v, "b", "crop", 64, RATIOS)


@query("j6_balanced_folds", f"""WITH {VECTORS}, c AS (SELECT row_id % 60 AS b, crop, count(*) AS n FROM vectors GROUP BY ALL), t AS (SELECT crop, sum(n) AS t FROM c GROUP BY crop), s AS (SELECT unnest(range(20)) AS seed),
x AS (SELECT seed, crop, {_U.format("seed || ':' || b")} % 4 AS fold, sum(n) AS n FROM c, s GROUP BY ALL), y AS (SELECT seed, round(sum(n * n / (t / 4.0::DOUBLE) - n), 9) AS score FROM x JOIN t USING (crop) GROUP BY seed) SELECT CAST(seed AS INTEGER) AS seed, score FROM y ORDER BY score, seed LIMIT 1""")
def j6(spark, sf):
    v = inputs.vectors(spark, sf).withColumn("b", F.col("row_id") % 60)
    return sampling.balanced_folds(v, "b", "crop", 4, 20)


_SNAKE = "CASE WHEN ({0}) // k % 2 = 0 THEN ({0}) % k ELSE k - 1 - ({0}) % k END"
_J7 = f"""WITH {VECTORS}, g AS (SELECT row_id % 60 AS g, row_id % 2 AS half, count(*) AS n FROM vectors GROUP BY ALL), h AS (SELECT half, count(*) AS c FROM g GROUP BY half),
b AS (SELECT half, coalesce(sum(c) OVER (ORDER BY CAST(half AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM h),
o AS (SELECT g, half, n, ahead + row_number() OVER (PARTITION BY half ORDER BY n DESC, sha256(CAST(g AS VARCHAR))) - 1 AS own, row_number() OVER (ORDER BY n DESC, sha256(CAST(g AS VARCHAR))) - 1 AS pos FROM g JOIN b USING (half)),
w AS (SELECT *, CASE way WHEN 0 THEN {_SNAKE.format('own')} WHEN 1 THEN {_SNAKE.format('pos')} ELSE {_U.format("CASE way WHEN 2 THEN 'g' ELSE 'g' || (way - 2) END || ':' || g")} % k END AS fold
  FROM o, (SELECT unnest(range(2, 5)) AS k), (SELECT unnest(range(10)) AS way)),
c AS (SELECT k, way, half, fold, sum(n) AS n FROM w GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY k, way, half) AS t FROM c),
s AS (SELECT k, way, round(sum(abs(n / t - 1.0::DOUBLE / k) - 1.0::DOUBLE / k) + count(DISTINCT half), 9) AS score FROM t GROUP BY k, way HAVING count(*) = k * count(DISTINCT half)),
x AS (SELECT k, way FROM s ORDER BY k DESC, score, way LIMIT 1) SELECT row_id, CAST(fold AS INTEGER) AS fold FROM vectors JOIN w ON w.g = row_id % 60 JOIN x USING (k, way)"""


def _halves(spark, sf):
    return inputs.vectors(spark, sf).withColumns({"g": F.col("row_id") % 60, "half": F.col("row_id") % 2})


@query("j7_group_folds", _J7)
def j7(spark, sf):
    got, _ = sampling.group_folds(_halves(spark, sf), "g", "half", 4)
    return got.select("row_id", "fold")


@query("j7_calibrated_folds")
def j7b(spark, sf):
    """Blocks by role in each outer fold: test, calibration and fit."""
    return sampling.calibrated_folds(_halves(spark, sf), "g", "half", 4)[0].select("g", "outer_fold", "role")


@query("j8_pure_samples", f"""WITH {VECTORS}, c AS (SELECT DISTINCT x, y, CAST(floor(x / 4) + floor(y / 5) * 7 AS BIGINT) % 5 AS kind FROM vectors), p AS (SELECT a.x, a.y, any_value(a.kind) AS kind FROM c a JOIN c b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.x, a.y HAVING count(*) = 9 AND min(b.kind) = max(b.kind)),
k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY {_U.format("'p:' || x || ':' || y")}) AS r FROM p) SELECT x, y, kind FROM k WHERE r <= 6""")
def j8(spark, sf):
    from ..operators.windows import first_rows

    cells = inputs.vectors(spark, sf).select("x", "y", ((F.floor(F.col("x") / 4) + F.floor(F.col("y") / 5) * 7) % 5).alias("kind")).distinct()
    pure = joins.pure_cells(cells, "x", "y", "kind")
    return first_rows(pure, ["kind"], [hashing.hash_rank(F.lit("p"), F.col("x").cast("string"), F.col("y").cast("string"))], 6)


_J9 = f"""WITH {VECTORS}, z AS (SELECT CASE WHEN row_id % 10 = 9 THEN row_id - 1 ELSE row_id END AS pixel, row_id // 5 AS grp, crop AS label, (row_id // 5) % 60 + CASE WHEN row_id % 50 = 49 THEN 1 ELSE 0 END AS spot, row_id, row_id % 13 <> 0 AS good FROM vectors),
za AS (SELECT * FROM z WHERE pixel % 3 <> 0), zb AS (SELECT * FROM z WHERE pixel % 3 <> 1),
ua AS (SELECT pixel, arg_min(grp, row_id) AS grp, min(label) AS label, arg_min(spot, row_id) AS spot, 'a' AS source FROM za WHERE good GROUP BY pixel HAVING count(DISTINCT label) = 1),
ub AS (SELECT pixel, arg_min(grp, row_id) AS grp, min(label) AS label, arg_min(spot, row_id) AS spot, 'b' AS source FROM zb WHERE good GROUP BY pixel HAVING count(DISTINCT label) = 1),
uu AS (SELECT * FROM ua WHERE pixel NOT IN (SELECT pixel FROM ub) UNION ALL SELECT * FROM ub WHERE pixel NOT IN (SELECT pixel FROM ua)),
og AS (SELECT * FROM uu WHERE grp IN (SELECT grp FROM uu GROUP BY grp HAVING min(spot) = max(spot))),
kk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_U.format("'cap:' || pixel")}, pixel) AS k FROM og), cc AS (SELECT * FROM kk WHERE k <= 60),
{_best_split('cc', 'spot', 'label', 64)}, fin AS (SELECT pixel, source, label, {_U.format("seed || ':' || spot")}::DOUBLE / 18446744073709551616 AS u FROM cc, best)
SELECT pixel, source, CAST((SELECT count(DISTINCT label) FROM cc c WHERE c.label < fin.label) AS INTEGER) AS class_id, {_SPLIT} AS split FROM fin"""


@query("j9_classification_rows", _J9)
def j9(spark, sf):
    """Two sources that share a third of their pixels; some pixels of two rows, most of those with two labels, some rows without a good vector."""
    v = inputs.vectors(spark, sf)
    pixel, group = F.when(F.col("row_id") % 10 == 9, F.col("row_id") - 1).otherwise(F.col("row_id")), F.floor(F.col("row_id") / 5)
    z = v.select("row_id", pixel.alias("pixel"), group.alias("grp"), F.col("crop").alias("label"), (group % 60 + (F.col("row_id") % 50 == 49).cast("int")).alias("spot"))
    got = sampling.classification_rows(z.where("pixel % 3 <> 0"), z.where("pixel % 3 <> 1"), "pixel", "grp", "label", "spot", 60, RATIOS, F.col("row_id") % 13 != 0, [F.col("row_id")])
    return got.select("pixel", "source", "class_id", "split")


@query("j10_balanced_sample", f"""WITH {VECTORS}, f AS (SELECT crop, field FROM (SELECT *, row_number() OVER (PARTITION BY crop ORDER BY {_U.format("'b:' || field")}, field) AS k FROM (SELECT DISTINCT crop, field FROM vectors)) WHERE k <= 2), r AS (SELECT v.crop, v.field, row_id, row_number() OVER (PARTITION BY v.field ORDER BY row_id) - 1 AS i, count(*) OVER (PARTITION BY v.field) AS n FROM vectors v JOIN f ON f.field = v.field)
SELECT crop, field, row_id FROM r WHERE n <= 4 OR list_contains(list_transform(range(4), lambda j: CASE WHEN j = 3 THEN n - 1 ELSE CAST(floor(j * ((n - 1) / 3.0::DOUBLE)) AS BIGINT) END), i)""")
def j10(spark, sf):
    return sampling.balanced_sample(inputs.vectors(spark, sf), "crop", "field", "row_id", 2, 4).select("crop", "field", "row_id")


def folded(spark, sf):
    return inputs.vectors(spark, sf).withColumn("fold", (F.col("field") % 5).cast("int"))


def scored(spark, sf):
    """Vectors with held-out log scores of a density, shrinkage and temperature chosen on held-out fields."""
    return linear.validated_density(folded(spark, sf), "crop", "field", "v", "fold")[1]


@query("j11_density_fit")
def j11(spark, sf):
    v = linear.with_field_weight(inputs.vectors(spark, sf), "field")
    m = linear.fit_density(linear.label_stats(v, "crop", "v", F.col("_field_weight")), 0.25, equal_labels=True)
    out = linear.with_log_scores(v, "v", m)
    return out.select("row_id", F.round(F.array_max("log_scores"), 4).alias("best"))


@query("j12_posteriors")
def j12(spark, sf):
    p = linear.posteriors(F.col("log_scores"))
    return scored(spark, sf).select("row_id", "crop", F.transform(p, lambda x: F.round(x, 6)).alias("posterior"))


@query("j13_temperature")
def j13(spark, sf):
    model, s, _ = linear.validated_density(folded(spark, sf), "crop", "field", "v", "fold")
    loss = F.sum(F.col("weight") * linear.log_loss(F.col("log_scores"), F.col("place"), F.lit(1.0)))
    return s.agg(F.lit(round(model.temperature, 6)).alias("temperature"), F.round(loss, 6).alias("log_loss"))


@query("j14_cross_validated_shrinkage")
def j14(spark, sf):
    """Held-out loss of each shrinkage, which is chosen, and recall (mean over crops) and log loss of fields' mean posteriors."""
    model, s, losses = linear.validated_density(folded(spark, sf), "crop", "field", "v", "fold")
    each = s.select("crop", "field", "place", F.posexplode(linear.posteriors(F.col("log_scores"))).alias("k", "p"))
    mean = each.groupBy("crop", "field", "place", "k").agg(F.avg("p").alias("p"))
    top = mean.groupBy("crop", "field").agg(F.max_by("k", F.struct("p", -F.col("k"))).alias("top"), F.first("place").alias("place"), F.sum(F.when(F.col("k") + 1 == F.col("place"), F.col("p"))).alias("own"))
    crops = top.groupBy("crop").agg(F.avg((F.col("top") + 1 == F.col("place")).cast("double")).alias("recall"), F.sum(-F.log(F.greatest(F.col("own"), F.lit(1e-12)))).alias("loss"), F.count("*").alias("n"))
    whole = crops.agg(F.round(F.avg("recall"), 6).alias("accuracy"), F.round(F.sum("loss") / F.sum("n"), 6).alias("field_log_loss"))
    rows = [(float(a), round(float(b), 6), a == model.shrinkage) for a, b in losses]
    return spark.createDataFrame(rows, "shrinkage double, log_loss double, chosen boolean").crossJoin(whole)  # one row


def centres(spark, sf):
    rows = linear.label_stats(inputs.vectors(spark, sf), "crop", "v")
    return np.array([np.array(r[2]) / r[1] for r in sorted(rows)])


_C = f"WITH {VECTORS}, {_EACH}, m AS (SELECT crop, d, avg(e) AS m FROM each GROUP BY ALL), c AS (SELECT crop, list(m ORDER BY d) AS c FROM m GROUP BY crop)"


@query("j15_parent_axis", _C + ", ab AS (SELECT (SELECT c FROM c WHERE crop = 0) AS a, (SELECT c FROM c WHERE crop = 1) AS b), d AS (SELECT row_id, v, a, b, list_transform(range(1, 65), lambda i: a[i] - b[i]) AS ax FROM vectors, ab), r AS (SELECT row_id, v, b, ax, list_dot_product(list_transform(range(1, 65), lambda i: v[i] - b[i]), ax) / list_dot_product(ax, ax) AS raw FROM d) SELECT row_id, round(raw, 6) AS raw, raw BETWEEN 0 AND 1 AS inside, round(list_distance(v, list_transform(range(1, 65), lambda i: b[i] + greatest(0, least(1, raw)) * ax[i])), 6) AS residual FROM r")
def j15(spark, sf):
    c = centres(spark, sf)
    share, raw, rest = mixture.segment_projection(F.col("v"), c[0], c[1])
    return inputs.vectors(spark, sf).select("row_id", F.round(raw, 6).alias("raw"), raw.between(0, 1).alias("inside"), F.round(rest, 6).alias("residual"))


def two_source(spark, sf):
    return scored(spark, sf).select("field", "block", "row_id", F.col("log_scores")[0].alias("a"), F.col("log_scores")[1].alias("b"), "log_scores")


_OBS2 = f"WITH {OBSERVATIONS}, o AS (SELECT sample_id, -abs(value - 100) / 50 AS a, -abs(k - 50) / 30 AS b FROM observations), g AS (SELECT unnest(range(201)) AS i), l AS (SELECT sample_id, i, i / 200.0::DOUBLE AS p, round(sum(greatest(a, b) + ln(i / 200.0::DOUBLE * exp(a - greatest(a, b)) + (1 - i / 200.0::DOUBLE) * exp(b - greatest(a, b)) + 1e-300)), 9) AS ll FROM o, g GROUP BY ALL)"


@query("j16_mosaic_share", _OBS2 + ", b AS (SELECT sample_id, arg_max(p, (ll, -abs(p - 0.5), -i)) AS share, max(ll) AS ll, greatest(max(ll) FILTER (i = 0), max(ll) FILTER (i = 200)) AS pure FROM l GROUP BY sample_id) SELECT sample_id, round(share, 6) AS share, round(ll - pure, 6) AS evidence FROM b")
def j16(spark, sf):
    o = inputs.observations(spark, sf).select("sample_id", (-F.abs(F.col("value") - 100) / 50).alias("a"), (-F.abs(F.col("k") - 50) / 30).alias("b"))
    return mixture.mosaic_share(o, ["sample_id"], "a", "b").select("sample_id", F.round("share", 6).alias("share"), F.round("evidence", 6).alias("evidence"))


@query("j17_all_pairs")
def j17(spark, sf):
    shares = mixture.all_pair_shares(scored(spark, sf), ["field"], "log_scores", list(range(10)), 21)
    return mixture.best_pair(shares, ["field"]).withColumn("margin", F.round("margin", 6))


@query("j18_bootstrap_share")
def j18(spark, sf):
    units = inputs.vectors(spark, sf).select("field", "block").distinct()
    return mixture.bootstrap_share(two_source(spark, sf), ["field"], "block", "a", "b", 50, 21, units)


def _paired(spark, sf):
    """(model, held-out rows with the places of their crop's pair: crops 2p and 2p + 1)."""
    model, s, _ = linear.validated_density(folded(spark, sf), "crop", "field", "v", "fold")
    pair = F.floor(F.col("crop") / 2).cast("int")
    return model, s.withColumns({"pair": pair, "pa": 2 * pair, "pb": 2 * pair + 1, "label": F.col("crop"), "patch": (F.col("row_id") % 3).cast("int")})


def _controls(model, rows):
    """Held-out fields as end points of their pair."""
    c = calls.pair_fields(rows, ["pair", "field", "label"], "patch", list(range(10)), model.temperature, 51)
    return c.withColumn("truth", (F.col("label") % 2 == 0).cast("double"))


def _synthetic(rows):
    """Mosaics that draw rows of both crops of a pair in stated shares, with the share they really have."""
    mixed = rows.withColumn("target", F.explode(F.array(F.lit(25), F.lit(50), F.lit(75))))
    u = hashing.unit_interval(F.col("target").cast("string"), F.col("row_id").cast("string")) * 100
    drawn = mixed.where(F.when(F.col("crop") == F.col("pa"), u < F.col("target")).otherwise(u >= F.col("target")))
    drawn = drawn.withColumns({"a": F.get("log_scores", F.col("pa")), "b": F.get("log_scores", F.col("pb"))})
    truth = drawn.groupBy("pair", "target").agg(F.avg((F.col("crop") == F.col("pa")).cast("double")).alias("truth"))
    return mixture.mosaic_share(drawn, ["pair", "target"], "a", "b", 51).select("pair", "target", "share").join(truth, ["pair", "target"])


#: Limits wide enough that the stand-in vectors, which hold little, pass for some pairs.
LIMITS = {"fields": 2, "accuracy": 0.01, "endpoint": 0.5, "synthetic": 0.5}


@query("j19_pair_controls")
def j19(spark, sf):
    """Held-out fields as end points, and synthetic mosaics of stated shares."""
    model, rows = _paired(spark, sf)
    ends = _controls(model, rows).select(F.concat_ws("-", F.lit("field"), "pair", "field").alias("control"), "truth", "share")
    made = _synthetic(rows).select(F.concat_ws("-", F.lit("mosaic"), "pair", "target").alias("control"), F.round("truth", 6).alias("truth"), "share")
    return ends.unionByName(made)


def _calibration(model, rows):
    c = _controls(model, rows).persist()
    return c, calls.thresholds(c, "pair"), calls.gates(c, _synthetic(rows), "pair", 5, 0.1, LIMITS)


@query("j20_calibration_tables")
def j20(spark, sf):
    """Thresholds of every pair and count bin, with their source, and the pair's gate."""
    _, limits, gate = _calibration(*_paired(spark, sf))
    both = limits.join(gate, "pair")
    return both.select("pair", "bin", *[F.round(c, 6).alias(c) for c in ("evidence_threshold", "mass_threshold", "far_threshold", "endpoint_mae", "synthetic_mae")], "controls", "source", "passed")


@query("j21_field_calls")
def j21(spark, sf):
    """Statuses of the fields of one crop, and of made mixtures: a block's rows of both crops of a pair."""
    model, rows = _paired(spark, sf)
    controls, limits, gate = _calibration(model, rows)
    single = controls.select("pair", "field", "pa", "pb", "rows", "bin", "blocks", "share", "evidence_per_row", "named_mass", "far", "margin")
    blocks = rows.withColumn("field", 100_000 + F.col("pair") * 100 + F.col("block"))
    named = calls.pair_fields(blocks, ["pair", "field"], "patch", list(range(10)), model.temperature, 51)
    two = blocks.withColumns({"a": F.get("log_scores", F.col("pa")), "b": F.get("log_scores", F.col("pb"))})
    ends = mixture.bootstrap_share(two, ["field"], "patch", "a", "b", 50, 51).select("field", "low", "high")
    nothing = F.lit(None).cast("double")
    every = single.withColumns({"named": F.lit(False), "low": nothing, "high": nothing}).unionByName(named.join(ends, "field").withColumn("named", F.lit(True)))
    return calls.called(every, limits, gate, "pair").select("pair", "field", "named", "status", "share")


@query("j22_windowed_workflow")
def j22(spark, sf):
    """The whole chain with the window as a grouping key: densities per window, shares per field and window."""
    v = linear.with_field_weight(inputs.windowed_vectors(spark, sf), "field")
    stats = linear.label_stats(v, "crop", "v", F.col("_field_weight"), "w")
    models = {w: linear.fit_density([r[:1] + r[2:] for r in stats if r[1] == w], 0.25, equal_labels=True) for w in range(1, 5)}
    s = linear.with_log_scores(v, "v", models, fold="w").select("field", "w", F.col("log_scores")[0].alias("a"), F.col("log_scores")[1].alias("b"))
    return mixture.mosaic_share(s, ["field", "w"], "a", "b", 21).select("field", "w", "share", F.round("evidence", 4).alias("evidence"))


@query("j23_simplex_weights")
def j23(spark, sf):
    fit = mixture.with_simplex(inputs.vectors(spark, sf), "v", centres(spark, sf)[:4])
    return fit.select("row_id", F.transform("weights", lambda x: F.round(x, 6)).alias("weights"), *[F.round(c, 6).alias(c) for c in ("residual_norm", "residual_rmse", "relative_residual")], "active_count")


@query("j24_segment_projection", _C + ", ab AS (SELECT (SELECT c FROM c WHERE crop = 2) AS a, (SELECT c FROM c WHERE crop = 5) AS b), d AS (SELECT row_id, list_dot_product(list_transform(range(1, 65), lambda i: v[i] - b[i]), list_transform(range(1, 65), lambda i: a[i] - b[i])) / list_dot_product(list_transform(range(1, 65), lambda i: a[i] - b[i]), list_transform(range(1, 65), lambda i: a[i] - b[i])) AS s FROM vectors, ab) SELECT row_id, round(greatest(0, least(1, s)), 6) AS share FROM d")
def j24(spark, sf):
    c = centres(spark, sf)
    return inputs.vectors(spark, sf).select("row_id", F.round(mixture.segment_projection(F.col("v"), c[2], c[5])[0], 6).alias("share"))


@query("j25_dual_evidence", f"WITH {VECTORS} SELECT row_id, round(coalesce(4 * abs(v[1]) * abs(v[2]) / nullif(abs(v[1]) + abs(v[2]), 0), 0), 6) AS score FROM vectors")
def j25(spark, sf):
    return inputs.vectors(spark, sf).select("row_id", F.round(mixture.dual_evidence(F.abs(F.col("v")[0]), F.abs(F.col("v")[1])), 6).alias("score"))


@query("j26_prototypes", f"WITH {VECTORS}, {_EACH}, f AS (SELECT crop, field, d, avg(e) AS m FROM each GROUP BY ALL), l AS (SELECT crop, d, avg(m) AS m FROM f GROUP BY ALL) SELECT crop, round(sum(m), 6) AS total, round(max(m) FILTER (d = 7), 6) AS m7 FROM l GROUP BY crop")
def j26(spark, sf):
    f = aggregates.mean_vectors(inputs.vectors(spark, sf), ["crop", "field"], "v")
    p = aggregates.mean_vectors(f, ["crop"], "v")
    return p.select("crop", total("v").alias("total"), F.round(F.col("v")[7], 6).alias("m7"))


def out_of_fold(spark, sf):
    v = inputs.vectors(spark, sf).withColumn("fold", (F.col("field") % 5).cast("int"))
    each = [aggregates.mean_vectors(v.where(F.col("fold") != f), ["crop"], "v").select(F.lit(f).alias("fold"), "crop", F.col("v").alias("c")) for f in range(5)]
    c = each[0]
    for other in each[1:]:
        c = c.unionByName(other)
    return linear.nearest_centroid(v, "v", c.withColumnRenamed("crop", "label"), "label", ["fold"])


_NC = f"WITH {VECTORS}, {_EACH}, t AS (SELECT field % 5 AS fold, crop, d, sum(e) AS s, count(*) AS n FROM each GROUP BY ALL), k AS (SELECT f.fold, crop, d, sum(s) / sum(n) AS m FROM t, (SELECT unnest(range(5)) AS fold) f WHERE t.fold <> f.fold GROUP BY ALL), c AS (SELECT fold, crop AS label, list(m ORDER BY d) AS c FROM k GROUP BY ALL), x AS (SELECT row_id, label, round(list_distance(v, c), 9) AS d FROM vectors v JOIN c ON c.fold = v.field % 5)"
_HIGHER = "list_sort(list({0}))[CAST(ceil((count(*) - 1) * {1} - 1e-9) AS INTEGER) + 1]"


@query("j27_control_thresholds", _NC + ", p AS (SELECT row_id, arg_min(label, (d, label)) AS predicted, min(d) AS distance FROM x GROUP BY row_id) SELECT crop, round(" + _HIGHER.format("distance", 0.95) + ", 6) AS threshold, round(avg(CASE WHEN predicted = crop THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS recall FROM p JOIN vectors USING (row_id) GROUP BY crop")
def j27(spark, sf):
    p = out_of_fold(spark, sf)
    t = aggregates.stated_quantiles(p, ["crop"], "distance", 0.95, ["higher"]).select("crop", F.round("higher", 6).alias("threshold"))
    return p.groupBy("crop").agg(F.round(F.avg((F.col("predicted") == F.col("crop")).cast("double")), 6).alias("recall")).join(t, "crop")


@query("j28_mixture_calls")
def j28(spark, sf):
    w = mixture.simplex_projection(F.col("v"), centres(spark, sf)[:3])
    s = inputs.vectors(spark, sf).withColumn("w", w)
    s = s.withColumn("call", F.when(F.array_max("w") > 0.9, "single").when(F.array_min(F.slice(F.reverse(F.array_sort("w")), 1, 2)) > 0.2, "mixture").otherwise("unclear"))
    return s.groupBy("field").agg(F.count("*").alias("n"), F.round(F.avg((F.col("call") == "mixture").cast("double")), 6).alias("mixture_rate"), F.bool_and(F.col("call") != "unclear").alias("all_clear"))


_FM = f"WITH {VECTORS}, {_EACH}, fm AS (SELECT crop, field, d, avg(e) AS m FROM each GROUP BY ALL)"


@query("j29_reference_bootstrap", _FM + f""", u AS (SELECT crop, field, row_number() OVER (PARTITION BY crop ORDER BY field) - 1 AS i, count(*) OVER (PARTITION BY crop) AS m FROM (SELECT DISTINCT crop, field FROM vectors)),
sl AS (SELECT DISTINCT crop, m, r, unnest(range(m)) AS s FROM u, (SELECT unnest(range(40)) AS r)), dr AS (SELECT crop, r, CAST({_U.format("':' || crop || ':' || r || ':' || s")} % m AS BIGINT) AS i FROM sl),
wt AS (SELECT crop, field, r, count(*) AS w FROM dr JOIN u USING (crop, i) GROUP BY ALL), pr AS (SELECT r, crop, d, sum(w * m) / sum(w) AS m FROM fm JOIN wt USING (crop, field) GROUP BY ALL),
ds AS (SELECT a.r, sqrt(sum((a.m - b.m) ** 2)) AS x FROM pr a JOIN pr b ON a.r = b.r AND a.d = b.d AND a.crop = 0 AND b.crop = 1 GROUP BY a.r)
SELECT round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.975), 6) AS high FROM ds""")
def j29(spark, sf):
    """Prototypes per replicate from drawn reference fields, and the spread of a distance between two of them."""
    f = aggregates.mean_vectors(inputs.vectors(spark, sf), ["crop", "field"], "v")
    d = mixture.draws(f.select("crop", "field"), ["crop"], "field", 40)
    p = aggregates.mean_vectors(f.join(d, ["crop", "field"]), ["replicate", "crop"], "v", F.col("weight"))
    pair = p.where("crop = 0").select("replicate", F.col("v").alias("a")).join(p.where("crop = 1").select("replicate", F.col("v").alias("b")), "replicate")
    q = F.percentile(vectors.distance(F.col("a"), F.col("b")), F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return pair.agg(q.alias("q")).select(*[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("low", "median", "high"))])


_RB = f"""WITH {inputs.WINDOWED}, we AS (SELECT * EXCLUDE (v), unnest(v) AS e, unnest(range(len(v))) AS d FROM windowed), fm AS (SELECT w, crop, field, d, avg(e) AS m FROM we GROUP BY ALL),
u AS (SELECT crop, field, row_number() OVER (PARTITION BY crop ORDER BY field) - 1 AS i, count(*) OVER (PARTITION BY crop) AS c FROM (SELECT DISTINCT crop, field FROM vectors)),
dr AS (SELECT crop, r, CAST({_U.format("':' || crop || ':' || r || ':' || i")} % c AS BIGINT) AS i FROM u, (SELECT unnest(range(20)) AS r)), wt AS (SELECT crop, field, r, count(*) AS n FROM dr JOIN u USING (crop, i) GROUP BY ALL),
pr AS (SELECT w, r, crop, d, sum(n * m) / sum(n) AS m FROM fm JOIN wt USING (crop, field) GROUP BY ALL),
ln AS (SELECT a.w, a.r, a.crop // 2 AS pair, a.d, a.m - b.m AS dm, b.m AS mb FROM pr a JOIN pr b ON a.w = b.w AND a.r = b.r AND a.d = b.d AND a.crop % 2 = 0 AND b.crop = a.crop + 1), l2 AS (SELECT w, r, pair, sum(dm * dm) AS n2, sum(mb * dm) AS c FROM ln GROUP BY ALL),
dt AS (SELECT row_id, w, r, field, pair, sum(e * dm) AS x FROM (SELECT *, (crop // 2 + 4) % 5 AS pair FROM we) JOIN ln USING (w, pair, d) GROUP BY ALL),
fs AS (SELECT w, pair, field, r, avg(least(1, greatest(0, (x - c) / n2))) AS s FROM dt JOIN l2 USING (w, r, pair) GROUP BY ALL)"""


def _replicates(spark, sf):
    """(shares by replicate, rows): a crop's fields are held against the pair of crops before it, in all windows."""
    v = inputs.windowed_vectors(spark, sf)
    rows = v.withColumn("pair", ((F.floor(F.col("crop") / 2) + 4) % 5).cast("int"))
    pairs = spark.createDataFrame([(p, 2 * p, 2 * p + 1) for p in range(5)], "pair int, a int, b int")
    return mixture.reference_replicates(v, rows, pairs, "w", "crop", "field", "v", "pair", 20), rows


@query("j29_field_intervals", _RB + " SELECT w, CAST(pair AS INTEGER) AS pair, field, round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.5), 6) AS median, round(quantile_cont(s, 0.975), 6) AS high, count(*) AS replicates_used FROM fs GROUP BY ALL")
def j29b(spark, sf):
    """Intervals of every field's share in every window, from the same drawn reference fields in all of them."""
    out = mixture.spread(_replicates(spark, sf)[0], ["w", "pair", "field"], "share")
    return out.withColumns({c: F.round(c, 6) for c in ("low", "median", "high")})


@query("j29_group_intervals", _RB + f""", gu AS (SELECT pair, field, row_number() OVER (PARTITION BY pair ORDER BY field) - 1 AS i, count(*) OVER (PARTITION BY pair) AS c FROM (SELECT DISTINCT pair, field FROM fs)),
gd AS (SELECT pair, r, CAST({_U.format("'g:' || pair || ':' || r || ':' || i")} % c AS BIGINT) AS i FROM gu, (SELECT unnest(range(20)) AS r)), gw AS (SELECT pair, field, r, count(*) AS n FROM gd JOIN gu USING (pair, i) GROUP BY ALL),
gs AS (SELECT w, pair, r, sum(n * s) / sum(n) AS s FROM fs JOIN gw USING (pair, field, r) GROUP BY ALL)
SELECT w, CAST(pair AS INTEGER) AS pair, round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.5), 6) AS median, round(quantile_cont(s, 0.975), 6) AS high, count(*) AS replicates_used FROM gs GROUP BY ALL""")
def j29c(spark, sf):
    """Intervals of every pair's mean share in every window: fields are drawn too, the same in all windows."""
    shares, rows = _replicates(spark, sf)
    g = mixture.group_replicates(shares, rows.select("pair", "field").distinct(), "w", "pair", "field", 20)
    return mixture.spread(g, ["w", "pair"], "share").withColumns({c: F.round(c, 6) for c in ("low", "median", "high")})


_WC = f"""WITH {VECTORS}, {_EACH}, fq AS (SELECT crop, field, d, avg(e) AS m, avg(e * e) AS q FROM each GROUP BY ALL),
c AS (SELECT fold, crop AS label, d, avg(m) AS m, avg(q) AS q FROM fq, (SELECT unnest(range(5)) AS fold) WHERE field % 5 <> fold GROUP BY ALL),
t AS (SELECT fold, d, avg(m) AS mu, sqrt(greatest(avg(q) - avg(m) * avg(m), 0)) AS sd FROM c GROUP BY ALL),
z AS (SELECT row_id, e.crop, field, label, sum(((e.e - c.m) / CASE WHEN sd < 1e-8 THEN 1 ELSE sd END) ** 2) AS d2 FROM each e JOIN c ON c.fold = e.field % 5 AND c.d = e.d JOIN t ON t.fold = c.fold AND t.d = e.d GROUP BY ALL)"""


def _distances(spark, sf):
    v = inputs.vectors(spark, sf).withColumn("fold", (F.col("field") % 5).cast("int"))
    return linear.centroid_distances(v, "v", linear.balanced_centroids(v, "v", "crop", "field", "fold", 5), "fold")


@query("j30_nearest_centroid", _WC + " SELECT row_id, arg_min(label, (round(d2, 9), label)) AS predicted, round(min(d2), 4) AS distance FROM z GROUP BY row_id")
def j30(spark, sf):
    best = F.array_min(F.transform("distances", lambda t: F.struct(F.round(t["d"], 9).alias("d"), t["l"].alias("l"))))
    return _distances(spark, sf).select("row_id", best["l"].alias("predicted"), F.round(best["d"], 4).alias("distance"))


@query("j30_field_decisions", _WC + ", f AS (SELECT field, crop, label, round(avg(d2), 9) AS d FROM z GROUP BY ALL) SELECT field, crop, arg_min(label, (d, label)) AS predicted, round(min(d), 4) AS distance FROM f GROUP BY field, crop")
def j30b(spark, sf):
    """A field is of the crop whose centroid its rows are nearest to on average."""
    return linear.field_decisions(_distances(spark, sf), "field", ["crop"]).withColumn("distance", F.round("distance", 4))


@query("j31_permutation_test", _FM + f""", fl AS (SELECT DISTINCT crop, field, field % 5 AS fold FROM vectors), rp AS (SELECT *, r FROM fl, (SELECT unnest(range(10)) AS r)),
ix AS (SELECT *, row_number() OVER (PARTITION BY r, fold ORDER BY field) AS mine, row_number() OVER (PARTITION BY r, fold ORDER BY {_U.format("r || ':' || field")}) AS theirs FROM rp),
gv AS (SELECT a.r, a.field, b.crop AS given FROM ix a JOIN ix b ON a.r = b.r AND a.fold = b.fold AND b.mine = CASE WHEN a.r = 0 THEN a.mine ELSE a.theirs END),
ce AS (SELECT r, given AS label, d, avg(m) AS c FROM gv JOIN fm USING (field) GROUP BY ALL), di AS (SELECT gv.r, gv.field, gv.given, label, round(sqrt(sum((m - c) ** 2)), 9) AS x FROM gv JOIN fm USING (field) JOIN ce ON ce.r = gv.r AND ce.d = fm.d GROUP BY ALL),
be AS (SELECT r, field, any_value(given) AS given, arg_min(label, (x, label)) AS predicted FROM di GROUP BY r, field)
SELECT CAST(r AS INTEGER) AS replicate, round(avg(CASE WHEN predicted = given THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy FROM be GROUP BY r""")
def j31(spark, sf):
    """Accuracy of fields' nearest centroids under labels shuffled among the fields of a fold."""
    f = aggregates.mean_vectors(inputs.vectors(spark, sf), ["crop", "field"], "v").withColumn("fold", F.col("field") % 5)
    r = f.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(9))))
    w = W.partitionBy("replicate", "fold")
    mine = F.row_number().over(w.orderBy("field"))
    theirs = F.row_number().over(w.orderBy(hashing.hash_rank(F.col("replicate").cast("string"), F.col("field").cast("string"))))
    a = r.withColumn("i", F.when(F.col("replicate") == 0, mine).otherwise(theirs))
    labels = r.withColumn("i", mine).select("replicate", "fold", "i", F.col("crop").alias("given"))
    rows = a.join(labels, ["replicate", "fold", "i"]).select("replicate", "field", "fold", "given", "v")
    c = aggregates.mean_vectors(rows, ["replicate", "given"], "v").select("replicate", F.col("given").alias("label"), F.col("v").alias("c"))
    p = linear.nearest_centroid(rows, "v", c, "label", ["replicate"])
    return p.groupBy("replicate").agg(F.round(F.avg((F.col("predicted") == F.col("given")).cast("double")), 6).alias("accuracy"))


@query("j42_window_encoding", f"""WITH {OBSERVATIONS}, w(w, a, z) AS (VALUES (1, 19723, 19730), (2, 19723, 19740), (3, 19800, 19810)), s AS (SELECT DISTINCT sample_id FROM observations)
SELECT s.sample_id, w.w, CASE WHEN count(obs_id) > 0 THEN 'complete' ELSE 'empty_window' END AS outcome, round(avg(value) + 1e-9, 6) AS m1, round(avg(epoch_day) + 1e-9, 6) AS day FROM s CROSS JOIN w LEFT JOIN observations o ON o.sample_id = s.sample_id AND epoch_day >= a AND epoch_day < z AND valid GROUP BY ALL""")
def j42(spark, sf):
    e = encoding.encoded(_windows(spark, sf), "sample_id")
    return e.select("sample_id", "w", "outcome", F.round(F.get("vector", F.lit(0)) + 1e-9, 6).alias("m1"), F.round(F.get("vector", F.lit(4)) + 1e-9, 6).alias("day"))


def _windows(spark, sf):
    w = spark.createDataFrame([(1, 19723, 19730), (2, 19723, 19740), (3, 19800, 19810)], "w int, start int, end int")
    o = inputs.observations(spark, sf).select("sample_id", "obs_id", "epoch_day", "bands", "valid")
    return encoding.windows_of(o.where("valid"), w, "sample_id", "epoch_day", "bands", "obs_id").join(o.select("sample_id").distinct(), "sample_id", "right").where("w IS NOT NULL")


@query("j43_content_keyed_reuse", f"WITH {OBSERVATIONS}, s AS (SELECT DISTINCT sample_id FROM observations WHERE valid) SELECT sample_id, CAST(w AS INTEGER) AS w, CASE WHEN w = 3 OR sample_id % 4 = 1 THEN true ELSE sample_id % 4 <> 0 END AS reused FROM s, (SELECT unnest([1, 2, 3]) AS w)")
def j43(spark, sf):
    """Known results hold all samples but every fourth; their empty windows are known all the same."""
    rows = _windows(spark, sf)
    known = encoding.encoded(rows.where("sample_id % 4 <> 0 OR w = 3"), "sample_id")
    return encoding.incremental(rows, known, "sample_id").select("sample_id", "w", "reused")


@query("j44_extend_after_cutoff", f"WITH {OBSERVATIONS} SELECT sample_id, count(*) AS n, count(*) FILTER (epoch_day >= 19740) AS added FROM observations GROUP BY sample_id")
def j44(spark, sf):
    o = inputs.observations(spark, sf).select("sample_id", "obs_id", "epoch_day")
    t = mosaic.extended_timeline(o.where("epoch_day < 19740"), o, "epoch_day", 19740)
    return t.groupBy("sample_id").agg(F.count("*").alias("n"), F.count_if(F.col("epoch_day") >= 19740).alias("added"))


@query("j45_point_histories", f"WITH {OBSERVATIONS}, n AS (SELECT sample_id, count(*) FILTER (valid AND kind = 'click') AS v, count(*) FILTER (kind = 'click') AS n FROM observations GROUP BY 1) SELECT sample_id, CASE WHEN n = 0 THEN 'none' WHEN v < 15 THEN 'insufficient' ELSE 'complete' END AS outcome FROM n")
def j45(spark, sf):
    o = inputs.observations(spark, sf)
    return mosaic.outcomes(o.select("sample_id").distinct(), o.where("kind = 'click'"), ["sample_id"], F.col("valid"), 15).select("sample_id", "outcome")


_SAMPLED = f"""WITH {inputs.ITEMS}, {CANDIDATES}, p AS (SELECT candidate_id, item_id || '|' || doc || '|' || quantity AS item_id, acquired, year(acquired) AS period, orbit, quantity, CAST(floor(north - latitude) * 10 + floor(longitude - west) AS BIGINT) AS j
 FROM candidates c JOIN items i ON i.tile % 10 = c_custkey % 10 AND longitude BETWEEN west AND east AND latitude BETWEEN south AND north),
o AS (SELECT *, (quantity + j * 3) % 12 AS class, (quantity * 7 + j) % 100 AS red FROM p WHERE orbit = 'N'), r AS (SELECT *, (quantity + j) % 4 AS vv, (quantity * 3 + j) % 5 AS vh FROM p WHERE orbit <> 'N')"""


def _single(spark, sf):
    """Items in ten tiles; the tables repeat line numbers, so document and quantity are part of the id."""
    return inputs.items(spark, sf).withColumns({"tile": F.col("tile") % 10, "item_id": F.concat_ws("|", "item_id", "doc", "quantity")})


def _points(spark, sf):
    """Points with their tile and their place, a text: points of one tile at the same longitude and latitude have one."""
    c = inputs.candidates(spark, sf).withColumn("tile", F.col("c_custkey") % 10)
    return c.withColumn("place", F.concat_ws("|", "tile", "longitude", "latitude"))


def _asked(spark, sf):
    """Places and the items that hold them: what is sampled, with the items' own columns. However many points a place has, an item is asked for it once."""
    places = _points(spark, sf).select("tile", "longitude", "latitude", "place").distinct()
    return joins.point_in_boxes(places, _single(spark, sf), ["tile"], "longitude", "latitude")


def _store(spark, sf):
    """The folder of rasters of 10 by 8 cells for all items, class and red of optical ones, vv and vh of others, and the values at the asked places."""
    from ..sources import samples
    from .q_sources import folder

    q, cells, asset = F.col("quantity"), F.sequence(F.lit(0), F.lit(79)), F.col("asset")
    per = lambda f: F.transform(cells, f).cast("array<double>")
    values = F.when(asset == "class", per(lambda j: (q + j * 3) % 12)).when(asset == "red", per(lambda j: (q * 7 + j) % 100)).when(asset == "vv", per(lambda j: (q + j) % 4)).otherwise(per(lambda j: (q * 3 + j) % 5))
    pair = lambda *names: F.array(*map(F.lit, names))
    i = _single(spark, sf).withColumn("asset", F.explode(F.when(F.col("orbit") == "N", pair("class", "red")).otherwise(pair("vv", "vh"))))
    rasters = i.select("tile", F.col("item_id").alias("item"), "asset", "west", "north", F.lit(1.0).alias("step"), F.lit(10).alias("width"), "quantity")
    asked = _asked(spark, sf).select("tile", F.col("item_id").alias("item"), F.col("place").alias("point"), F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    path = folder(spark)
    samples.land(rasters, asked, path, values=values)
    return path


@query("l3_sampler_source", _SAMPLED + " SELECT item_id AS item, candidate_id AS point, asset, CAST(v AS DOUBLE) AS value FROM (SELECT item_id, candidate_id, unnest(['class', 'red']) AS asset, unnest([class, red]) AS v FROM o UNION ALL SELECT item_id, candidate_id, unnest(['vv', 'vh']), unnest([vv, vh]) FROM r)")
def l3_source(spark, sf):
    """Values of landed rasters at places, read by a data source with a task a tile and file of places, for each point there.

    The rows are as many as points times the items that hold them; only those of places are shuffled.
    """
    from ..sources import samples

    sampled = samples.read_samples(spark, _store(spark, sf)).withColumnRenamed("point", "place")
    points = _points(spark, sf).select("place", F.col("candidate_id").alias("point"))
    return sampled.join(points, "place").select("item", "point", "asset", "value")


@query("j45_sampled_histories", _SAMPLED + """, od AS (SELECT candidate_id, period, coalesce(bool_or(class IN (4, 5, 6)), false) AS valid, coalesce(arg_min(red, (acquired, item_id)) FILTER (class IN (4, 5, 6)), 0) AS band FROM o GROUP BY ALL),
rd AS (SELECT candidate_id, period, orbit, coalesce(arg_min(vv, (acquired, item_id)) FILTER (vv <> 0), 0) AS vv, coalesce(arg_min(vh, (acquired, item_id)) FILTER (vh <> 0), 0) AS vh FROM r GROUP BY ALL),
m AS (SELECT candidate_id, 's2' AS modality, valid, band FROM od UNION ALL SELECT candidate_id, 's1', vv <> 0 AND vh <> 0, vv FROM rd)
SELECT c.candidate_id, x.modality, count(m.band) AS rows, count(*) FILTER (m.valid) AS valid_rows, CAST(coalesce(sum(m.band), 0) AS DOUBLE) AS band_sum,
 CASE WHEN count(m.band) = 0 THEN 'none' WHEN count(*) FILTER (m.valid) = 0 THEN 'insufficient' ELSE 'complete' END AS outcome
FROM candidates c CROSS JOIN (SELECT unnest(['s2', 's1']) AS modality) x LEFT JOIN m ON m.candidate_id = c.candidate_id AND m.modality = x.modality GROUP BY ALL""")
def j45_sampled(spark, sf):
    """Items that hold a place, their sampled values, one mosaic a period (optical: first valid item; radar: each band by itself, by orbit), outcomes for each point there."""
    from ..sources import samples

    items = _single(spark, sf).select(F.col("item_id").alias("item"), "acquired", "orbit", F.year("acquired").alias("period")).distinct()
    at = lambda asset: F.max(F.when(F.col("asset") == asset, F.col("value"))).alias(asset)
    store, ids = _store(spark, sf), ["item", "point", "acquired", "orbit", "period"]
    of = lambda *assets: items.join(samples.read_samples(spark, store).where(F.col("asset").isin(*assets)), "item").groupBy(*ids).agg(*map(at, assets))
    optical = of("class", "red").where("orbit = 'N'").withColumns({"valid": F.col("class").isin(4, 5, 6), "bands": F.array("red", "class")})
    s2 = mosaic.daily_first_valid(optical, ["point", "period"], ["acquired", "item"], "valid", "bands", "item").select("point", F.lit("s2").alias("modality"), "valid", F.get("bands", F.lit(0)).alias("band"))
    s1 = mosaic.first_nonzero_each(of("vv", "vh").where("orbit <> 'N'"), ["point", "period", "orbit"], ["acquired", "item"], ["vv", "vh"], "item")
    s1 = s1.select("point", F.lit("s1").alias("modality"), ((F.col("vv") != 0) & (F.col("vh") != 0)).alias("valid"), F.col("vv").alias("band"))
    history = s2.unionByName(s1)
    keys = ["point", "modality"]
    points = _points(spark, sf).select("candidate_id", F.col("place").alias("point"))
    expected = joins.cross_small(points.select("point").distinct(), ["s2", "s1"], "modality")
    out = mosaic.outcomes(expected, history, keys, F.col("valid"), 1, sums={"band": "band_sum"})
    return points.join(out.fillna(0.0, ["band_sum"]), "point").select("candidate_id", *[c for c in out.columns if c != "point"])


@query("j46_field_features", f"WITH {VECTORS}, {_EACH}, m AS (SELECT crop, field, d, avg(e) AS m FROM each GROUP BY ALL), s AS (SELECT field, round(sum(m), 6) AS mean_sum FROM m GROUP BY field), g AS (SELECT field, any_value(crop) AS crop, count(*) AS n, max(x) - min(x) + 1 AS width FROM vectors GROUP BY field) SELECT field, crop, n, width, mean_sum FROM g JOIN s USING (field)")
def j46(spark, sf):
    v = inputs.vectors(spark, sf)
    m = aggregates.mean_vectors(v, ["field"], "v").select("field", total("v").alias("mean_sum"))
    g = v.groupBy("field").agg(F.first("crop").alias("crop"), F.count("*").alias("n"), (F.max("x") - F.min("x") + 1).alias("width"))
    return g.join(m, "field")


@query("j47_longitudinal_rows", f"WITH {inputs.WINDOWED}, p AS (SELECT * FROM windowed WHERE NOT (w = 2 AND row_id % 11 = 0)), c AS (SELECT row_id FROM p GROUP BY row_id HAVING count(DISTINCT w) = 4) SELECT field, count(DISTINCT row_id) AS rows FROM p WHERE row_id IN (SELECT row_id FROM c) GROUP BY field")
def j47(spark, sf):
    from ..operators.cohort import in_all_windows

    p = inputs.windowed_vectors(spark, sf).where("NOT (w = 2 AND row_id % 11 = 0)")
    return p.join(in_all_windows(p, ["row_id"], "w", 4), "row_id", "left_semi").groupBy("field").agg(F.count_distinct("row_id").alias("rows"))
