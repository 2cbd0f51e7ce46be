"""Queries of contracts and filters (D). Most report violations that the stand-in tables really have."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import cohort, contracts
from ..operators.contracts import union, violations
from . import inputs
from .inputs import CANDIDATES, FIELDS, MEMBERSHIPS, OBSERVATIONS, VECTORS, WINDOWED
from .registry import query

N = "CAST(NULL AS VARCHAR)"


@query("d1_candidate_contract", f"""WITH {CANDIDATES} SELECT 'unique_id' AS rule, candidate_id AS key, CAST(count(*) AS VARCHAR) AS detail FROM candidates GROUP BY candidate_id HAVING count(*) > 1
UNION ALL SELECT 'country', candidate_id, {N} FROM candidates WHERE country NOT IN ('ASIA', 'EUROPE', 'AFRICA') UNION ALL SELECT 'stratum', candidate_id, {N} FROM candidates WHERE trim(stratum) = ''""")
def d1(spark, sf):
    found = contracts.candidate_contract(inputs.candidates(spark, sf), ["ASIA", "EUROPE", "AFRICA"])
    return found.where("rule <> 'unique_place'")


@query("d1_unique_place", f"WITH {CANDIDATES}, c AS (SELECT floor(longitude / 15) * 15 AS longitude, floor(latitude / 15) * 15 AS latitude FROM candidates) SELECT printf('%.1f', longitude) || '|' || printf('%.1f', latitude) AS key, CAST(count(*) AS VARCHAR) AS detail FROM c GROUP BY longitude, latitude HAVING count(*) > 1")
def d1b(spark, sf):
    """Places on a lattice of fifteen degrees, where many meet."""
    snap = {c: (F.floor(F.col(c) / 15) * 15).cast("double") for c in ("longitude", "latitude")}
    return contracts.candidate_contract(inputs.candidates(spark, sf).withColumns(snap), []).where("rule = 'unique_place'").select("key", "detail")


@query("d2_block_leakage", f"WITH {CANDIDATES} SELECT 'one_split' AS rule, spatial_block AS key, min(stratum) || '|' || max(stratum) AS detail FROM candidates GROUP BY spatial_block HAVING min(stratum) <> max(stratum)")
def d2(spark, sf):
    return contracts.constant(inputs.candidates(spark, sf), ["spatial_block"], "stratum", "one_split")


@query("d3_year_universe", "WITH o AS (SELECT o_custkey, year(o_orderdate) AS y, o_orderstatus FROM orders), g AS (SELECT o_custkey, list_sort(list(DISTINCT y)) AS ys, count(*) AS n, count(DISTINCT o_orderstatus) AS m FROM o GROUP BY o_custkey) SELECT 'years' AS rule, CAST(o_custkey AS VARCHAR) AS key FROM g WHERE NOT (ys = [1995, 1996, 1997] AND n = 3) UNION ALL SELECT 'constant_meta', CAST(o_custkey AS VARCHAR) FROM g WHERE m <> 1")
def d3(spark, sf):
    o = inputs.table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    return contracts.years_contract(o, ["o_custkey"], "y", [1995, 1996, 1997], ["o_orderstatus"]).select("rule", "key")


@query("d4_observation_contract", f"""WITH {OBSERVATIONS} SELECT 'bands' AS rule, CAST(obs_id AS VARCHAR) AS key FROM observations WHERE NOT (value BETWEEN 0 AND 400 AND k BETWEEN 0 AND 400)
UNION ALL SELECT 'valid', CAST(obs_id AS VARCHAR) FROM observations WHERE valid <> (value <> 0 OR k <> 0)
UNION ALL SELECT 'identity', sample_id || '|' || epoch_day || '|' || orbit FROM observations GROUP BY sample_id, epoch_day, orbit HAVING count(*) > 1""")
def d4(spark, sf):
    return contracts.observation_contract(inputs.observations(spark, sf), 2, 0.0, 400.0).select("rule", "key")


@query("d5_reference_checks", "SELECT 'field' AS rule, CAST(l_orderkey AS VARCHAR) AS key FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) UNION ALL SELECT 'pixel', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem) UNION ALL SELECT 'line', l_orderkey || '|' || l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def d5(spark, sf):
    li = inputs.table(spark, sf, "lineitem")
    o = inputs.table(spark, sf, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    p = inputs.table(spark, sf, "part").withColumnRenamed("p_partkey", "l_partkey")
    parts = [contracts.references(li, "l_orderkey", o, "field"), contracts.references(p, "l_partkey", li, "pixel"), contracts.unique(li, ["l_orderkey", "l_linenumber"], "line")]
    return union(parts).select("rule", "key")


@query("d6_shard_contract", f"WITH {VECTORS} SELECT 'coordinate' AS rule, CAST(row_id AS VARCHAR) AS key FROM vectors WHERE abs(x / 20.0 - (row_id % 21) / 20.0) > 1e-10 UNION ALL SELECT 'row_id', CAST(row_id AS VARCHAR) FROM vectors WHERE NOT (y * 20 + x = row_id AND y >= 0)")
def d6(spark, sf):
    v = inputs.vectors(spark, sf)
    return violations(v, "row_id", {"coordinate": F.abs(F.col("x") / 20.0 - F.col("row_id") % 21 / 20.0) <= 1e-10, "row_id": (F.col("y") * 20 + F.col("x") == F.col("row_id")) & (F.col("y") >= 0)}).select("rule", "key")


@query("d7_complete_vectors", f"WITH {VECTORS} SELECT 'vector_of_outcome' AS rule, CAST(row_id AS VARCHAR) AS key, 'empty_window' AS detail FROM vectors WHERE row_id % 9 = 0 AND row_id % 2 = 0")
def d7(spark, sf):
    v = inputs.vectors(spark, sf).withColumn("outcome", F.when(F.col("row_id") % 9 == 0, "empty_window").otherwise("complete"))
    v = v.withColumn("v", F.when((F.col("row_id") % 9 != 0) | (F.col("row_id") % 2 == 0), F.col("v")))
    return contracts.complete_vector_contract(v, "row_id", "outcome", "v", 64)


@query("d8_counts_never_fall", f"WITH {OBSERVATIONS}, c AS (SELECT sample_id, epoch_day, count(*) AS n FROM observations GROUP BY ALL), l AS (SELECT *, lag(n) OVER (PARTITION BY sample_id ORDER BY epoch_day) AS p FROM c) SELECT 'never_falls' AS rule, sample_id || '|' || epoch_day AS key, CAST(p - n AS VARCHAR) AS detail FROM l WHERE n < p")
def d8(spark, sf):
    c = inputs.observations(spark, sf).groupBy("sample_id", "epoch_day").agg(F.count("*").alias("n"))
    return contracts.never_falls(c, ["sample_id"], "epoch_day", "n")


@query("d9_timeline_contract", f"WITH {OBSERVATIONS}, o AS (SELECT *, obs_id % 1000 AS oid, CASE WHEN obs_id % 11 = 0 THEN 3 ELSE 2 END AS width FROM observations) SELECT 'unique_observation' AS rule, sample_id || '|' || oid AS key FROM o GROUP BY sample_id, oid HAVING count(*) > 1 UNION ALL SELECT 'width', sample_id || '|' || oid FROM o WHERE width <> 2")
def d9(spark, sf):
    o = inputs.observations(spark, sf).withColumn("oid", F.col("obs_id") % 1000).withColumn("bands", F.when(F.col("obs_id") % 11 == 0, F.array("value", "k", "k")).otherwise(F.col("bands")))
    return contracts.timeline_contract(o, "sample_id", "oid", "epoch_day", 2).where("rule <> 'chronological'").select("rule", "key")


@query("d10_point_values", f"WITH {CANDIDATES} SELECT 'latitude' AS rule, candidate_id AS key FROM candidates WHERE latitude > 60 UNION ALL SELECT 'enum', candidate_id FROM candidates WHERE country = 'AMERICA'")
def d10(spark, sf):
    return violations(inputs.candidates(spark, sf), "candidate_id", {"latitude": F.col("latitude").between(-90, 60), "enum": F.col("country") != "AMERICA"}).select("rule", "key")


@query("d11_value_checks", "SELECT rule, key FROM (SELECT 'blank_text' AS rule, CAST(doc_id AS VARCHAR) AS key FROM documents WHERE trim(text) = '' UNION ALL SELECT 'length', CAST(doc_id AS VARCHAR) FROM documents WHERE n_chars < 40) ORDER BY rule, key LIMIT 10")
def d11(spark, sf):
    found = violations(inputs.table(spark, sf, "documents"), "doc_id", {"blank_text": F.trim("text") != "", "length": F.col("n_chars") >= 40})
    return found.select("rule", "key").orderBy("rule", "key").limit(10)  # the report shows the first ten


@query("d12_seed_extension", f"WITH {OBSERVATIONS}, s AS (SELECT max(epoch_day) AS a, min(epoch_day) AS b FROM observations) SELECT 'seed_before_cutoff' AS rule, CAST(a AS VARCHAR) AS key FROM s WHERE a >= 19735 UNION ALL SELECT 'extension_after_cutoff', CAST(b AS VARCHAR) FROM s WHERE b < 19735")
def d12(spark, sf):
    o = inputs.observations(spark, sf)
    return contracts.seed_contract(o, o, "epoch_day", 19735).select("rule", "key")


@query("d13_comparable_runs", "SELECT CAST((SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_orderstatus = 'F') = (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_orderstatus = 'P') AS BOOLEAN) AS same_classes, (SELECT min(o_orderdate) FROM orders WHERE o_orderstatus = 'F') = (SELECT min(o_orderdate) FROM orders WHERE o_orderstatus = 'P') AS same_start")
def d13(spark, sf):
    o = inputs.table(spark, sf, "orders")
    run = lambda s: o.where(F.col("o_orderstatus") == s).agg(F.count_distinct("o_orderpriority").alias(f"c{s}"), F.min("o_orderdate").alias(f"d{s}"))
    return run("F").crossJoin(run("P")).select((F.col("cF") == F.col("cP")).alias("same_classes"), (F.col("dF") == F.col("dP")).alias("same_start"))


@query("d14_constant_fingerprint", f"WITH {MEMBERSHIPS} SELECT 'fingerprint' AS rule, CAST(pixel AS VARCHAR) AS key, min(label) || '|' || max(label) AS detail FROM memberships GROUP BY pixel HAVING min(label) <> max(label)")
def d14(spark, sf):
    return contracts.constant(inputs.memberships(spark, sf), ["pixel"], "label", "fingerprint")


@query("d15_cardinality", f"WITH {WINDOWED} SELECT count(*) = 4 * count(DISTINCT row_id) AS full, count(*) = 3 * count(DISTINCT row_id) AS short FROM windowed")
def d15(spark, sf):
    w = inputs.windowed_vectors(spark, sf)
    a = w.agg((F.count("*") == 4 * F.count_distinct("row_id")).alias("full"), (F.count("*") == 3 * F.count_distinct("row_id")).alias("short"))
    return a


@query("d16_band_order", f"WITH {OBSERVATIONS}, r AS (SELECT *, (row_number() OVER (PARTITION BY sample_id ORDER BY obs_id) - 1) // 3 AS part FROM observations) SELECT CAST(sample_id AS VARCHAR) AS sample_id, part, list(kind ORDER BY obs_id) = ['click', 'view', 'purchase'] AS canonical FROM r GROUP BY ALL")
def d16(spark, sf):
    """The kinds of every three observations of a sample in a row stand for the bands of a stored array."""
    o = inputs.observations(spark, sf).withColumn("part", F.floor((F.row_number().over(Window.partitionBy("sample_id").orderBy("obs_id")) - 1) / 3))
    bands = F.transform(F.array_sort(F.collect_list(F.struct("obs_id", "kind"))), lambda x: x["kind"])  # three at most
    o = o.groupBy(F.col("sample_id").cast("string").alias("sample_id"), "part").agg(bands.alias("bands"))
    return contracts.band_order(o, "bands", ["click", "view", "purchase"]).select("sample_id", "part", "canonical")


@query("d17_missing_rate", f"WITH {OBSERVATIONS} SELECT 'missing_rate' AS rule, CAST(sample_id AS VARCHAR) AS key FROM observations GROUP BY sample_id HAVING avg(CASE WHEN valid THEN 0.0 ELSE 1.0 END) > 0.2")
def d17(spark, sf):
    return contracts.missing_rate(inputs.observations(spark, sf), ~F.col("valid"), 0.2, ["sample_id"]).select("rule", "key")


@query("d18_batch_contract", f"""WITH {VECTORS}, b AS (SELECT row_id % 40 AS batch, count(*) AS n, count(DISTINCT row_id) AS s, count(DISTINCT block) AS bl, bool_and(crop < 8) AS t FROM vectors GROUP BY 1)
SELECT 'two_samples' AS rule, CAST(batch AS VARCHAR) AS key FROM b WHERE s < 2 UNION ALL SELECT 'two_blocks', CAST(batch AS VARCHAR) FROM b WHERE bl < 2 UNION ALL SELECT 'unique_samples', CAST(batch AS VARCHAR) FROM b WHERE n <> s UNION ALL SELECT 'train_only', CAST(batch AS VARCHAR) FROM b WHERE NOT t""")
def d18(spark, sf):
    v = inputs.vectors(spark, sf).withColumn("batch", F.col("row_id") % 40).withColumn("split", F.when(F.col("crop") < 8, "train").otherwise("test"))
    return contracts.batch_contract(v, "batch", "row_id", "block", "split").select("rule", "key")


@query("d19_fold_leakage", f"WITH {MEMBERSHIPS}, m AS (SELECT *, pixel % 3 AS split FROM memberships) SELECT 'leak_field_uid' AS rule, CAST(field_uid AS VARCHAR) AS key FROM m GROUP BY field_uid HAVING min(split) <> max(split) UNION ALL SELECT 'leak_tile', CAST(tile AS VARCHAR) FROM m GROUP BY tile HAVING min(split) <> max(split)")
def d19(spark, sf):
    m = inputs.memberships(spark, sf).withColumn("split", F.col("pixel") % 3)
    return contracts.leakage(m, ["field_uid", "tile"], "split").select("rule", "key")


@query("d20_class_mapping", f"WITH {VECTORS} SELECT 'one_number' AS rule, CAST(crop AS VARCHAR) AS key FROM vectors GROUP BY crop HAVING min(field) <> max(field) UNION ALL SELECT 'contiguous', 'false' FROM vectors HAVING max(field) - min(field) + 1 <> count(DISTINCT field)")
def d20(spark, sf):
    v = inputs.vectors(spark, sf).withColumn("split", F.lit("train"))
    return contracts.class_mapping(v, "crop", "field", "split", ["train"]).where("rule <> 'one_label'").select("rule", "key")


@query("d21_private_pixels", f"WITH {MEMBERSHIPS}, m AS (SELECT field_uid, pixel * 10 + line AS pixel, label, line, tile FROM memberships), l AS (SELECT * FROM m WHERE field_uid NOT IN (SELECT field_uid FROM m WHERE tile % 7 = 0)), c AS (SELECT pixel FROM l GROUP BY pixel HAVING count(DISTINCT field_uid) = 1 AND count(DISTINCT label) = 1) SELECT field_uid, pixel, label, line FROM l WHERE pixel IN (SELECT pixel FROM c)")
def d21(spark, sf):
    """Parts times line numbers stand for pixels, so that many belong to few fields."""
    m = inputs.memberships(spark, sf).withColumn("pixel", F.col("pixel") * 10 + F.col("line"))
    return cohort.private_pixels(m, m.where("tile % 7 = 0"), "field_uid", "pixel", "label").select("field_uid", "pixel", "label", "line")


@query("d22_unambiguous_pixels", f"WITH {MEMBERSHIPS}, m AS (SELECT field_uid % 40000 AS pixel, label, line FROM memberships WHERE line <> 2), c AS (SELECT pixel FROM m GROUP BY pixel HAVING count(DISTINCT label) = 1) SELECT pixel, min(label) AS label, min(line) AS line FROM m WHERE pixel IN (SELECT pixel FROM c) GROUP BY pixel")
def d22(spark, sf):
    m = inputs.memberships(spark, sf).select((F.col("field_uid") % 40000).alias("pixel"), "label", "line")
    return cohort.unambiguous(m, "pixel", "label", F.col("line") != 2, [F.col("line")])[0]


@query("d22_collapse_audit", f"WITH {MEMBERSHIPS}, m AS (SELECT * FROM memberships WHERE line <> 2), c AS (SELECT field_uid, count(DISTINCT label) AS l FROM m GROUP BY field_uid) SELECT (SELECT count(*) FROM memberships) AS rows, (SELECT count(*) FROM memberships WHERE line = 2) AS bad, (SELECT count(*) FROM c WHERE l > 1) AS conflicts, (SELECT count(*) FROM c WHERE l = 1) AS kept")
def d22b(spark, sf):
    return cohort.unambiguous(inputs.memberships(spark, sf), "field_uid", "label", F.col("line") != 2, [F.col("line")])[1]


_COHORT = f"WITH {FIELDS}, g AS (SELECT geometry_sha256, count(DISTINCT landcover) > 1 AS conflict FROM fields GROUP BY 1), c AS (SELECT geometry_sha256, landcover, min(field_uid) AS canonical FROM fields GROUP BY 1, 2), f AS (SELECT * FROM fields JOIN g USING (geometry_sha256) JOIN c USING (geometry_sha256, landcover))"


@query("d23_cohort_attrition", _COHORT + " SELECT 'source' AS stage, 0 AS position, count(*) AS n FROM f UNION ALL SELECT 'no_conflict', 1, count(*) FROM f WHERE NOT conflict UNION ALL SELECT 'canonical', 2, count(*) FROM f WHERE NOT conflict AND field_uid = canonical UNION ALL SELECT 'long', 3, count(*) FROM f WHERE NOT conflict AND field_uid = canonical AND n_chars > 500")
def d23(spark, sf):
    f = cohort.canonical_fields(inputs.fields(spark, sf), "geometry_sha256", "landcover", "field_uid")
    a = f.where(~F.col("conflict"))
    b = a.where(F.col("field_uid") == F.col("canonical"))
    return cohort.attrition([("source", f), ("no_conflict", a), ("canonical", b), ("long", b.where("n_chars > 500"))], "field_uid")


@query("d24_scoreable_fields", f"WITH {MEMBERSHIPS}, f AS (SELECT label, field_uid, count(DISTINCT pixel) AS n FROM memberships GROUP BY ALL HAVING count(DISTINCT pixel) >= 4) SELECT label, count(*) AS fields, CAST(sum(n) AS BIGINT) AS pixels FROM f GROUP BY label HAVING count(*) >= 5 ORDER BY fields DESC, label LIMIT 3")
def d24(spark, sf):
    return cohort.scoreable(inputs.memberships(spark, sf), "field_uid", "pixel", "label", 4, 5, 3)


@query("d25_binding", "SELECT 'binding' AS rule, c_mktsegment AS key, CAST(count(*) AS VARCHAR) || '|' || CAST(count(*) FILTER (c_acctbal > 0) AS VARCHAR) AS detail FROM customer GROUP BY c_mktsegment HAVING count(*) <> count(*) FILTER (c_acctbal > 0)")
def d25(spark, sf):
    c = inputs.table(spark, sf, "customer")
    state = c.groupBy(F.col("c_mktsegment").alias("key")).agg(F.count("*").cast("string").alias("value"))
    want = c.groupBy(F.col("c_mktsegment").alias("key")).agg(F.count_if(F.col("c_acctbal") > 0).cast("string").alias("value"))
    return contracts.binding(state, want)


@query("d26_run_identity", "SELECT sha256('{\"rows\":' || count(*) || ',\"segments\":' || count(DISTINCT c_mktsegment) || ',\"version\":\"1\"}') AS fingerprint, true AS same FROM customer")
def d26(spark, sf):
    c = inputs.table(spark, sf, "customer").agg(F.count("*").alias("n"), F.count_distinct("c_mktsegment").alias("s"))
    own = F.sha2(hashing.canonical_json(rows="n", segments="s", version=F.lit("1")), 256)
    return c.select(own.alias("fingerprint"), (own == F.sha2(hashing.canonical_json(version=F.lit("1"), segments="s", rows="n"), 256)).alias("same"))


@query("d27_analysis_contract", "SELECT count(*) = count(DISTINCT c_custkey) AS same_keys, count(DISTINCT c_nationkey) = 25 AS same_places FROM customer")
def d27(spark, sf):
    c = inputs.table(spark, sf, "customer")
    return c.agg((F.count("*") == F.count_distinct("c_custkey")).alias("same_keys"), (F.count_distinct("c_nationkey") == 25).alias("same_places"))


