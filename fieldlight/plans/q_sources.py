"""Queries of sources and sinks (A): round trips through a shared folder."""

import re
import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators import contracts, geometry
from ..sources import bundles, commits, inventory, io, late
from . import inputs
from .inputs import CANDIDATES, ITEMS, OBSERVATIONS, VECTORS, WINDOWED
from .q_geometry import POLYS, polys
from .registry import query


def folder(spark) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


_COLUMNS = ["candidate_id", "country", "longitude", "latitude", "spatial_block", "stratum"]


@query("a1_candidate_csv", f"WITH {CANDIDATES} SELECT candidate_id, country, longitude, latitude, spatial_block, stratum FROM candidates")
def a1(spark, sf):
    path = folder(spark)
    io.write_csv(inputs.candidates(spark, sf), path)
    return io.read_csv(spark, path, io.CANDIDATE_DDL)


@query("a2_fixed_decimals", f"WITH {CANDIDATES} SELECT candidate_id, printf('%.10f', longitude / 3) AS longitude FROM candidates")
def a2(spark, sf):
    path = folder(spark)
    io.write_csv(inputs.candidates(spark, sf).select("candidate_id", (F.col("longitude") / 3).alias("longitude")), path)
    return io.read_csv(spark, path, "candidate_id string, longitude string")


def manifest(spark, sf):
    c = inputs.candidates(spark, sf).select(*_COLUMNS, F.lit(1.0).alias("inclusion_probability"), F.lit("train").alias("spatial_split"), F.lit("train").alias("year_split"), F.lit(2024).alias("year"))
    return io.manifest_rows(c).select(*[x.split()[0] for x in io.MANIFEST_DDL.split(", ")])


@query("a3_manifest_identity", f"WITH {CANDIDATES} SELECT candidate_id FROM candidates WHERE c_custkey % 10 = 0")
def a3(spark, sf):
    path = folder(spark)
    m = manifest(spark, sf).withColumn("sample_id", F.when(F.col("candidate_id").cast("long") % 10 == 0, F.concat(F.col("candidate_id"), F.lit("!"))).otherwise(F.col("sample_id")))
    io.write_csv(m, path)
    return io.checked_manifest(io.read_csv(spark, path, io.MANIFEST_DDL)).select(F.regexp_replace("key", "!", "").alias("candidate_id"))


@query("a4_write_once", "SELECT count(*) AS first, count(*) AS again, true AS refused FROM customer")
def a4(spark, sf):
    path = folder(spark)
    m = manifest(spark, sf)
    first, again = io.write_once(m, path), io.write_once(m.repartition(3), path)
    try:
        io.write_once(m.withColumn("year", F.lit(2023)), path)
        refused = False
    except contracts.ContractError:
        refused = True
    return spark.read.parquet(path).agg(F.lit(first).cast("long").alias("first"), F.lit(again).cast("long").alias("again"), F.lit(refused).alias("refused"))


def stored_observations(spark, sf):
    o = inputs.observations(spark, sf).where("valid")
    first = o.groupBy("sample_id", "epoch_day").agg(F.min_by(F.struct("obs_id", "k"), "obs_id").alias("f"))
    return first.select(
        F.col("sample_id").cast("string").alias("sample_id"), F.lit("KE").alias("country"), F.year(F.date_from_unix_date("epoch_day")).alias("year"), "epoch_day",
        F.dayofyear(F.date_from_unix_date("epoch_day")).alias("day_of_year"), F.col("f.obs_id").cast("string").alias("source_item_id"), F.sha2(F.col("f.obs_id").cast("string"), 256).alias("source_item_sha256"),
        F.lit("q").alias("catalog_query_sha256"), F.array_repeat(F.col("f.k").cast("int"), 10).alias("bands"), F.lit(4).alias("scl"), F.lit(True).alias("valid"),
    )


_STORE = f"WITH {OBSERVATIONS}, f AS (SELECT sample_id, epoch_day, min(obs_id) AS obs_id, arg_min(k, obs_id) AS k FROM observations WHERE valid GROUP BY ALL)"


@query("a5_store_schema", _STORE + " SELECT count(*) AS rows, 10 AS bands, 11 AS columns, true AS refused FROM f")
def a5(spark, sf):
    """Rows stored under one sensor's schema: its band order and columns come back, and the other sensor's reader refuses them."""
    path = folder(spark)
    io.write_observations(stored_observations(spark, sf), path, "s2", 4)
    got = io.read_observations(spark, path, "s2")
    try:
        io.read_observations(spark, path, "s1").limit(1).collect()
        refused = False
    except contracts.ContractError:
        refused = True
    bands = io.observation_schema("s2")["bands"].metadata["bands"]
    return got.where(F.size("bands") == len(bands)).agg(F.count("*").alias("rows")).select("rows", F.lit(len(bands)).alias("bands"), F.lit(len(got.columns)).alias("columns"), F.lit(refused).alias("refused"))


@query("a6_observation_store", _STORE + " SELECT CAST(sample_id AS VARCHAR) AS sample_id, epoch_day, CAST(obs_id AS VARCHAR) AS source_item_id, CAST(k AS INTEGER) AS b3 FROM f")
def a6(spark, sf):
    path = folder(spark)
    io.write_observations(stored_observations(spark, sf), path, "s2", 4)
    return io.read_observations(spark, path, "s2").select("sample_id", "epoch_day", "source_item_id", F.col("bands")[2].alias("b3"))


@query("a7_verified_scan", _STORE + " SELECT CAST(sample_id AS VARCHAR) AS sample_id, count(*) AS n FROM f GROUP BY 1")
def a7(spark, sf):
    path = folder(spark)
    io.write_observations(stored_observations(spark, sf), path, "s2", 4)
    o = io.read_observations(spark, path, "s2")
    contracts.enforce(contracts.violations(o, "source_item_id", {"calendar": F.dayofyear(F.date_from_unix_date("epoch_day")) == F.col("day_of_year")}))
    return o.groupBy("sample_id").agg(F.count("*").alias("n"))


def snapshots(spark, sf):
    i = inputs.items(spark, sf).select(F.concat(F.lit("q"), "tile").alias("query"), F.struct(F.col("item_id").alias("id"), F.date_format("acquired", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"), "doc").alias("i"))
    return i.groupBy("query").agg(F.collect_list("i").alias("items"))


@query("a8_catalog_snapshots", f"WITH {ITEMS} SELECT 'q' || tile AS query, item_id AS id, acquired, sha256(doc) AS digest FROM items")
def a8(spark, sf):
    path = folder(spark)
    snapshots(spark, sf).write.json(path)
    s = spark.read.schema("query string, items array<struct<id:string,datetime:string,doc:string>>").option("mode", "FAILFAST").json(path)
    return io.catalog_items(s).select("query", "id", F.col("acquired").cast("timestamp_ntz").alias("acquired"), "digest")


def damaged_catalog(spark, sf):
    """(snapshots, expected, raw): one snapshot per order and year of shipping; orders are damaged in twelve ways by their number modulo 13.

    Lines meet by order and year as they are in the table; their summaries, which are many times as long, are made after that.
    """
    li = inputs.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate")
    z, at = F.col("l_orderkey") % 13, F.col("l_shipdate")
    west, south = (F.col("l_partkey") % 300 - 150).cast("double"), (F.col("l_suppkey") % 120 - 60).cast("double")
    text = lambda t: F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(z == 10, "").otherwise("Z"))
    lines = lambda rows: rows.select(
        "l_orderkey", z.alias("z"), "ship_year", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.lit("lines").alias("collection"),
        F.when(z == 9, F.array(west + 10, south, west, south + 8)).otherwise(F.array(west, south, west + 10, south + 8)).alias("bbox"), text(at).alias("datetime"),
        text(F.when(z == 12, at.cast("timestamp_ntz") + F.expr("INTERVAL 1 SECOND")).otherwise(at.cast("timestamp_ntz"))).alias("raw_datetime"), F.concat(F.lit("part/"), "l_partkey").alias("href"), F.col("l_returnflag").alias("orbit"),
    )
    doc = F.to_json(F.struct("id", "collection", "bbox", F.create_map(F.lit("B1"), F.struct("href")).alias("assets"), F.create_map(F.lit("datetime"), F.col("raw_datetime"), F.lit("orbit"), F.col("orbit")).alias("properties")))
    told = lambda i: i.withColumn("raw", doc).withColumn("digest", F.sha2("raw", 256))
    raw = told(lines(li.where(z != 4).withColumn("ship_year", F.year(at)))).select(F.unhex("digest").alias("digest"), F.when(F.col("z") == 3, F.concat("raw", F.lit(" "))).otherwise(F.col("raw")).alias("doc")).dropDuplicates(["digest"])
    summary = F.struct(
        F.when(F.col("z") == 6, F.concat("id", F.lit("?"))).otherwise(F.col("id")).alias("id"), "collection", "bbox", "datetime", F.create_map(F.lit("B1"), F.when(F.col("z") == 8, "other").otherwise(F.col("href"))).alias("assets"),
        F.create_map(F.lit("orbit"), F.when(F.col("z") == 7, "?").otherwise(F.col("orbit"))).alias("properties"), F.when(F.col("z") == 5, "xyz").otherwise(F.col("digest")).alias("raw_item_sha256"),
    )
    met = li.withColumn("ship_year", F.year(at)).repartition("l_orderkey", "ship_year")
    s = told(lines(met)).groupBy("l_orderkey", "ship_year").agg(F.collect_list(summary).alias("items"))  # the lines of one order
    s = s.select(F.concat_ws("-", "l_orderkey", "ship_year").alias("query"), (F.col("l_orderkey") % 13).alias("z"), "ship_year", "items")
    s = s.select("query", "z", F.lit(1).alias("schema_version"), F.lit("s2").alias("modality"), F.col("query").alias("tile"), (F.col("ship_year") + (F.col("z") == 11).cast("int")).alias("year"), F.lit("lines").alias("collection"), F.array(F.lit("B1")).alias("band_order"), "items")
    expected = s.select("query", *bundles.IDENTITY)
    s = s.withColumn("modality", F.when(F.col("z") == 2, "s1").otherwise(F.col("modality"))).withColumn("doc", F.to_json(F.struct(*bundles.IDENTITY, "items")))
    return s.select("query", "doc", F.when(F.col("z") == 1, "0").otherwise(F.sha2("doc", 256)).alias("receipt")), expected, raw


_LINES = "lines AS (SELECT l_orderkey % 13 AS z, l_orderkey || '-' || year(l_shipdate) AS query, l_orderkey || '-' || l_linenumber AS id, l_shipdate FROM lineitem)"


@query("a8_snapshot_rules", f"""WITH {_LINES} SELECT CASE z WHEN 1 THEN 'receipt' ELSE 'identity' END AS rule, query AS key FROM lines WHERE z IN (1, 2) GROUP BY z, query UNION ALL
SELECT CASE z WHEN 3 THEN 'raw_corrupt' WHEN 4 THEN 'raw_missing' WHEN 5 THEN 'digest' WHEN 6 THEN 'raw_identity' WHEN 7 THEN 'properties' WHEN 8 THEN 'assets' WHEN 9 THEN 'bbox' WHEN 10 THEN 'datetime' WHEN 11 THEN 'year' ELSE 'raw_datetime' END,
 query || '|' || id || CASE z WHEN 6 THEN '?' ELSE '' END FROM lines WHERE z >= 3""")
def a8b(spark, sf):
    """Every rule of snapshots and items, found in the orders that break it and in no others."""
    return bundles.catalog_snapshot(*damaged_catalog(spark, sf))[1].select("rule", "key")


@query("a8_verified_items", f"WITH {_LINES} SELECT query, id, CAST(l_shipdate AS TIMESTAMP) AS acquired FROM lines WHERE z = 0")
def a8c(spark, sf):
    """The items of the snapshots of undamaged orders, after the check."""
    snapshots_, expected, raw = damaged_catalog(spark, sf)
    sound = F.substring_index("query", "-", 1).cast("long") % 13 == 0
    items, told = bundles.catalog_snapshot(snapshots_.where(sound), expected.where(sound), raw)
    contracts.enforce(told)
    return items.select("query", "id", F.col("acquired").cast("timestamp_ntz").alias("acquired"))


@query("a9_documents_once", f"WITH {ITEMS} SELECT DISTINCT sha256(doc) AS digest FROM items WHERE sha256(doc) NOT IN (SELECT sha256(doc) FROM items WHERE tile < 5)")
def a9(spark, sf):
    i = inputs.items(spark, sf).select(F.col("tile").alias("query"), F.col("item_id").alias("id"), F.sha2("doc", 256).alias("digest"), "doc")
    old, _ = io.store_documents(i.where("query < 5"))
    return io.store_documents(i, old)[0].select("digest")


@query("a10_ingest_rules", f"WITH {ITEMS} SELECT item_id, doc, CASE WHEN quantity < 10 THEN 'assets' WHEN orbit = 'N' THEN 'orbit' END AS reason FROM items")
def a10(spark, sf):
    return io.accepted(inputs.items(spark, sf), {"assets": F.col("quantity") >= 10, "orbit": F.col("orbit") != "N"}).select("item_id", "doc", "reason")


@query("a11_snapshot_cache", "SELECT DISTINCT o_custkey % 50 AS tile FROM orders WHERE o_custkey % 50 >= 20")
def a11(spark, sf):
    t = inputs.tasks(spark, sf).select("tile").distinct().withColumn("query_key", F.sha2(F.col("tile").cast("string"), 256))
    return io.tiles_to_load(t, t.where("tile < 20"), "tile").select("tile")


@query("a12_deduped_items", f"WITH {ITEMS} SELECT item_id, min(acquired) AS acquired FROM items WHERE acquired >= TIMESTAMP '1996-01-01' AND acquired < TIMESTAMP '1998-01-01' GROUP BY item_id HAVING count(DISTINCT doc) = 1")
def a12(spark, sf):
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return io.deduped_items(inputs.items(spark, sf), "item_id", "doc", "acquired", at("1996-01-01"), at("1998-01-01"))[0].select("item_id", "acquired")


@query("a13_polygon_table", f"WITH {POLYS} SELECT k AS field_uid, s_name AS label, k % 50 <> 0 AS valid, CASE WHEN k % 50 <> 0 THEN round((x1 - x0) * (y1 - y0), 6) END AS area FROM polys JOIN supplier ON s_suppkey = k")
def a13(spark, sf):
    """Ground truth stored under its own column names, every fiftieth geometry broken: read by configured names, with status and area."""
    p = polys(spark, sf).join(inputs.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), "s_name"), "k")
    geom = F.when(F.col("k") % 50 == 0, F.concat(F.lit("POINT "), "wkt")).otherwise(F.col("wkt"))
    path = folder(spark)
    p.select(F.col("k").alias("Field ID"), F.col("s_name").alias("Crop"), geom.alias("geom")).write.parquet(path)
    t = io.polygon_table(spark.read.parquet(path), {"field_uid": "Field ID", "label": "Crop", "wkt": "geom"})
    t = t.withColumn("valid", geometry.geometry_status(F.col("wkt")).isNull())
    area = geometry.boxes(geometry.edges(t.where("valid"), "field_uid"), "field_uid").select("field_uid", F.round("area", 6).alias("area"))
    return t.join(area, "field_uid", "left").select("field_uid", "label", "valid", "area")


@query("a14_run_bound_table", "SELECT 'column' AS rule, 'absent' AS key UNION ALL SELECT 'row_count', 'false' FROM supplier HAVING count(*) <> 7 UNION ALL SELECT 'same_run', 'other'")
def a14(spark, sf):
    s = io.run_bound(inputs.table(spark, sf, "supplier"), "mine")
    s = s.withColumn("run_fingerprint", F.when(F.col("s_suppkey") % 9 == 0, "other").otherwise("mine"))
    return io.of_run(s, "mine", 7, ["s_name", "absent"]).select("rule", "key")


def embedding_rows(spark, sf):
    w = inputs.windowed_vectors(spark, sf)
    gone = (F.col("row_id") % 10 == 0) & (F.col("w") == 1)
    return w.select(F.sha2(F.concat_ws(":", "row_id", "w"), 256).alias("id"), "row_id", F.concat(F.lit("w"), "w").alias("window_id"), F.when(gone, "empty_window").otherwise("complete").alias("outcome"), F.when(~gone, F.col("v")).alias("embedding"))


@query("a15_embedding_sink", f"WITH {WINDOWED} SELECT 'w' || w AS window_id, count(*) AS rows, count(*) FILTER (NOT (row_id % 10 = 0 AND w = 1)) AS vectors FROM windowed GROUP BY 1")
def a15(spark, sf):
    path = folder(spark)
    rows = embedding_rows(spark, sf)
    contracts.enforce(contracts.unique(rows, ["id"]))
    rows.write.partitionBy("window_id").parquet(path)
    return spark.read.parquet(path).groupBy("window_id").agg(F.count("*").alias("rows"), F.count("embedding").alias("vectors"))


@query("a16_window_scan", f"WITH {VECTORS} SELECT row_id, CASE WHEN row_id % 10 = 0 THEN 'empty_window' ELSE 'complete' END AS outcome FROM vectors")
def a16(spark, sf):
    path = folder(spark)
    embedding_rows(spark, sf).write.partitionBy("window_id").parquet(path)
    return spark.read.parquet(path).where("window_id = 'w1'").select("row_id", "outcome")


@query("a17_late_vectors", f"WITH {VECTORS} SELECT row_id, round(v[1], 6) AS head FROM vectors WHERE block = 2")
def a17(spark, sf):
    """Vectors of one block's rows, from a store whose other folders are not opened."""
    v = inputs.vectors(spark, sf)
    store = late.BucketStore(folder(spark), "row_id", ("block",), 64)
    store.write(v.select("row_id", "block", "v"))
    return store.fetch(v.where("block = 2").select("row_id", "block"), ["v"]).select("row_id", F.round(F.col("v")[0], 6).alias("head"))


def _nation_files(spark, sf) -> str:
    """One text file a nation, of its suppliers' names in order."""
    path = folder(spark)
    s = inputs.table(spark, sf, "supplier").select("s_nationkey", "s_name")
    s.repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_name").write.partitionBy("s_nationkey").text(path)
    return path


def _nation(path: str = "path"):
    return F.regexp_extract(path, "s_nationkey=([0-9]+)/", 1)


@query("a18_file_inventory", "SELECT s_nationkey, CAST(sum(strlen(s_name) + 1) AS BIGINT) AS n_bytes, sha256(string_agg(s_name, chr(10) ORDER BY s_name) || chr(10)) AS sha256 FROM supplier GROUP BY 1")
def a18(spark, sf):
    """Digests of files, of which those over 200 bytes are read in blocks."""
    inv = inventory.file_inventory(spark, _nation_files(spark, sf), whole=200)
    return inv.select(_nation().cast("long").alias("s_nationkey"), "n_bytes", "sha256")


@query("a18_receipt_rules", "SELECT CASE s_nationkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'extra' WHEN 2 THEN 'n_bytes' ELSE 'sha256' END AS rule, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier WHERE s_nationkey % 5 < 4 GROUP BY s_nationkey")
def a18b(spark, sf):
    """Files against a receipt with entries for lost files, without some, and with wrong lengths and digests."""
    inv = inventory.file_inventory(spark, _nation_files(spark, sf), whole=200)
    kind = _nation().cast("int") % 5
    receipt = inv.where(kind != 1).withColumns({"n_bytes": F.col("n_bytes") + (kind == 2).cast("int"), "sha256": F.when(kind == 3, F.reverse("sha256")).otherwise(F.col("sha256"))})
    return inventory.against_receipt(inv.where(kind != 0), receipt).select("rule", _nation("key").alias("nation"))


@query("a19_timeline_round_trip", f"WITH {OBSERVATIONS} SELECT obs_id, sample_id, epoch_day FROM observations")
def a19(spark, sf):
    path = folder(spark)
    inputs.observations(spark, sf).select("obs_id", "sample_id", "epoch_day", "bands", "valid").withColumn("tile", F.col("sample_id") % 4).write.partitionBy("tile").parquet(path)
    return spark.read.parquet(path).select("obs_id", "sample_id", "epoch_day")


@query("a20_analysis_export", f"WITH {WINDOWED} SELECT 'w' || w AS window_id, count(*) AS n FROM windowed GROUP BY 1")
def a20(spark, sf):
    path = folder(spark)
    rows = embedding_rows(spark, sf)
    rows.select("row_id", "window_id", "outcome").write.partitionBy("window_id").parquet(f"{path}/scores")
    io.receipt_row(rows, {"rows": F.count("*")}).write.text(f"{path}/manifest")
    return spark.read.parquet(f"{path}/scores").groupBy("window_id").agg(F.count("*").alias("n"))


@query("a21_dataset_manifest", f"WITH {VECTORS} SELECT '{{\"rows\":' || count(*) || ',\"classes\":' || count(DISTINCT crop) || '}}' AS receipt FROM vectors")
def a21(spark, sf):
    return io.receipt_row(inputs.vectors(spark, sf), {"rows": F.count("*"), "classes": F.count_distinct("crop")})


@query("a22_single_run_scan", "SELECT s_suppkey, s_nationkey FROM supplier")
def a22(spark, sf):
    """A finished root: every partition has its marker, its rows are counted and all are of one run."""
    path = folder(spark)
    commits.resumed(inputs.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), path, ["s_nationkey"], "r1")
    return commits.committed(spark, path, ["s_nationkey"]).select("s_suppkey", F.col("s_nationkey").cast("long").alias("s_nationkey"))


@query("a22_unfinished_partitions", "SELECT 'marker' AS rule, '{\"s_nationkey\":\"' || s_nationkey || '\"}' AS key FROM supplier WHERE s_nationkey % 5 = 1 GROUP BY s_nationkey UNION ALL "
       "SELECT 'rows', '{\"s_nationkey\":\"' || s_nationkey || '\"}' FROM supplier WHERE s_nationkey % 5 = 2 GROUP BY s_nationkey HAVING count(*) > 1 UNION ALL SELECT 'one_run', 'r1' FROM (SELECT 1) WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey % 5 = 3)")
def a22b(spark, sf):
    """A root with partitions whose writer stopped before the marker, partitions that lost rows, and partitions of another run."""
    path = folder(spark)
    s = inputs.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    part = lambda n: s.where(F.col("s_nationkey") % 5 == n)
    commits.resumed(s.where(F.col("s_nationkey") % 5 == 0).unionByName(part(2)).unionByName(part(4)), path, ["s_nationkey"], "r1")
    commits.resumed(part(3), path, ["s_nationkey"], "r2")
    commits.write_data(part(1), path, ["s_nationkey"])
    commits.write_data(part(2).groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s_suppkey")), path, ["s_nationkey"])
    return commits.unfinished(spark, path, ["s_nationkey"]).select("rule", "key")


@query("a23_evidence_cross_check", "SELECT 'extra' AS side, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def a23(spark, sf):
    o = inputs.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    li = inputs.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    return contracts.same_rows(li, o, "ids").groupBy(F.col("detail").alias("side")).agg(F.count("*").alias("n")).where("side = 'extra'")


@query("a23_pack_rules", f"""WITH {WINDOWED} SELECT 'windows' AS rule, '{{"window_id":"w' || w || '"}}' AS key, 'missing' AS detail FROM windowed WHERE w = 4 GROUP BY w UNION ALL SELECT 'windows', '{{"window_id":"w5"}}', 'extra' FROM vectors HAVING count(*) > 0 UNION ALL
SELECT 'fields', CAST(row_id AS VARCHAR), 'missing' FROM vectors WHERE row_id % 7 = 1 UNION ALL SELECT 'fields', CAST(-row_id AS VARCHAR), 'extra' FROM vectors WHERE row_id % 7 = 2 UNION ALL SELECT 'one_report', CAST(row_id AS VARCHAR), '2' FROM vectors WHERE row_id % 7 = 3 UNION ALL
SELECT 'columns', 'scores.evidence_threshold', NULL FROM vectors HAVING count(*) > 0 UNION ALL SELECT 'complete', 'figures_complete', NULL FROM vectors HAVING count(*) FILTER (row_id % 7 = 1) > 0""")
def a23b(spark, sf):
    """An exported pack of tables and JSON documents, read back, that breaks every rule but that of the run: a field is a row id."""
    path, v = folder(spark), inputs.vectors(spark, sf)
    kind = F.col("row_id") % 7
    embedding_rows(spark, sf).select(F.col("row_id").alias("field_uid"), "window_id", "outcome").write.parquet(f"{path}/scores")
    copies = F.when(kind == 1, F.array().cast("array<long>")).when(kind == 2, F.array("row_id", -F.col("row_id"))).when(kind == 3, F.array("row_id", "row_id")).otherwise(F.array("row_id"))
    v.select(F.explode(copies).alias("field_uid")).write.json(f"{path}/reports")
    n = v.agg(F.count_if(kind == 1).alias("lost"))
    n.select(F.lit("r1").alias("analysis_id"), F.lit(True).alias("gallery_complete"), (F.col("lost") == 0).alias("figures_complete")).write.json(f"{path}/completion")
    n.select(F.lit("r1").alias("analysis_id"), F.array(*[F.lit(f"w{i}") for i in (1, 2, 3, 5)]).alias("windows")).write.json(f"{path}/manifest")
    read = lambda name, ddl: spark.read.schema(ddl).option("mode", "FAILFAST").json(f"{path}/{name}")
    return bundles.pack_violations(
        read("completion", "analysis_id string, gallery_complete boolean, figures_complete boolean"), read("manifest", "analysis_id string, windows array<string>"), read("reports", "field_uid long"),
        {"scores": spark.read.parquet(f"{path}/scores")}, {"scores": ["field_uid", "window_id", "evidence_threshold"]}, "scores",
    )


@query("a24_newest_finalised", f"WITH {ITEMS} SELECT tile, arg_max(item_id, (acquired, item_id)) AS item_id FROM items GROUP BY tile")
def a24(spark, sf):
    return io.newest(inputs.items(spark, sf), ["tile"], "item_id", "acquired")


@query("a25_land_cover_lookup", f"WITH {CANDIDATES} SELECT candidate_id, CAST((CAST(floor(longitude) AS BIGINT) * 31 + CAST(floor(latitude) AS BIGINT) * 17) % 11 AS BIGINT) AS land FROM candidates")
def a25(spark, sf):
    c = inputs.candidates(spark, sf).withColumns({"col": F.floor("longitude"), "row": F.floor("latitude")})
    cells = c.select("row", "col").distinct().withColumn("land", (F.col("col") * 31 + F.col("row") * 17) % 11)
    return io.lookup_cells(c, cells, ["row", "col"], "land", list(range(11)))[0].select("candidate_id", "land")


@query("a26_receipt", f"WITH {CANDIDATES} SELECT '{{\"rows\":' || count(*) || ',\"blocks\":' || count(DISTINCT spatial_block) || ',\"excluded\":' || count(*) FILTER (latitude < -60) || '}}' AS receipt FROM candidates")
def a26(spark, sf):
    return io.receipt_row(inputs.candidates(spark, sf), {"rows": F.count("*"), "blocks": F.count_distinct("spatial_block"), "excluded": F.count_if(F.col("latitude") < -60)})


@query("a27_plot_index", f"WITH {inputs.FIELDS} SELECT field_uid, CASE WHEN field_uid % 3 = 0 THEN 'reports/' || field_uid END AS path, CASE WHEN field_uid % 3 <> 0 THEN CASE WHEN n_chars < 500 THEN 'too_small' ELSE 'not_selected' END END AS reason FROM fields")
def a27(spark, sf):
    f = inputs.fields(spark, sf)
    r = f.where("field_uid % 3 = 0").select("field_uid", F.concat(F.lit("reports/"), "field_uid").alias("path"))
    return io.plot_index(f, r, "field_uid", F.when(F.col("n_chars") < 500, "too_small").otherwise("not_selected")).select("field_uid", "path", "reason")
