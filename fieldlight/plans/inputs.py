"""How the driver's tables stand in for the shapes that the operators take: DataFrames and the same as SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import dealt


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Points: candidate_id, country, spatial_block, stratum, longitude, latitude."""
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(
        F.col("c_custkey").cast("string").alias("candidate_id"), F.col("r_name").alias("country"), F.col("n_name").alias("spatial_block"),
        F.col("c_mktsegment").alias("stratum"), (F.col("c_custkey") % 360 - 180 + F.lit(0.5)).alias("longitude"),
        (F.col("c_custkey") * 7 % 170 - 85 + F.lit(0.5)).alias("latitude"), "c_custkey",
    )


CANDIDATES = """candidates AS (SELECT CAST(c_custkey AS VARCHAR) AS candidate_id, r_name AS country, n_name AS spatial_block, c_mktsegment AS stratum,
 CAST(c_custkey % 360 - 180 + 0.5 AS DOUBLE) AS longitude, CAST(c_custkey * 7 % 170 - 85 + 0.5 AS DOUBLE) AS latitude, c_custkey
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """Observations: obs_id, sample_id, acquired, epoch_day, valid, orbit, bands."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        F.col("event_id").alias("obs_id"), F.col("user_id").alias("sample_id"), F.col("ts").alias("acquired"), F.unix_date(F.to_date("ts")).alias("epoch_day"),
        (F.col("event_type") != "error").alias("valid"), F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1).alias("orbit"),
        F.array(F.col("value"), k).alias("bands"), "value", k.alias("k"), F.col("event_type").alias("kind"),
    )


OBSERVATIONS = """observations AS (SELECT event_id AS obs_id, user_id AS sample_id, ts AS acquired, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch_day,
 event_type <> 'error' AS valid, CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END AS orbit, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type AS kind FROM events)"""


def fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields: field_uid, geometry_sha256, landcover, lang, n_chars."""
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("field_uid"), F.sha2("text", 256).alias("geometry_sha256"),
        F.when(F.substring("source", 4, 9).cast("int") % 2 == 0, "maize").otherwise("maize/beans").alias("landcover"), "lang", "source", "n_chars",
    )


FIELDS = """fields AS (SELECT doc_id AS field_uid, sha256(text) AS geometry_sha256, CASE WHEN CAST(substr(source, 4) AS INTEGER) % 2 = 0 THEN 'maize' ELSE 'maize/beans' END AS landcover,
 lang, source, n_chars FROM documents)"""


def memberships(spark: SparkSession, sf: str) -> DataFrame:
    """Field-pixel rows: field_uid, pixel, label, line."""
    li, o = dealt(table(spark, sf, "lineitem"), ["l_orderkey"]), dealt(table(spark, sf, "orders"), ["o_orderkey"])
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("field_uid"), F.col("l_partkey").alias("pixel"), F.col("o_orderpriority").alias("label"), F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("tile"),
    )


MEMBERSHIPS = """memberships AS (SELECT l_orderkey AS field_uid, l_partkey AS pixel, o_orderpriority AS label, l_linenumber AS line, l_suppkey AS tile
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Pixel vectors: row_id, crop, field, x, y, block, v (array of double)."""
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").alias("row_id"), F.col("label").cast("int").alias("crop"), (F.col("label") * 100 + F.col("vec_id") % 5).cast("int").alias("field"),
        (F.col("vec_id") % 20).alias("x"), F.floor(F.col("vec_id") / 20).alias("y"), (F.col("vec_id") % 7).cast("int").alias("block"),
        F.col("embedding").cast("array<double>").alias("v"),
    )


VECTORS = """vectors AS (SELECT vec_id AS row_id, CAST(label AS INTEGER) AS crop, CAST(label * 100 + vec_id % 5 AS INTEGER) AS field, vec_id % 20 AS x, CAST(floor(vec_id / 20) AS BIGINT) AS y,
 CAST(vec_id % 7 AS INTEGER) AS block, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""


def windowed_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors in four windows; window w turns them a little further."""
    w = F.explode(F.sequence(F.lit(1), F.lit(4))).alias("w")
    turned = F.transform("v", lambda x, i: x * (1 + F.col("w") * (i % 3) / 10))
    return vectors(spark, sf).select("*", w).withColumn("v", turned)


WINDOWED = VECTORS + """, windowed AS (SELECT row_id, crop, field, x, y, block, CAST(w AS INTEGER) AS w, list_transform(v, lambda e, i: e * (1 + w * ((i - 1) % 3) / 10)) AS v
 FROM vectors, (SELECT unnest(range(1, 5)) AS w))"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rows: row_id, truth, score, block, n."""
    d, lb = table(spark, sf, "documents"), table(spark, sf, "labels")
    h = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 4), 16, 10).cast("double") / 65536
    score = F.round((h + F.col("quality") * 0.5) / 1.5, 2)
    return lb.join(d, "doc_id").select(F.col("doc_id").alias("row_id"), F.col("quality").cast("int").alias("truth"), score.alias("score"), (F.col("doc_id") % 20).cast("int").alias("block"), F.col("n_chars").alias("n"), "lang")


PREDICTIONS = """predictions AS (SELECT doc_id AS row_id, CAST(quality AS INTEGER) AS truth,
 round((CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 4) AS UBIGINT)::DOUBLE / 65536 + quality * 0.5::DOUBLE) / 1.5::DOUBLE, 2) AS score,
 CAST(doc_id % 20 AS INTEGER) AS block, n_chars AS n, lang FROM labels JOIN documents USING (doc_id))"""


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Task states: task_id, tile, status, attempts, due, outcome."""
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "P", "running").otherwise("pending")
    return o.select(
        F.col("o_orderkey").alias("task_id"), (F.col("o_custkey") % 50).alias("tile"), status.alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("attempts"),
        F.col("o_orderdate").alias("due"), F.concat(F.lit('{"outcome":"'), F.when(F.col("o_orderkey") % 3 == 0, "complete").otherwise("insufficient"), F.lit('"}')).alias("meta"),
    )


TASKS = """tasks AS (SELECT o_orderkey AS task_id, o_custkey % 50 AS tile, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'P' THEN 'running' ELSE 'pending' END AS status,
 CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS attempts, o_orderdate AS due, CASE WHEN o_orderkey % 3 = 0 THEN 'complete' ELSE 'insufficient' END AS outcome FROM orders)"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog items: item_id, tile, acquired, orbit, lon/lat box, doc."""
    li = table(spark, sf, "lineitem")
    west, south = F.col("l_partkey") % 300 - 150.0, F.col("l_suppkey") % 120 - 60.0
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item_id"), (F.col("l_orderkey") % 50).alias("tile"), F.col("l_shipdate").alias("acquired"),
        F.col("l_returnflag").alias("orbit"), west.alias("west"), south.alias("south"), (west + 10).alias("east"), (south + 8).alias("north"),
        F.concat_ws("|", "l_partkey", "l_suppkey", "l_linestatus").alias("doc"), F.col("l_quantity").cast("int").alias("quantity"),
    )


ITEMS = """items AS (SELECT l_orderkey || '-' || l_linenumber AS item_id, l_orderkey % 50 AS tile, l_shipdate AS acquired, l_returnflag AS orbit,
 CAST(l_partkey % 300 - 150 AS DOUBLE) AS west, CAST(l_suppkey % 120 - 60 AS DOUBLE) AS south, CAST(l_partkey % 300 - 140 AS DOUBLE) AS east, CAST(l_suppkey % 120 - 52 AS DOUBLE) AS north,
 l_partkey || '|' || l_suppkey || '|' || l_linestatus AS doc, CAST(l_quantity AS INTEGER) AS quantity FROM lineitem)"""
