"""Sources and sinks with contracts: schemas are stated, content is fingerprinted, nothing is replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, ByteType, IntegerType, ShortType, StringType, StructField, StructType

from ..functions.hashing import stable_id
from ..operators.contracts import ContractError, enforce, unique, violations
from .commits import exists

CANDIDATE_DDL = "candidate_id string, country string, longitude double, latitude double, spatial_block string, stratum string"
MANIFEST_DDL = (
    "sample_id string, candidate_id string, country string, longitude double, latitude double, spatial_block string, stratum string, "
    "inclusion_probability double, spatial_split string, year_split string, year int"
)
S2_BANDS = ("B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B11", "B12")
S1_BANDS = ("VV", "VH")


def read_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """CSV by name: fails where a required column is missing; other columns are not read."""
    head = spark.read.option("header", True).csv(path).columns
    want = StructType.fromDDL(ddl)
    if missing := [n for n in want.names if n not in head]:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    raw = spark.read.option("header", True).option("mode", "FAILFAST").schema(StructType([StructField(n, StringType()) for n in head])).csv(path)
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want.fields])


def write_csv(df: DataFrame, path: str, decimals: int = 10) -> None:
    """Doubles printed to a fixed number of decimals; an existing path is an error."""
    shown = [F.format_string(f"%.{decimals}f", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*shown).write.option("header", True).mode("errorifexists").csv(path)


def manifest_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("sample_id", stable_id("country", "candidate_id", F.col("year").cast("string")))


def checked_manifest(df: DataFrame) -> DataFrame:
    """Violations: rows whose sample_id is not that of their own columns."""
    return violations(df, "sample_id", {"sample_id": F.col("sample_id") == stable_id("country", "candidate_id", F.col("year").cast("string"))})


def content_fingerprint(df: DataFrame) -> tuple[str, int]:
    """(digest, rows) of a table's rows in any order: sums of row digests, so nothing is gathered."""
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)"))
    row = df.agg(*[part(i).alias(f"p{i}") for i in range(5)], F.count("*").alias("n")).head()
    return "-".join(str(row[f"p{i}"] or 0) for i in range(5)), row.n


def write_once(df: DataFrame, path: str, partition_by: list[str] | None = None) -> int:
    """Writes Parquet where nothing is; the same content there is fine, other content an error. Returns the rows."""
    spark = df.sparkSession
    mine = content_fingerprint(df)
    if exists(spark, path):
        if content_fingerprint(spark.read.parquet(path).select(df.columns)) != mine:
            raise ContractError(f"{path} holds other content")
        return mine[1]
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return mine[1]


def observation_schema(modality: str) -> StructType:
    """Schema of the observation store; the order of bands is in the field's metadata."""
    bands = S2_BANDS if modality == "s2" else S1_BANDS
    item = IntegerType() if modality == "s2" else ShortType()
    own = StructField("scl", ShortType()) if modality == "s2" else StructField("orbit", ByteType())
    names = [("sample_id", StringType()), ("country", StringType()), ("year", ShortType()), ("epoch_day", IntegerType()), ("day_of_year", ShortType()), ("source_item_id", StringType()), ("source_item_sha256", StringType()), ("catalog_query_sha256", StringType())]
    return StructType([*[StructField(n, t) for n, t in names], StructField("bands", ArrayType(item), metadata={"bands": list(bands)}), own, StructField("valid", BooleanType())])


def write_observations(df: DataFrame, path: str, modality: str, files: int) -> int:
    """Typed, in canonical order inside files, partitioned by country and year, never replaced."""
    schema = observation_schema(modality)
    typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema.fields])
    order = ["sample_id", "epoch_day", "source_item_id"]
    laid = typed.repartition(files, "country", "year", F.pmod(F.xxhash64("sample_id"), F.lit(files))).sortWithinPartitions("country", "year", *order)
    laid.write.mode("errorifexists").option("compression", "zstd").partitionBy("country", "year").parquet(path)
    return df.sparkSession.read.parquet(path).count()


def read_observations(spark: SparkSession, path: str, modality: str) -> DataFrame:
    """The store as written; another sensor's columns or band order, and violations of identity, raise."""
    want, there = observation_schema(modality), spark.read.parquet(path).schema
    if set(there.names) != set(want.names) or there["bands"].metadata.get("bands") != want["bands"].metadata["bands"]:
        raise ContractError(f"the stored schema is not that of {modality}")
    df = spark.read.schema(want).parquet(path)
    enforce(unique(df, ["sample_id", "epoch_day", *(["orbit"] if modality == "s1" else [])], "identity"))
    return df


def catalog_items(snapshots: DataFrame) -> DataFrame:
    """(query, id, acquired, digest, doc) of nested snapshot rows (query, items: array of id, datetime, doc), in UTC order inside partitions."""
    i = snapshots.select("query", F.explode("items").alias("i"))
    return i.select("query", F.col("i.id").alias("id"), F.to_timestamp("i.datetime").alias("acquired"), F.sha2("i.doc", 256).alias("digest"), F.col("i.doc").alias("doc"))


def store_documents(items: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new documents by digest, references (query, id, digest)): each document is stored once."""
    docs = items.select("digest", "doc").dropDuplicates(["digest"])
    if existing is not None:
        docs = docs.join(existing.select("digest"), "digest", "left_anti")
    return docs, items.select("query", "id", "digest")


def accepted(items: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Items with accepted and the first rule that they break as reason."""
    reason = None
    for name, ok in rules.items():
        bad = ~F.coalesce(ok, F.lit(False))
        reason = F.when(bad, name) if reason is None else reason.when(bad, name)
    return items.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def tiles_to_load(tiles: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Tiles without a cached snapshot of the same query; a cached one of another query is an error."""
    both = tiles.join(cache.select(key, F.col("query_key").alias("_k")), key)
    enforce(violations(both, key, {"same_query": F.col("query_key") == F.col("_k")}))
    return tiles.join(cache, key, "left_anti")


def deduped_items(items: DataFrame, key: str, doc: str, when: str, start: Column, end: Column) -> tuple[DataFrame, DataFrame]:
    """(one row per id inside the time range, ids whose copies differ)."""
    inside = items.where((F.col(when) >= start) & (F.col(when) < end))
    n = inside.groupBy(key).agg(F.count_distinct(doc).alias("docs"), F.min(when).alias(when), F.min(doc).alias(doc))
    return n.where("docs = 1").drop("docs"), n.where("docs > 1").select(key, "docs")


def polygon_table(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """A table of polygons under standard names; names maps standard to own."""
    if missing := [own for own in names.values() if own not in df.columns]:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(own).alias(std) for std, own in names.items()])


def run_bound(df: DataFrame, fingerprint: str) -> DataFrame:
    return df.withColumn("run_fingerprint", F.lit(fingerprint))


def of_run(df: DataFrame, fingerprint: str, rows: int, columns: list[str]) -> DataFrame:
    """Violations of a shard: rows of another run, a wrong number of rows, missing columns."""
    from ..operators.contracts import cardinality

    found = violations(df, "run_fingerprint", {"same_run": F.col("run_fingerprint") == fingerprint}).distinct()
    found = found.unionByName(cardinality(df, F.count("*") == rows, "row_count"))
    absent = [(c,) for c in columns if c not in df.columns]
    if absent:
        found = found.unionByName(df.sparkSession.createDataFrame(absent, "key string").select(F.lit("column").alias("rule"), "key", F.lit(None).cast("string").alias("detail")))
    return found


def lookup_cells(points: DataFrame, cells: DataFrame, keys: list[str], value: str, known: list[int]) -> tuple[DataFrame, DataFrame]:
    """(points with the class of their cell, violations for cells that are missing or of an unknown class)."""
    got = points.join(cells, keys, "left")
    return got, violations(got, keys, {"known_class": F.col(value).isin(known)}, F.col(value))


def receipt_row(df: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """One row of JSON with named counts."""
    return df.agg(*[c.alias(k) for k, c in counts.items()]).select(F.to_json(F.struct("*")).alias("receipt"))


def plot_index(source: DataFrame, reports: DataFrame, key: str, reason: Column) -> DataFrame:
    """Every source row with the path of its report or the reason why there is none."""
    return source.join(reports, key, "left").withColumn("reason", F.when(F.col("path").isNull(), reason))


def newest(df: DataFrame, group: list[str], path: str, when: str) -> DataFrame:
    """The newest path of each group, the greater name among equals."""
    return df.groupBy(*group).agg(F.max_by(path, F.struct(when, path)).alias(path))
