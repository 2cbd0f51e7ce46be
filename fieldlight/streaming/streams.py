"""Windows over event streams, with the same results as the batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.aggregates import upsert
from ..operators.joins import dealt
from ..sources.commits import exists


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of one table as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def rolling(df: DataFrame, keys: list[str], ts: str, width: str, step: str, late: str, value: str) -> DataFrame:
    """Count and sum per rolling window; on a stream, rows later than `late` are dropped by the watermark."""
    out = df.withWatermark(ts, late).groupBy(F.window(ts, width, step), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total")


def sessions(df: DataFrame, keys: list[str], ts: str, gap: str, late: str) -> DataFrame:
    out = df.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(df: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """First row per id within the watermark."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def drained(df: DataFrame, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there (available now) into a Parquet table beside its checkpoint and reads it."""
    spark = df.sparkSession
    where = f"{checkpoint}/{uuid.uuid4().hex}"
    q = df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{where}/state").option("path", f"{where}/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{where}/rows")


def window_table(spark: SparkSession, start: int, stop: int, width: int, step: int) -> DataFrame:
    """Rolling windows of days that fit before stop."""
    last = (stop - width - start) // step
    r = spark.range(max(last + 1, 0))
    return r.select(F.col("id").cast("int").alias("w"), (start + F.col("id") * step).cast("int").alias("start"), (start + F.col("id") * step + width).cast("int").alias("end"))


def touched(late: DataFrame, windows: DataFrame, key: str, day: str) -> DataFrame:
    """(key, w): exactly the windows that late rows fall into."""
    from ..operators.joins import observations_in_windows

    return observations_in_windows(late.select(key, day), windows, day).select(key, "w").distinct()


def recomputed(old: DataFrame, rows: DataFrame, late: DataFrame, windows: DataFrame, key: str, day: str, item: str, value: str) -> DataFrame:
    """Window results after late rows: only the windows touched are computed again, from rows with the late ones put in."""
    from ..operators.joins import observations_in_windows

    now = upsert(rows, late, item)
    hit = touched(late, windows, key, day)
    fresh = observations_in_windows(now.join(hit.select(key).distinct(), key, "left_semi"), windows, day).join(hit, [key, "w"], "left_semi")
    fresh = fresh.groupBy(key, "w").agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return old.join(hit, [key, "w"], "left_anti").unionByName(fresh)


#: Parts of a state table; a batch reads and rewrites only those that its keys fall into.
BUCKETS = 64


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _touched(batch: DataFrame) -> list[int]:
    """Parts that a batch touches: no more than there are."""
    return [r.bucket for r in batch.select("bucket").distinct().collect()]


def _state(spark: SparkSession, path: str, schema, buckets: list[int]) -> DataFrame:
    """The named parts of a state table partitioned by bucket, read by their folders; an empty one before the first batch."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).where(F.col("bucket").isin(buckets) if buckets else F.lit(False))


def _replace(df: DataFrame, path: str, *parts: str) -> None:
    """Rewrites exactly the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def micro_batches(stream: DataFrame, state: str, results: str, windows: DataFrame, key: str, day: str, item: str, value: str, checkpoint: str, buckets: int = BUCKETS) -> None:
    """Window results kept up to date by foreachBatch: equal to the batch form over all rows, in any order of files.

    Rows and results are tables partitioned by a hash of the key. A batch reads the parts of its own keys, puts its rows in (the later
    one of an item wins), computes the windows they fall into again and rewrites those parts alone. Both steps give the same
    when they are repeated, so a batch that stopped half-way is simply applied again.
    """
    spark = stream.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        batch = batch.dropDuplicates([item]).withColumn("bucket", _bucket(key, buckets)).persist()
        try:
            mine = _touched(batch)
            if not mine:
                return
            rows = upsert(_state(spark, state, batch.schema, mine), batch, item)
            _replace(rows, state, "bucket")
            kept = _state(spark, state, batch.schema, mine)
            ddl = f"{key} {batch.schema[key].dataType.simpleString()}, w int, n long, total double, bucket int"
            old = _state(spark, results, StructType.fromDDL(ddl), mine).drop("bucket")
            now = recomputed(old, kept.drop("bucket"), batch.drop("bucket"), windows, key, day, item, value)
            _replace(now.withColumn("bucket", _bucket(key, buckets)).select(*StructType.fromDDL(ddl).names), results, "bucket")
        finally:
            batch.unpersist()

    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def accepted_once(stream: DataFrame, accepted: str, conflicts: str, key: str, content: list[str], checkpoint: str, buckets: int = BUCKETS) -> None:
    """Arriving rows by id: the first content of an id goes to accepted, the same again nowhere, other content to conflicts.

    The digest of an id's content is kept beside the accepted rows, in tables partitioned by a hash of the id and the batch, of which a
    batch reads only the parts of its own ids. Of several contents of a new id in one batch that with the least digest is
    first. A repeated batch rewrites its own partitions. No id is forgotten, however late its next row comes.
    """
    spark = stream.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
        # digests are large beside their rows, and repeats, first contents and known ones all meet by id: one shuffle, whose tasks are not merged
        rows = dealt(batch, [key]).withColumns({"digest": digest, "bucket": _bucket(key, buckets)}).dropDuplicates([key, "digest"]).withColumn("batch", F.lit(number).cast("long")).persist()
        try:
            mine = _touched(rows)
            known = _state(spark, accepted, rows.schema, mine).where(F.col("batch") < number).select(key, F.col("digest").alias("_known"))
            first = F.min("digest").over(Window.partitionBy(key))
            judged = rows.join(known, key, "left").withColumn("_first", F.coalesce("_known", first))
            _replace(judged.where("_known IS NULL AND digest = _first").select(*rows.columns), accepted, "bucket", "batch")
            _replace(judged.where("digest <> _first").select(*rows.columns), conflicts, "bucket", "batch")
        finally:
            rows.unpersist()

    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
