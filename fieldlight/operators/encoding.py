"""Batch encoding of windows by a user's function, with content-keyed reuse."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import bucket_size
from .joins import observations_in_windows

#: Windows of one call; the result has a row for each key and window, so more of them go in further calls.
MOST_WINDOWS = 1000
#: Series whose results are held at once.
SERIES_ROWS = 256
Encoder = Callable[[np.ndarray, np.ndarray], np.ndarray]  # (observations, bands), days -> vector


def summary_encoder(bands: np.ndarray, days: np.ndarray) -> np.ndarray:
    """Mean and deviation of each band, and the mean day."""
    return np.r_[bands.mean(0), bands.std(0), days.mean()]


def windows_of(obs: DataFrame, windows: DataFrame, key: str, day: str, bands: str, item: str) -> DataFrame:
    """(key, w, series, n, bucket, content_key): one row per key and window, empty windows kept."""
    rows = windows.select("w", "start", "end").limit(MOST_WINDOWS + 1).collect()
    if len(rows) > MOST_WINDOWS:
        raise ValueError(f"more than {MOST_WINDOWS} windows")
    listed = F.array(*[F.struct(*[F.lit(v).cast(windows.schema[c].dataType).alias(c) for c, v in r.asDict().items()]) for r in rows])
    every = obs.select(key).distinct().select(key, F.inline(listed)) if rows else obs.select(key).limit(0).join(windows.select("w", "start", "end").limit(0), F.lit(True))
    got = observations_in_windows(obs, windows, day)
    series = F.sort_array(F.collect_list(F.struct(F.col(day).alias("day"), F.col(item).alias("item"), F.col(bands).alias("bands"))))
    got = got.groupBy(key, "w").agg(series.alias("series"))
    out = every.join(got, [key, "w"], "left").withColumn("n", F.coalesce(F.size("series"), F.lit(0)))
    out = out.withColumn("n", F.greatest(F.col("n"), F.lit(0)))
    content = F.sha2(F.to_json(F.struct(F.col(key).alias("key"), "start", "end", "series")), 256)
    return out.withColumns({"bucket": bucket_size(F.col("n")), "content_key": content})


def _series(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bands, days) of each series, as views of the Arrow batch: no Python object an observation."""
    flat = column.flatten()
    days = flat.field("day").cast(pa.float64()).to_numpy(zero_copy_only=False)
    bands = flat.field("bands")
    values = bands.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    widths = bands.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.r_[0, np.cumsum(np.maximum(widths, 0))]
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    for a, z in zip(np.r_[0, ends[:-1]], ends, strict=True):
        if (widths[a:z] != max(widths[a], 0)).any():
            raise ValueError("the observations of a series must have the same number of bands")
        yield values[at[a] : at[z]].reshape(z - a, -1), days[a:z]


def encoded(rows: DataFrame, key: str, encode: Encoder = summary_encoder) -> DataFrame:
    """(key, w, content_key, outcome, vector); windows of one bucket come together, empty ones have no vector."""
    kind = rows.schema[key].dataType.simpleString()
    full = rows.where("n > 0").repartition("bucket", F.pmod(F.xxhash64(key, "w"), F.lit(64)))  # a bucket may hold most rows

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SERIES_ROWS):
                batch = whole.slice(at, SERIES_ROWS)
                out = pa.array([encode(bands.copy(), days.copy()).tolist() for bands, days in _series(batch.column("series"))], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.select([key, "w", "content_key"]).columns, pa.array(["complete"] * batch.num_rows), out], names=[key, "w", "content_key", "outcome", "vector"])
        pa.default_memory_pool().release_unused()

    ddl = f"`{key}` {kind}, w int, content_key string, outcome string, vector array<double>"
    done = full.select(key, "w", "content_key", "series").mapInArrow(each, ddl)
    empty = rows.where("n = 0").select(key, "w", "content_key", F.lit("empty_window").alias("outcome"), F.lit(None).cast("array<double>").alias("vector"))
    return done.unionByName(empty)


def incremental(rows: DataFrame, known: DataFrame, key: str, encode: Encoder = summary_encoder) -> DataFrame:
    """Results for all rows: those whose content key is known are taken over, the others encoded."""
    old = known.select("content_key", "outcome", "vector").dropDuplicates(["content_key"])
    reused = rows.join(old, "content_key").select(key, "w", "content_key", "outcome", "vector", F.lit(True).alias("reused"))
    fresh = encoded(rows.join(old, "content_key", "left_anti"), key, encode).withColumn("reused", F.lit(False))
    return reused.unionByName(fresh)


def put_results(results: DataFrame, path: str) -> None:
    """Appends results to the table at path whose content is not there yet; a key with another result is an error."""
    new = results.select("content_key", "outcome", "vector")
    old = get_results(results.sparkSession, path)
    if old is not None:
        if new.join(old, "content_key").where(~(new["outcome"].eqNullSafe(old["outcome"]) & new["vector"].eqNullSafe(old["vector"]))).limit(1).count():
            raise ValueError("a stored result differs")
        new = new.join(old, "content_key", "left_anti")
    new.dropDuplicates(["content_key"]).write.mode("append").parquet(path)


def get_results(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored results by content key, or None where nothing was put."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None
