"""Files under a root with their sizes and digests, and their comparison with a receipt."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files up to so many bytes are values of Spark's; larger ones are read in blocks.
WHOLE_BYTES, BLOCK_BYTES = 1 << 26, 1 << 23


def located(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path as Spark writes it, and the name there."""
    scheme = urlsplit(path).scheme
    system, name = (fs.LocalFileSystem(), path.removeprefix("file:")) if scheme in ("", "file") else fs.FileSystem.from_uri(path)
    return system, "/" + name.lstrip("/") if name.startswith("//") else name


def _digest(path: str) -> str:
    """SHA-256 of a file, of which one block is in memory at a time."""
    system, name = located(path)
    seen = hashlib.sha256()
    with system.open_input_stream(name, compression=None, buffer_size=0) as data:
        while block := data.read(BLOCK_BYTES):
            seen.update(block)
    return seen.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(_digest, batch["path"].to_pylist()), pa.string())], names=["path", "n_bytes", "sha256"])


def file_inventory(spark: SparkSession, root: str, pattern: str = "*", whole: int = WHOLE_BYTES) -> DataFrame:
    """(path below root, n_bytes, sha256) of all files at any depth whose name fits the pattern; hidden ones (with _ or . before) are left out.

    Files of any size, empty ones too: Spark reads those of up to `whole` bytes, in tasks by size; a larger one is a task of its own, which reads it in
    blocks from a file system that both Spark and Arrow know (local, HDFS, S3, GCS). Listing does not read contents.
    """
    there = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = there.getFileSystem(spark._jsc.hadoopConfiguration())
    below = len(system.makeQualified(there).toString()) + 2
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    small = files.where(F.col("length") <= whole).select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole).select("path", F.col("length").alias("n_bytes")).mapInArrow(_digests, "path string, n_bytes long, sha256 string")
    # Scans leave empty files out; the index that the driver holds for the scan has them.
    names = [(unquote(f).replace("file:///", "file:/"),) for f in files.inputFiles()]
    empty = spark.createDataFrame(names, "path string").join(files.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("n_bytes"), F.sha2(F.lit(b""), 256).alias("sha256"))
    return small.unionByName(large).unionByName(empty).withColumn("path", F.expr(f"substring(path, {below})"))


def against_receipt(inventory: DataFrame, receipt: DataFrame) -> DataFrame:
    """Files that are missing, not in the receipt (extra), of another length (n_bytes) or of other content (sha256)."""
    r = receipt.select("path", F.col("n_bytes").alias("_n"), F.col("sha256").alias("_s"), F.lit(True).alias("_there"))
    both = inventory.withColumn("_found", F.lit(True)).join(r, "path", "full")
    rule = F.when(F.col("_found").isNull(), "missing").when(F.col("_there").isNull(), "extra").when(~F.col("n_bytes").eqNullSafe(F.col("_n")), "n_bytes").when(~F.col("sha256").eqNullSafe(F.col("_s")), "sha256")
    return both.select(rule.alias("rule"), F.col("path").alias("key"), F.lit(None).cast("string").alias("detail")).where("rule IS NOT NULL")
