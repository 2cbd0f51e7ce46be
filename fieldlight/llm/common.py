"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Set here only where the session has none and all run in one process (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: The folder that scratch() has opened in this thread.
_OPEN: ContextVar[str | None] = ContextVar("scratch", default=None)


def _folder(spark: SparkSession, what: str, base: str | None = None) -> str:
    return f"{base or _OPEN.get() or shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, _folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored inside, in this thread, goes to a folder of its own, removed at the end, with or without an exception."""
    path = _folder(spark, "scratch")
    before = _OPEN.set(path)
    try:
        yield
    finally:
        _OPEN.reset(before)
        _remove(spark, path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of each query that runs inside when the query ends, not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Tables:
    """Stored tables of one call, which it can remove when no later job reads them.

    They lie where tables were stored when it was made, also if a scratch() is opened later.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.own, self.base = spark, [], _OPEN.get() or shared_dir(spark)

    def stored(self, df: DataFrame, what: str) -> DataFrame:
        path = _folder(self.spark, what, self.base)
        self.own.append((path, None))  # a write that fails may leave a part
        df.write.option("compression", "zstd").parquet(path)
        self.own[-1] = path, self.spark.read.parquet(path)
        return self.own[-1][1]

    def clear(self, *but: DataFrame) -> None:
        """Removes all tables but these."""
        gone = [(p, df) for p, df in self.own if not any(df is x for x in but)]
        self.own = [x for x in self.own if x not in gone]
        for path, _ in gone:
            _remove(self.spark, path)


def packed_up(df: DataFrame, apart: str) -> DataFrame:
    """All columns but one as the struct _doc, beside that one as _text: no name of df can clash with an operator's own."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != apart]
    return df.select(F.struct(*(rest or [F.lit(0).alias("_none")])).alias("_doc"), F.col(f"`{apart}`").alias("_text"))


def unpacked_as(df: DataFrame, apart: str) -> list[Column]:
    """The columns of df again, from what packed_up made of it."""
    return [F.col("_text").alias(c) if c == apart else F.col("_doc")[c].alias(c) for c in df.columns]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def extended(schema: StructType, ddl: str) -> StructType:
    """schema with the columns of a DDL string after it."""
    return StructType(schema.fields + StructType.fromDDL(ddl).fields)


def ascii_lower(column: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of each text of an Arrow batch; null is empty."""
    return [t or b"" for t in batch.column(name).cast(pa.string()).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in parts of few rows, so that the Python objects of only one part are alive."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_columns(docs: DataFrame, text_col: str, ddl: str, types: list[pa.DataType], make: Callable) -> DataFrame:
    """Adds the columns of ddl, made in Arrow batches; other columns pass through as they are.

    make() is called once per task and returns a function from a list of texts (bytes) to one
    sequence of values per new column. Columns of docs with these names are replaced.
    """
    names = StructType.fromDDL(ddl).names
    docs = docs.drop(*names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = make()
        for batch in slices(batches):
            new = [pa.array(v, t) for v, t in zip(values(texts_of(batch, text_col)), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])
        pa.default_memory_pool().release_unused()  # workers are used again by other stages

    return docs.mapInArrow(each, extended(docs.schema, ddl))
