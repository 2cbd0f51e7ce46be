"""Partition commits: a partition counts only when its completion marker stands beside it.

Data is written with dynamic partition overwrite, and only then one marker row per partition, with its rows and the run, to a table of
markers. A writer that stops between the two, or inside the data, leaves partitions without a marker: resumed() writes just those again, and
committed() refuses to read a table that has any, or whose rows are not those of its markers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import enforce, union, violations


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def _markers(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(f"{path}/markers") if exists(spark, f"{path}/markers") else None


def _name(keys: list[str]):
    """One text for a partition, whatever the types of its keys."""
    return F.to_json(F.struct(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys]))


def write_data(df: DataFrame, path: str, keys: list[str]) -> None:
    """The first half: partitions of df replace those of the same keys; rows of a partition go to one task each."""
    df.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{path}/data")


def write_markers(df: DataFrame, path: str, keys: list[str], run: str) -> None:
    """The second half: one marker a partition, from the rows that were to be written."""
    marks = df.groupBy(*keys).agg(F.count("*").alias("rows")).select(_name(keys).alias("partition"), "rows", F.lit(run).alias("run"))
    marks = marks.withColumn("part", F.sha2("partition", 256))
    marks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/markers")


def resumed(df: DataFrame, path: str, keys: list[str], run: str) -> None:
    """Writes the partitions of df that have no marker of this run, then their markers."""
    done = _markers(df.sparkSession, path)
    left = df if done is None else df.join(done.where(F.col("run") == run).select(F.col("partition").alias("_p")), _name(keys) == F.col("_p"), "left_anti")
    write_data(left, path, keys)
    write_markers(left, path, keys, run)


def unfinished(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Violations: partitions without a marker or of which rows are missing or too many, markers without rows, more than one run."""
    there = spark.read.parquet(f"{path}/data").groupBy(_name(keys).alias("partition")).agg(F.count("*").alias("found"))
    done = _markers(spark, path)
    done = done.select("partition", "rows", "run") if done is not None else spark.createDataFrame([], "partition string, rows long, run string")
    both = there.join(done, "partition", "full")
    rules = {"marker": F.col("found").isNull() | F.col("rows").isNotNull(), "data": F.col("found").isNotNull(), "rows": F.coalesce(F.col("found") == F.col("rows"), F.lit(True))}
    runs = done.agg(F.min("run").alias("a"), F.max("run").alias("b"))
    return union([violations(both, "partition", rules), violations(runs, "a", {"one_run": F.coalesce(F.col("a") == F.col("b"), F.lit(True))})])


def committed(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The table, if every partition is finished and all are of one run; else a contract error that names the first faults."""
    enforce(unfinished(spark, path, keys))
    return spark.read.parquet(f"{path}/data")
