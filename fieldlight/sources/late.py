"""Heavy columns fetched late: a store in hash buckets, of which a join reads only those that hold selected rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class BucketStore:
    """Rows laid out by a hash of the columns `by`, in folders `bucket=N` that Spark prunes as partitions.

    `by` are columns that selections have too: the row id, or coarser ones by which rows are selected together, so that
    a selection falls into few buckets. A null counts as a value. The number of buckets is part of the path, so that a store cannot be read with another.
    """

    path: str
    key: str
    by: tuple[str, ...]
    buckets: int = 256

    @property
    def data(self) -> str:
        return f"{self.path}/{'-'.join(self.by)}-{self.buckets}"

    def bucket(self) -> Column:
        """Hashes texts, so that an id is in the same bucket whatever its integer type."""
        return F.pmod(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in self.by]), F.lit(self.buckets)).cast("int")

    def write(self, df: DataFrame) -> None:
        """Splits large buckets and joins small ones by size (rebalance), so a hot value of `by` is not one task; sorted by key inside files."""
        if "bucket" in df.columns:
            raise ValueError("a stored table has no column bucket of its own")
        laid = df.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").sortWithinPartitions("bucket", self.key)
        laid.write.mode("errorifexists").option("compression", "zstd").partitionBy("bucket").parquet(self.data)

    def read(self, spark: SparkSession, schema: StructType | None = None) -> DataFrame:
        """The whole store; with a schema (bucket int included) no file is opened for it."""
        return (spark.read.schema(schema) if schema else spark.read).parquet(self.data)

    def fetch(self, selected: DataFrame, columns: list[str], schema: StructType | None = None) -> DataFrame:
        """Selected rows with these columns of the store.

        What is broadcast are the buckets that the selection falls into, at most `buckets` integers whatever its size; they prune the
        store's folders at run time. Then rows meet by the columns `by` and the key. Rows that the store lacks are left out; repeated ones stay repeated.
        """
        keys = list(dict.fromkeys([*self.by, self.key]))
        # Spark prunes at run time only by sides with a comparison in them; a bucket is never negative.
        wanted = selected.select(self.bucket().alias("bucket")).where("bucket >= 0").distinct()
        near = self.read(selected.sparkSession, schema).join(F.broadcast(wanted), "bucket").select(*[F.col(c).alias(f"_s_{c}") for c in keys], *columns)
        same = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in keys]
        return selected.join(near, same).drop(*[f"_s_{c}" for c in keys])
