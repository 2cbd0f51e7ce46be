"""Raster samples as a data source: landed rasters and the points asked of them, one task a tile and file of points."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .inventory import located

SCHEMA = "tile string, item string, asset string, point string, value double"
RASTERS = ["tile", "item", "asset", "west", "north", "step", "width", "values"]
REQUESTS = ["tile", "item", "point", "x", "y"]
#: Points in a file, so that what a task holds does not grow with its tile; values that make up one batch; cells and rasters looked at at a time.
FILE_POINTS, BATCH_VALUES, BATCH_CELLS, BATCH_RASTERS = 500_000, 50_000, 4_000_000, 8192
#: Bytes of a row group, which a reader holds whole.
GROUP_BYTES = 8 << 20


def land(rasters: DataFrame, requests: DataFrame, path: str, file_points: int = FILE_POINTS, values: Column | None = None) -> None:
    """Writes both tables by tile, in ranges of items and sorted by them, so that a file of points reads the row groups of its items only.

    rasters: tile, item, asset, west, north, step, width, values (row by row from the top); requests: tile, item, point, x, y. Tiles and
    items are texts here. Rows without one of them answer nothing and are left out. Ranges split large tiles, and items of many points.
    values: made of other columns of rasters where a raster is written, so that its cells are not shuffled.
    """
    for name, rows, columns in (("rasters", rasters, RASTERS), ("requests", requests, REQUESTS)):
        made = values is not None and name == "rasters"
        rows = rows.select(*(rows.columns if made else columns)).withColumns({c: F.col(c).cast("string") for c in ("tile", "item")}).where("tile <> '' AND item IS NOT NULL")
        if name == "requests":
            rows = rows.withColumn("point", F.col("point").cast("string"))
        ranges = rows.repartitionByRange("tile", "item", "asset" if name == "rasters" else "point")
        laid = ranges.sortWithinPartitions("tile", "item")
        laid = (laid.withColumn("values", values).select(*columns) if made else laid).write.partitionBy("tile").option("compression", "zstd").option("parquet.block.size", GROUP_BYTES)
        laid.option("maxRecordsPerFile", file_points).mode("errorifexists").parquet(f"{path}/{name}")


@dataclass
class TileFile(InputPartition):
    """A file of points and all raster files of its tile."""

    tile: str
    requests: str
    rasters: tuple[str, ...]


class RasterSamples(DataSource):
    """Format `raster_samples`: (tile, item, asset, point, value) of the store that `land` wrote to the option path."""

    @classmethod
    def name(cls) -> str:
        return "raster_samples"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SampleReader(self.options["path"])


class SampleReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.wanted: dict[str, set | None] = {"tile": None, "asset": None}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equalities and lists of tiles choose the files to read, those of assets the rows; Spark applies all others."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in self.wanted and isinstance(f, (EqualTo, In)):
                some = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted[name] = some if self.wanted[name] is None else self.wanted[name] & some
            else:
                yield f

    def _files(self, name: str) -> dict[str, list[str]]:
        system, root = located(f"{self.path}/{name}")
        found: dict[str, list[str]] = {}
        for folder in system.get_file_info(fs.FileSelector(root)):
            tile = unquote(folder.base_name.removeprefix("tile="))
            if folder.type == fs.FileType.Directory and folder.base_name.startswith("tile=") and (self.wanted["tile"] is None or tile in self.wanted["tile"]):
                found[tile] = [f.path for f in system.get_file_info(fs.FileSelector(folder.path)) if f.base_name.endswith(".parquet")]
        return found

    def partitions(self) -> list[InputPartition]:
        rasters = self._files("rasters")
        return [TileFile(tile, file, tuple(rasters[tile])) for tile, files in self._files("requests").items() if tile in rasters for file in files]

    def read(self, partition: TileFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a store without rows has no files
            return
        system, _ = located(self.path)
        asked = pq.ParquetFile(partition.requests, filesystem=system).read(["item", "point", "x", "y"]).sort_by("item").combine_chunks()
        if asked.num_rows == 0:
            return
        runs = pc.run_end_encode(_whole(asked["item"]))
        names, ends = runs.values, runs.run_ends.to_numpy().astype(np.int64)
        first, count = np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)
        x, y = (asked[c].cast(pa.float64()).to_numpy() for c in ("x", "y"))
        points = _whole(asked["point"])
        where = (ds.field("item") >= names[0]) & (ds.field("item") <= names[-1])
        if self.wanted["asset"] is not None:
            where &= ds.field("asset").isin(pa.array(sorted(self.wanted["asset"]), pa.string()))
        data = ds.dataset(list(partition.rasters), format="parquet", filesystem=system)
        for rasters in data.to_batches(columns=RASTERS[1:], filter=where, batch_size=BATCH_RASTERS, batch_readahead=1, fragment_readahead=1):
            at = pc.index_in(rasters["item"], value_set=names)
            rasters, at = rasters.filter(at.is_valid()), at.drop_null().to_numpy().astype(np.int64)
            sizes = pc.fill_null(pc.list_value_length(rasters["values"]), 0).to_numpy(zero_copy_only=False)
            # cuts where the values or the cells of the rasters so far fill a batch
            full = np.maximum(np.cumsum(count[at]) // BATCH_VALUES, np.cumsum(sizes.astype(np.int64)) // BATCH_CELLS)
            cuts = [0, *(np.flatnonzero(np.diff(full)) + 1).tolist(), len(at)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if a < z:
                    yield _sampled(rasters.slice(a, z - a), sizes[a:z], first[at[a:z]], count[at[a:z]], points, x, y, partition.tile)


def _sampled(rasters: pa.RecordBatch, sizes: np.ndarray, first: np.ndarray, count: np.ndarray, points: pa.Array, x: np.ndarray, y: np.ndarray, tile: str) -> pa.RecordBatch:
    """The value under each point (count of them from first) of each raster's item; null outside of it."""
    of = np.repeat(np.arange(len(count)), count)
    asked = np.arange(len(of)) + np.repeat(first - (np.cumsum(count) - count), count)
    west, north, step = (pc.fill_null(rasters[c].cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)[of] for c in ("west", "north", "step"))
    width = pc.fill_null(rasters["width"], 0).to_numpy(zero_copy_only=False).astype(np.int64)
    height, width = (sizes // np.maximum(width, 1))[of], width[of]
    starts = (np.cumsum(sizes, dtype=np.int64) - sizes)[of]
    with np.errstate(all="ignore"):
        column, row = np.floor((x[asked] - west) / step), np.floor((north - y[asked]) / step)
        inside = (step > 0) & (column >= 0) & (column < width) & (row >= 0) & (row < height)  # false for NaN
    at = np.zeros(len(of), np.int64)
    at[inside] = starts[inside] + row[inside].astype(np.int64) * width[inside] + column[inside].astype(np.int64)
    of, cells = pa.array(of), rasters["values"].flatten()
    return pa.RecordBatch.from_arrays(
        [pa.repeat(tile, len(of)), rasters["item"].take(of), rasters["asset"].cast(pa.string()).take(of), points.take(pa.array(asked)), cells.take(pa.array(at, mask=~inside)).cast(pa.float64())],
        names=["tile", "item", "asset", "point", "value"],
    )


def _whole(c: pa.ChunkedArray | pa.Array) -> pa.Array:
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """The values of all points that a store was asked for, by item and asset; filters on tile and asset reach the files.

    A task holds one file of points and row groups of rasters. Points outside of their raster, or without a place, have null; points whose
    item has no raster have no row, repeated points or rasters one each. Turns on Spark's filters for Python sources, which this source takes.
    Spark keeps one set of them a frame: read again where a plan needs two.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSamples)
    return spark.read.format("raster_samples").option("path", path).load()
