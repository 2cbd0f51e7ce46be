"""The sampler's data source: values as by hand, other tiles unread, points outside, nothing at all."""

import random
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fieldlight.sources import samples

RASTERS = "tile int, item string, asset string, west double, north double, step double, width int, values array<double>"
REQUESTS = "tile int, item string, point string, x double, y double"


def laid(spark, tmp_path, rasters, requests, **how):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    samples.land(spark.createDataFrame(rasters, RASTERS), spark.createDataFrame(requests, REQUESTS), path, **how)
    return path


def made():
    dice = random.Random(5)
    rasters, requests = [], []
    for n in range(40):
        tile, item, width = n % 3, f"i{n}", dice.randint(1, 5)
        west, north, step, height = dice.uniform(-9, 9), dice.uniform(-9, 9), dice.choice([0.5, 1.0, 2.0]), dice.randint(1, 4)
        for asset in ("a", "b"):
            rasters.append((tile, item, asset, west, north, step, width, [None if dice.random() < 0.1 else dice.uniform(0, 9) for _ in range(width * height)]))
        for k in range(dice.randint(0, 9)):
            requests.append((tile, item, f"p{k}", west + dice.uniform(-1, width * step + 1), north - dice.uniform(-1, height * step + 1)))
    return rasters, requests


def by_hand(rasters, requests):
    for tile, item, asset, west, north, step, width, values in rasters:
        for t, i, point, x, y in requests:
            if (t, i) == (tile, item):
                c, r = (x - west) // step, (north - y) // step
                inside = 0 <= c < width and 0 <= r < len(values) // width
                yield str(tile), item, asset, point, values[int(r) * width + int(c)] if inside else None


def test_equals_values_by_hand_with_points_in_one_file_or_many(spark, tmp_path):
    rasters, requests = made()
    want = sorted(by_hand(rasters, requests), key=str)
    assert any(v[-1] is None for v in want)
    for n in (7, 1000):
        got = samples.read_samples(spark, laid(spark, tmp_path, rasters, requests, file_points=n))
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_filters_on_tiles_leave_other_files_unread(spark, tmp_path):
    rasters, requests = made()
    path = laid(spark, tmp_path, rasters, requests)
    whole = samples.read_samples(spark, path)
    want = sorted(map(tuple, whole.where("tile = '1' AND asset = 'b'").collect()), key=str)
    for file in (f for t in "02" for f in Path(path).glob(f"*/tile={t}/*.parquet")):
        file.with_name("." + file.name + ".crc").unlink(missing_ok=True)
        file.write_bytes(b"broken")
    one = samples.read_samples(spark, path).where("tile = '1'").where("asset = 'b'")
    assert sorted(map(tuple, one.collect()), key=str) == want == sorted((v for v in by_hand(rasters, requests) if v[0] == "1" and v[2] == "b"), key=str)
    assert one.rdd.getNumPartitions() == 1
    assert samples.read_samples(spark, path).where("tile = 'x'").count() == 0
    with pytest.raises(Exception, match="(?i)parquet|magic"):
        samples.read_samples(spark, path).where("tile = '1' OR value < 0").collect()  # not pushed, so the broken files are read


def test_nulls_repeated_rows_and_nothing(spark, tmp_path):
    rasters = [(1, "i", "a", 0.0, 2.0, 1.0, 2, [1.0, 2.0, 3.0, 4.0])] * 2 + [(1, "j", "a", None, 2.0, 1.0, 2, [1.0]), (1, "k", None, 0.0, 2.0, 1.0, 1, None), (None, "i", "a", 0.0, 2.0, 1.0, 2, [1.0])]
    requests = [(1, "i", "p", 1.5, 0.5)] * 2 + [(1, "i", "q", None, 0.5), (1, "j", "p", 0.5, 1.5), (1, "k", None, 0.5, 1.5), (1, None, "p", 0.5, 1.5), (1, "no raster", "p", 0.5, 1.5), (2, "i", "p", 0.5, 1.5)]
    got = samples.read_samples(spark, laid(spark, tmp_path, rasters, requests)).groupBy("item", "asset", "point", "value").agg(F.count("*").alias("n")).collect()
    assert {tuple(r) for r in got} == {("i", "a", "p", 4.0, 4), ("i", "a", "q", None, 2), ("j", "a", "p", None, 1), ("k", None, None, None, 1)}
    assert samples.read_samples(spark, laid(spark, tmp_path, [], [])).count() == 0
    assert samples.read_samples(spark, laid(spark, tmp_path, rasters, [])).count() == 0


def test_a_file_of_points_holds_a_range_of_items(spark, tmp_path):
    """Files of one tile meet at one item at most, so that points in many files do not each pass over all rasters."""
    rasters, requests = made()
    rasters, requests = [(1, *r[1:]) for r in rasters], [(1, *r[1:]) for r in requests]
    few = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "300b", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in few.items():
        spark.conf.set(name, value)
    try:
        path = laid(spark, tmp_path, rasters, requests)
    finally:
        for name in few:
            spark.conf.unset(name)
    assert sorted(map(tuple, samples.read_samples(spark, path).collect()), key=str) == sorted(by_hand(rasters, requests), key=str)
    spans = sorted((min(i), max(i)) for i in ([r.item for r in spark.read.parquet(str(f)).collect()] for f in Path(path).glob("requests/tile=1/*.parquet")))
    assert len(spans) > 2 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_values_made_where_rasters_are_written(spark, tmp_path):
    """Cells come after the shuffle: it has the columns that they are made of, not the cells."""
    rasters = spark.createDataFrame([("1", f"i{k}", "a", 0.0, 2.0, 1.0, 2, k) for k in range(40)], "tile string, item string, asset string, west double, north double, step double, width int, seed int")
    requests = spark.createDataFrame([(1, f"i{k}", "p", 1.5, 0.5) for k in range(40)], REQUESTS)
    samples.land(rasters, requests, f"{tmp_path}/s", values=F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: (F.col("seed") * 10 + j).cast("double")))
    got = {r.item: r.value for r in samples.read_samples(spark, f"{tmp_path}/s").collect()}
    assert got == {f"i{k}": 10.0 * k + 3 for k in range(40)}


def test_a_place_is_asked_once(spark, tmp_path):
    """Points of one place share its samples: pairs of places and items do not grow with the points of a place."""
    import shutil

    from fieldlight.plans import q_vectors

    base = Path("/root/testdata/sf0.001")
    for t in ("nation", "region", "lineitem"):
        shutil.copyfile(base / f"{t}.parquet", tmp_path / f"{t}.parquet")
    c, step = spark.read.parquet(f"{base}/customer.parquet"), 30_600  # the same place and tile again
    shifted = c.withColumn("_r", F.explode(F.array(*map(F.lit, range(5))))).withColumn("c_custkey", F.col("c_custkey") + F.col("_r") * step).drop("_r")
    shifted.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert q_vectors._asked(spark, str(tmp_path)).count() == q_vectors._asked(spark, str(base)).count()
    one, five = (q_vectors.l3_source(spark, str(p)).where("point IS NOT NULL") for p in (base, tmp_path))
    assert five.count() == 5 * one.count() > 0
    histories = q_vectors.j45_sampled(spark, str(tmp_path))
    k = F.col("candidate_id").cast("long") % step
    assert histories.count() == 10 * c.count() and histories.groupBy(k, "modality", "rows", "valid_rows", "band_sum", "outcome").count().where("count <> 5").isEmpty()
