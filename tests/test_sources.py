"""Late stores, file inventories and bundles: what is read, what is refused."""

import hashlib
import json
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fieldlight.operators import mixture
from fieldlight.sources import bundles, inventory, late


def _store(spark, tmp_path, n=2000, buckets=16):
    store = late.BucketStore(str(tmp_path / "s"), "id", ("tile",), buckets)
    store.write(spark.range(n).select("id", F.when(F.col("id") % 50 != 7, F.col("id") % 50).alias("tile"), F.array(F.col("id") * 0.5).alias("v")))
    return store


def test_late_store_gives_selected_rows(spark, tmp_path):
    store = _store(spark, tmp_path)
    picked = [(i, None if i % 50 == 7 else i % 50) for i in (3, 53, 57, 57, 1999)] + [(5, 6), (99_999, 1), (None, 1)]
    for kind in ("long", "int"):  # an id may be of another integer type than the store's
        got = store.fetch(spark.createDataFrame(picked, f"id {kind}, tile {kind}"), ["v"])
        assert sorted((r.id, r.v[0]) for r in got.collect()) == [(3, 1.5), (53, 26.5), (57, 28.5), (57, 28.5), (1999, 999.5)]
        assert got.columns == ["id", "tile", "v"]
    assert store.fetch(spark.createDataFrame([], "id long, tile long"), ["v"]).count() == 0
    with pytest.raises(Exception, match="(?i)path"):
        late.BucketStore(store.path, "id", ("tile",), 8).fetch(spark.range(1).withColumn("tile", F.lit(1)), ["v"])
    with pytest.raises(ValueError, match="bucket"):
        store.write(spark.range(1).select("id", F.lit(1).alias("tile"), F.lit(1).alias("bucket")))


def test_late_store_opens_only_folders_of_the_selection(spark, tmp_path):
    store = _store(spark, tmp_path)
    schema = store.read(spark).schema
    selected = spark.range(2000).select("id", (F.col("id") % 50).alias("tile")).where("tile = 3")
    mine = selected.select(store.bucket()).head()[0]
    for f in Path(store.data).glob("bucket=*/*.parquet"):
        if f.parent.name != f"bucket={mine}":
            f.write_bytes(b"broken")
            f.with_name(f".{f.name}.crc").unlink()
    got = store.fetch(selected, ["v"], schema)
    assert "dynamicpruning" in got._jdf.queryExecution().toString()
    assert got.count() == 40
    with pytest.raises(Exception):  # noqa: B017  other folders are broken
        store.fetch(selected.unionByName(spark.range(50).select("id", F.col("id").alias("tile"))), ["v"], schema).collect()


def test_inventory_reads_files_whole_or_in_blocks(spark, tmp_path):
    files = {"a.bin": b"", "b c.bin": b"x" * 10, "k=1/c.bin": random.Random(1).randbytes(20_000_000), "k=1/d.txt": b"no", "_hidden.bin": b"no"}
    for name, data in files.items():
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_bytes(data)
    want = sorted((n, len(files[n]), hashlib.sha256(files[n]).hexdigest()) for n in ("a.bin", "b c.bin", "k=1/c.bin"))
    for whole in (-1, 5, 1 << 26):  # all in blocks, some, none
        assert sorted(map(tuple, inventory.file_inventory(spark, str(tmp_path / "r"), "*.bin", whole).collect())) == want


def test_inventory_of_a_file_beyond_two_gigabytes(spark, tmp_path):
    (tmp_path / "r").mkdir()
    with (tmp_path / "r" / "large").open("wb") as f:
        f.truncate((2 << 30) + 12345)  # a hole: no disk is used
    want, left = hashlib.sha256(), (2 << 30) + 12345
    while left:
        want.update(bytes(min(left, 1 << 24)))
        left -= min(left, 1 << 24)
    row = inventory.file_inventory(spark, str(tmp_path / "r")).head()
    assert tuple(row) == ("large", (2 << 30) + 12345, want.hexdigest())


def test_receipt_rules(spark):
    inv = spark.createDataFrame([("same", 1, "a"), ("new", 1, "a"), ("long", 2, "a"), ("other", 1, "b"), ("null", 1, "a")], "path string, n_bytes long, sha256 string")
    rec = spark.createDataFrame([("same", 1, "a"), ("gone", 1, "a"), ("long", 1, "a"), ("other", 1, "a"), ("null", 1, None)], "path string, n_bytes long, sha256 string")
    got = {(r.rule, r.key) for r in inventory.against_receipt(inv, rec).collect()}
    assert got == {("extra", "new"), ("missing", "gone"), ("n_bytes", "long"), ("sha256", "other"), ("sha256", "null")}


def _catalog(spark, changes=(None,)):
    """Sound snapshots of two items, one a query, each changed by its function before the receipt is taken."""
    raws = [{"id": f"i{k}", "collection": "c", "bbox": [0.0, 1.0, 2.0, 3.0], "assets": {"B1": {"href": f"h{k}"}}, "properties": {"datetime": f"2024-05-0{k}T00:00:00Z", "cloud": 4}} for k in (1, 2)]
    texts = [json.dumps(r) for r in raws]
    snapshots = []
    for n, change in enumerate(changes):
        items = [{**r, "assets": {k: a["href"] for k, a in r["assets"].items()}, "datetime": r["properties"]["datetime"], "properties": {"cloud": 4}, "raw_item_sha256": hashlib.sha256(t.encode()).hexdigest()} for r, t in zip(raws, texts, strict=True)]
        s = {"schema_version": 1, "modality": "s2", "tile": "t", "year": 2024, "collection": "c", "band_order": ["B1"], "items": items}
        if change:
            change(s)
        doc = json.dumps(s)
        snapshots.append((f"q{n}", doc, hashlib.sha256(doc.encode()).hexdigest()))
    expected = spark.createDataFrame([(q, 1, "s2", "t", 2024, "c", ["B1"]) for q, *_ in snapshots], "query string, schema_version int, modality string, tile string, year int, collection string, band_order array<string>")
    raw = spark.createDataFrame([(hashlib.sha256(t.encode()).hexdigest(), t) for t in texts], "digest string, doc string")
    return spark.createDataFrame(snapshots, "query string, doc string, receipt string"), expected, raw


RULES = [
    (None, None), ("identity", lambda s: s.update(year=2023, items=s["items"][:0])), ("items", lambda s: s.update(items=[])), ("href", lambda s: s["items"][0]["assets"].update(B1="")), ("assets", lambda s: s["items"][0]["assets"].update(B9="h")),
    ("bbox", lambda s: s["items"][0].update(bbox=[0.0])), ("bbox", lambda s: s["items"][0].update(bbox=None)), ("datetime", lambda s: s["items"][0].update(datetime="2024-05-01")), ("datetime", lambda s: s["items"][0].update(datetime=None)),
    ("year", lambda s: s["items"][0].update(datetime="2023-12-31T23:59:59Z")), (None, lambda s: s["items"][0].update(datetime="2024-05-01T02:00:00+02:00")), ("properties", lambda s: s["items"][0]["properties"].update(cloud=5)),
    ("properties", lambda s: s["items"][0].update(properties=None)), ("raw_identity", lambda s: s["items"][0].update(collection="d")), ("digest", lambda s: s["items"][0].update(raw_item_sha256=None)), ("raw_missing", lambda s: s["items"][0].update(raw_item_sha256="0" * 64)),
]


def test_snapshot_rules(spark):
    items, told = bundles.catalog_snapshot(*_catalog(spark, [change for _, change in RULES]))
    told = [(r.rule, r.key.split("|")[0]) for r in told.collect()]
    for n, (rule, _) in enumerate(RULES):
        rules = {r for r, q in told if q == f"q{n}"}
        assert (rule in rules) if rule else rules == set(), (n, rules)
    sound = [f"q{n}" for n, (rule, _) in enumerate(RULES) if rule is None]
    got = items.where(F.col("query").isin(sound)).select("query", "id", F.col("acquired").cast("string"))
    assert sorted(map(tuple, got.collect())) == [(q, f"i{k}", f"2024-05-0{k} 00:00:00") for q in sound for k in (1, 2)]


def test_snapshots_that_are_absent_unasked_or_no_json(spark):
    s, e, raw = _catalog(spark)
    rules = lambda *x: sorted((r.rule, r.key) for r in bundles.catalog_snapshot(*x)[1].collect())
    assert rules(s.limit(0), e, raw) == [("absent", "q0")]
    assert rules(s, e.limit(0), raw) == [("expected", "q0")]
    broken = s.withColumn("doc", F.lit("{")).withColumn("receipt", F.sha2("doc", 256))
    assert rules(broken, e, raw) == [("json", "q0")]
    assert ("receipt", "q0") in rules(s.withColumn("receipt", F.lit(None).cast("string")), e, raw)


def test_pack_of_another_run_and_without_windows(spark):
    one = lambda **x: spark.createDataFrame([tuple(x.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in x.items()))
    scores = one(field_uid="f", window_id="w")
    check = lambda c, m: {(r.rule, r.detail) for r in bundles.pack_violations(c, m, scores.select("field_uid"), {"s": scores}, {"s": ["field_uid"]}, "s").collect()}
    assert check(one(analysis_id="a", ok=True), one(analysis_id="a", windows=["w"])) == set()
    assert check(one(analysis_id="b", ok=True), one(analysis_id="a", windows=["w"])) == {("analysis_id", None)}
    assert check(one(analysis_id="a", ok=False), one(analysis_id="a", windows=[])) == {("complete", None), ("windows", None), ("windows", "missing")}


def test_draws_of_a_large_group(spark):
    g = spark.range(50_000).select(F.lit("k").alias("k"), F.col("id").alias("unit"))
    got = mixture.draws(g, ["k"], "unit", 3).groupBy("replicate").agg(F.sum("weight").alias("s"), F.count("*").alias("n")).collect()
    assert [r.s for r in got] == [50_000.0] * 3 and all(0.62 < r.n / 50_000 < 0.645 for r in got)  # 1 - 1/e


def test_queries_are_listed_without_a_session():
    root = Path(__file__).resolve().parents[1]
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], cwd=root, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr


def test_digests_travel_as_bytes(spark):
    """Bytes are half as long as hex; equal keys are equal texts, whatever the texts; raw documents by bytes break the same rules as by text."""
    hexed = "0f" * 32
    texts = [hexed, hexed.upper(), "0f" * 31, "x" * 32, "x" * 65, "", "xyz", None, hexed[:-1] + "0", bytes.fromhex("61" * 32).decode(), "61" * 32]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", bundles.digest_key(F.col("t")).alias("k")).collect()
    assert [len(r.k) for r in got if r.t in (hexed, "61" * 32)] == [32, 32] and all((r.k is None) == (r.t is None) for r in got)
    assert len({bytes(r.k) for r in got if r.k is not None}) == len({r.t for r in got if r.t is not None})
    snapshots, expected, raw = _catalog(spark, [change for _, change in RULES])
    rules = lambda raw: sorted((r.rule, r.key) for r in bundles.catalog_snapshot(snapshots, expected, raw)[1].collect())
    plain = raw.where(F.col("digest").rlike("^[0-9a-f]{64}$"))
    assert rules(plain.withColumn("digest", F.unhex("digest"))) == rules(plain) != []
