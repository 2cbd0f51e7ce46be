"""Repeated passages against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from fieldlight.llm import repeats, substring_dedup, suffix_dedup

DOCS = "doc_id long, text string, runs int"


def brute(rows, split, length):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        u = split(t)
        for p in range(len(u) - length + 1):
            first.setdefault(tuple(u[p : p + length]), i)
    out = []
    for i, t in rows:
        u = split(t)
        gone = set()
        for p in range(len(u) - length + 1):
            if i is not None and first[tuple(u[p : p + length])] < i:
                gone |= set(range(p, p + length))
        runs = sum(1 for g in gone if g - 1 not in gone)
        out.append((i is None, i or 0, len(u), len(gone), runs, [x for k, x in enumerate(u) if k not in gone]))
    return sorted(out, key=lambda r: (*r[:5], str(r[5])))


def rows(seed):
    r = random.Random(seed)
    words = [f"w{i}é" if i % 5 == 0 else f"w{i}" for i in range(300)]
    passage = [" ".join(r.choice(words) for _ in range(n)) for n in (12, 13, 14, 30, 60, 200)]
    texts = []
    for _ in range(90):
        parts = [" ".join(r.choice(words) for _ in range(r.randint(0, 40)))]
        for _ in range(r.randint(0, 2)):
            p = r.choice(passage).split(" ")
            a = r.randint(0, 5)
            parts += [" ".join(p[a : len(p) - r.randint(0, 5)]), " ".join(r.choice(words) for _ in range(r.randint(0, 20)))]
        texts.append(r.choice([" ", "\n", ""]).join(parts))
    texts += [texts[3], texts[3], texts[5] + "x", "x" + texts[5], None, "", " ", "a" * 300, "b" + "a" * 200, "ab" * 100, "a " * 60, "\0" * 70 + "z", "é" * 40, "é" * 30]
    out = [(i * 3 % 113, t) for i, t in enumerate(texts)]
    return [*out, (None, texts[3]), (7, texts[5]), (7, texts[5])]


@pytest.mark.parametrize(("seed", "hot"), [(1, 512), (2, 512), (1, 2), (2, 3)])
def test_suffix_dedup(spark, seed, hot, monkeypatch):
    own = rows(seed)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(repeats, "HOT_CHUNKS", hot)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 2000)
    df = spark.createDataFrame([(*x, 1) for x in own], DOCS).repartition(3)
    got = [(x.doc_id is None, x.doc_id or 0, x.n_units, x.n_removed, len(x.runs), list(bytes(x.kept))) for x in suffix_dedup.suffix_dedup(df).collect()]
    assert sorted(got, key=lambda r: (*r[:5], str(r[5]))) == brute(own, lambda t: list((t or "").encode()), 50)


@pytest.mark.parametrize(("seed", "hot"), [(1, 512), (2, 512), (1, 2), (2, 3)])
def test_substring_dedup(spark, seed, hot, monkeypatch):
    own = rows(seed)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(repeats, "HOT_CHUNKS", hot)
    monkeypatch.setattr(repeats, "CHUNK_ROWS", 7)
    df = spark.createDataFrame([(*x, 1) for x in own], DOCS).repartition(3)
    got = [(x.doc_id is None, x.doc_id or 0, x.n_units, x.n_removed, len(x.runs), bytes(x.kept).split()) for x in substring_dedup.substring_dedup(df).collect()]
    assert sorted(got, key=lambda r: (*r[:5], str(r[5]))) == brute(own, lambda t: (t or "").encode().split(), 13)


def test_no_rows(spark):
    df = spark.createDataFrame([], DOCS)
    assert suffix_dedup.suffix_dedup(df).count() == 0 == substring_dedup.substring_dedup(df).count()


def test_multikey_sort_orders_rows():
    keys = np.random.default_rng(1).integers(0, 3, (500, 6)).astype(np.uint64)
    order, differs = suffix_dedup.multikey_sort(keys)
    got = [tuple(x) for x in keys[order].tolist()]
    assert got == sorted(got)
    for i in range(1, len(got)):
        assert differs[i] == next((d for d in range(6) if got[i][d] != got[i - 1][d]), 6)


def test_very_long_texts_and_a_common_passage(spark):
    """Texts longer than a chunk, and a passage in very many documents, in the real sizes."""
    r = random.Random(6)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(400_000))
    passage = " ".join(f"p{i}" for i in range(40))
    own = [(1, long), (2, long[1000:] + " end"), *((10 + i, f"a{i} b{i} {passage} c{i}") for i in range(3000))]
    df = spark.createDataFrame([(*x, 1) for x in own], DOCS).repartition(4)
    words = {x.doc_id: (x.n_units, x.n_removed) for x in substring_dedup.substring_dedup(df).collect()}
    tail = len((long[1000:] + " end").split())
    assert words[1] == (400_000, 0) and words[2][0] == tail and tail - 2 <= words[2][1] <= tail - 1 and words[10] == (43, 0)
    assert all(words[10 + i] == (43, 40) for i in range(1, 3000))
    size = {x.doc_id: (x.n_units, x.n_removed, len(x.runs)) for x in suffix_dedup.suffix_dedup(df).collect()}
    assert size[1] == (len(long), 0, 0) and size[2] == (len(long) - 996, len(long) - 1000, 1)
    assert all(size[10 + i][1] >= len(passage) + 3 for i in range(1, 3000))


def test_answers_to_a_chunk_do_not_grow_with_its_documents():
    """A bucket gets a passage once from each chunk, however many of its documents have it."""
    windows, length = 35, 50
    text = bytes(range(windows + length - 1))
    data = [repeats.packed(np.array([len(text)], "<u4"), np.array([34], "<u2"), np.array([windows], "<u2"), np.array([least], "<i8"), text) for least in (40, 7, 90)]
    group = pa.table({"bucket": pa.array([5] * 3, pa.int32()), "chunk": pa.array([1, 2, 3], pa.int64()), "data": pa.array(data, pa.binary())})
    out = repeats._answers(lambda found: np.repeat(found.ids.min(), 3)[:, None].repeat(windows, axis=1))(group)
    assert out["chunk"].to_pylist() == [1, 3] and out["bucket"].to_pylist() == [5, 5]
    for told in out["data"]:
        which, first = repeats.unpacked(told.as_py(), "<u4", "<i8")
        assert which.tolist() == [0] and first.tolist() == [7] * windows


def survivors(chunks):
    """Whether chunks (lists of texts) have a hot anchor by the module's own bound; all hashes go to one bucket."""
    rows = [repeats.packed(np.array([len(t) for t in own], np.int64), b"".join(own)) for own in chunks]
    sent = repeats._send_hashes(50, 16, repeats.byte_units, 1)([pa.RecordBatch.from_pydict({"chunk": list(range(len(rows))), "data": pa.array(rows, pa.binary())})])
    return repeats._surviving(repeats.HOT_CHUNKS)(pa.Table.from_batches(list(sent)))


def test_hot_is_by_surroundings_not_by_chunks(monkeypatch):
    """Windows one by one are several times as much as surroundings, so an anchor in many chunks, with one surrounding in each, is not hot."""
    passage = b" ".join(b"p%d" % i for i in range(40))
    told = survivors([[b"%06d %s" % (i, passage)] for i in range(700)])
    assert told.num_rows == 700 and not any(told["hot"].to_pylist())
    r = random.Random(4)
    noise = lambda: bytes(r.randrange(97, 123) for _ in range(60))
    monkeypatch.setattr(repeats, "HOT_CHUNKS", 100)
    common = noise()[:16]
    while survivors([[b"x" * 40 + common + b"x" * 40], [b"y" * 40 + common + b"y" * 40]]).num_rows < 2:  # an anchor wherever it stands is likelier in runs of one letter
        common = noise()[:16]
    assert not any(survivors([[b"x" * 40 + common + b"x" * 40] * 300, [b"y" * 40 + common + b"y" * 40]])["hot"].to_pylist())
    apart = [b"x" * 40 + common + noise() for _ in range(200)]
    assert any(survivors([apart, [b"y" * 40 + common + b"y" * 40]])["hot"].to_pylist())


def test_result_keeps_no_shuffle_files_of_its_steps(spark, monkeypatch):
    """Answers and windows of hot anchors are tables when the result is asked for: its plan has neither their groups nor their digests."""
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(repeats, "HOT_CHUNKS", 2)
    df = spark.createDataFrame([(*x, 1) for x in rows(1)], DOCS).repartition(3)
    plan = suffix_dedup.suffix_dedup(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapGroupsInArrow" not in plan


def test_bad_lengths(spark):
    df = spark.createDataFrame([], DOCS)
    for length, k in ((0, 0), (10, 11), (1 << 15, 16)):
        with pytest.raises(ValueError, match="length"):
            suffix_dedup.suffix_dedup(df, length=length, k=k)
