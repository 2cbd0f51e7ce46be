"""Hard negatives against all pairs of an anchor and a row; the curve and the bounds by themselves."""

import math
import random

import numpy as np
import pytest

from fieldlight.llm import hard_negatives as h
from pyspark.sql import functions as F


def brute(rows, step, k, m, least, most):
    taken = [(i, l, [math.floor(256 * x) for x in v]) for i, v, l in rows if None not in (i, l, v) and all(x is not None and math.isfinite(x) for x in v)]
    dims = max((len(v) for _, _, v in taken), default=0)
    taken = [(i, l, v + [0] * (dims - len(v))) for i, l, v in taken]
    out = []
    for i, label, v in taken:
        if i % step:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in taken if j != i)
        for s, j in [(s, j) for s, j, other in scored if other == label][:k]:
            found = [(n, t) for n, t, other in scored if other != label and least * -s <= 100 * -n <= most * -s][:m]
            out += [(i, j, r, t, -s, -n) for r, (n, t) in enumerate(found, 1)]
    return sorted(out)


def table(n, dims, labels, scale=1.0):
    rng, rows = random.Random(n), []
    for i in range(n):
        v = [rng.gauss(0, scale) for _ in range(dims)] if i % 9 else [0.5] * dims  # one vector in nine
        if i % 37 == 0:
            v[0] = rng.choice([None, math.nan, math.inf])
        if i % 41 == 0:
            v = v[:-2]
        rows.append((i if i % 53 else None, v if i % 43 else None, rng.choice(labels) if i % 47 else None))
        if i % 50 == 0:
            rows.append(rows[-1])
    return rows


@pytest.mark.parametrize(("rows", "kind", "more"), [
    (table(600, 6, [0, 0, 0, 1, 2]), "int", {}),
    (table(300, 3, [0, 1], 8e4), "int", {}),  # scores beyond 2**53
    (table(400, 20, ["a", "b"]), "string", {"block_rows": 7, "group_rows": 3, "positives": 3, "negatives": 2, "least": 70, "most": 95}),
])
def test_equals_brute_force(spark, rows, kind, more):
    docs = spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}").selectExpr("*", "1 AS id", "2 AS slot", "3 AS block", "4 AS anchor")
    got = sorted(tuple(r) for r in h.hard_negatives(docs, F.col("vec_id") % 10 == 0, **more).collect())
    assert got == brute(rows, 10, *(more.get(k, d) for k, d in (("positives", 5), ("negatives", 5), ("least", 80), ("most", 100)))) and got


def test_nothing_is_broadcast(spark):
    """Stored tables are compressed, so those that look small are many times as large in the driver: vectors, groups and their windows."""
    told = spark._jsparkSession.sharedState().statusStore()
    before = told.executionsCount()
    docs = spark.createDataFrame(table(400, 4, [0, 1]), "vec_id long, embedding array<double>, label int")
    assert h.hard_negatives(docs, F.col("vec_id") % 10 == 0, block_rows=4).count()
    runs = told.executionsList()
    nodes = [told.planGraph(runs.apply(i).executionId()).allNodes() for i in range(int(before), runs.size())]
    names = [n.apply(j).name() for n in nodes for j in range(n.size())]
    assert "SortMergeJoin" in names and not [n for n in names if n.startswith("Broadcast")]


def test_tables_with_nothing_to_find(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(0, [], 1), (1, [], 2)], [(0, [1.0], 1)], [(None, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)]):
        assert h.hard_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") % 100 == 0).collect() == []


def test_curve_goes_through_neighbours():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        order = sorted(range(len(points)), key=lambda i: h.hilbert(points[i : i + 1], bits)[0].tobytes())
        walk = points[order]
        assert len({h.hilbert(p[None], bits)[0].tobytes() for p in points}) == len(points)
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_bounds_hold_and_leave_blocks_out():
    rng = np.random.default_rng(0)
    anchors, block = rng.integers(-300, 300, (20, 5)), rng.integers(100, 200, (50, 5))
    least, most = h.bounds(anchors, block.min(0)[None], block.max(0)[None])
    scores = h.inner(anchors, block)
    assert (least[:, 0] <= scores.min(1)).all() and (most[:, 0] >= scores.max(1)).all() and (least[:, 0] > -(10**6)).all()


def test_blocks_out_of_reach_are_not_chosen(spark):
    """Two far clusters: the zone maps leave most blocks out."""
    rng = np.random.default_rng(2)
    rows = [(i, (np.array([100.0 if i % 2 else -100.0, 1.0]) + rng.random(2)).tolist(), i % 4) for i in range(2000)]
    import pyarrow as pa

    v = np.array([[math.floor(256 * x) for x in r[1]] for r in rows], np.int32)
    order = np.argsort(v[:, 0])
    parts = np.array_split(v[order], 20)
    page = {"group": 1, "label": "0", "vecs": v[1:2].tobytes(), "slots": [{"slot": 0, "at": 0, "low": 10**8, "high": 10**9}], "blocks": np.arange(20).tobytes(), "labels": ["1"] * 20,
            "lows": b"".join(p.min(0).tobytes() for p in parts), "highs": b"".join(p.max(0).tobytes() for p in parts)}
    chosen = pa.Table.from_batches(h._choose(2, False)(iter([pa.RecordBatch.from_pylist([page])])))
    assert sorted(chosen["block"].to_pylist()) == list(range(10, 20))
