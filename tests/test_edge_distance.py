"""Nearest edges of large geometries against all pairs."""

import numpy as np

from fieldlight.operators import geometry as g


def brute(px, py, x1, y1, x2, y2):
    dx, dy = x2 - x1, y2 - y1
    t = np.clip(((px[:, None] - x1) * dx + (py[:, None] - y1) * dy) / np.maximum(dx * dx + dy * dy, 1e-300), 0, 1)
    return np.hypot(px[:, None] - (x1 + t * dx), py[:, None] - (y1 + t * dy)).min(1)


def rows_made(df, node):
    """Output rows of the plan's nodes of a kind, after the action."""
    plan, out = [df._jdf.queryExecution().executedPlan()], []
    while plan:
        p = plan.pop()
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            plan.append(p.executedPlan())
            continue
        if p.nodeName().endswith("QueryStage"):
            plan.append(p.plan())
            continue
        if node in p.nodeName():
            out.append(p.metrics().get("numOutputRows").get().value())
        plan += [p.children().apply(i) for i in range(p.children().size())]
    return out


def test_ten_thousand_edges(spark):
    """A ragged ring, short and very long edges, points inside, outside and far away; no join makes points times edges."""
    rng = np.random.default_rng(7)
    n = 10_000
    a = np.linspace(0, 2 * np.pi, n, endpoint=False)
    r = 100 + 10 * np.sin(40 * a) + rng.random(n)
    x, y = 500 + r * np.cos(a), -200 + r * np.sin(a)
    ring = [(1, 0, i, *map(float, (x[i], y[i], x[(i + 1) % n], y[(i + 1) % n]))) for i in range(n)]
    odd = [(2, 0, 0, 0.0, 0.0, 1000.0, 1.0), (2, 0, 1, 0.0, 0.0, 0.0, 5.0), (2, 0, 2, 3.0, 3.0, 3.0, 3.0), (3, 0, 0, 7.0, 7.0, 7.0, 7.0)]
    e = spark.createDataFrame([*ring, *odd], "k int, ring int, seq int, x1 double, y1 double, x2 double, y2 double").persist()
    places = [(i, int(k), *map(float, p)) for i, (k, p) in enumerate(zip(rng.choice([1, 1, 1, 2, 3], 300), np.array([500, -200]) + rng.normal(size=(300, 2)) * rng.choice([30, 100, 5000], 300)[:, None], strict=True))]
    found = g.edge_distance(spark.createDataFrame(places, "p int, k int, px double, py double"), e, "p", "k")
    got = {r.p: r.distance for r in found.collect()}
    ends = {k: np.array([q[3:] for q in [*ring, *odd] if q[0] == k]).T for k in (1, 2, 3)}
    for i, k, px, py in places:
        assert abs(got[i] - brute(np.array([px]), np.array([py]), *ends[k])[0]) < 1e-9 * max(1, got[i])
    assert len(got) == 300 and 300 < sum(rows_made(found, "Join")) < 300 * n / 3
