"""Grouped Newton fits and the nested evaluations over them, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlight.operators import logistic, nested
from fieldlight.plans import registry

SF = "/root/testdata/sf0.001"


def numpy_fit(x, y, w, strength, classes=2, balanced=False):
    """Filled, flagged, scaled and fitted by plain gradient steps of Newton's method with numerical care; returns a scorer."""
    gone = np.isnan(x)
    fill = np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0.0 for c in x.T])
    flags = np.flatnonzero(gone.any(0))
    full = lambda a: np.concatenate([np.where(np.isnan(a), fill, a), np.isnan(a)[:, flags].astype(float)], 1)
    d = full(x)
    mean = np.average(d, axis=0, weights=w)
    dev = np.sqrt(np.average((d - mean) ** 2, axis=0, weights=w))
    dev[dev < 1e-6] = 1.0
    ready = lambda a: np.column_stack([(full(a) - mean) / dev, np.ones(len(a))])
    d, k = ready(x), classes
    if balanced:
        mass = np.bincount(y, w, classes)
        w = w * (w.sum() / (classes * mass))[y]
    b, one = np.zeros((k, d.shape[1])), np.eye(k)[y]
    if k == 2:  # held on one row of coefficients
        beta = np.zeros(d.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-d @ beta))
            free = np.r_[np.ones(d.shape[1] - 1), 0]
            g = strength * d.T @ (w * (p - y)) + free * beta
            h = strength * (d.T * (w * p * (1 - p))) @ d + np.diag(free)
            beta = beta - np.linalg.solve(h + 1e-12 * np.eye(len(h)), g)
        return beta, lambda a: np.column_stack([1 - (q := 1 / (1 + np.exp(-ready(a) @ beta))), q])
    for _ in range(4000):  # many classes: accelerated by a fixed bound on the curvature
        z = d @ b.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = strength * ((p - one) * w[:, None]).T @ d
        g[:, :-1] += b[:, :-1]
        bound = strength * 0.5 * (d.T * w) @ d + np.diag(np.r_[np.ones(d.shape[1] - 1), 0])
        b -= np.linalg.lstsq(bound, g.T, rcond=None)[0].T

    def scorer(a):
        e = np.exp(ready(a) @ b.T)
        return e / e.sum(1, keepdims=True)

    return b, scorer


def made(n, d, classes, seed, holes=0.05):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * rng.uniform(0.5, 3, d) + rng.normal(size=d)
    y = (x @ rng.normal(size=(d, classes)) * 0.4 + rng.gumbel(size=(n, classes))).argmax(1)
    x[:, 0] = np.where(rng.random(n) < holes, np.nan, x[:, 0])
    return x, y, rng.uniform(0.2, 2, n)


@pytest.mark.parametrize(("classes", "balanced"), [(2, False), (2, True), (3, True)])
def test_fits_equal_numpy(spark, classes, balanced):
    """Three overlapping fits with weights and missing values in one call; one without all classes has no model."""
    x, y, w = made(240, 5, classes, 3)
    where = {"a": np.arange(240) % 3 != 0, "b": np.arange(240) % 3 != 1, "c": np.arange(240) >= 0, "d": y == 0}
    rows = [([None if np.isnan(e) else float(e) for e in x[i]], int(y[i]), [(k, float(w[i])) for k in where if where[k][i]]) for i in range(240)]
    df = spark.createDataFrame(rows, "x array<double>, y int, fits array<struct<fit:string,weight:double>>").repartition(3)
    models = logistic.fitted(df, "x", "y", strength=lambda f: {"a": 0.1, "b": 1.0, "c": 10.0, "d": 1.0}[f], classes=classes, balanced=balanced)
    assert set(models) == {"a", "b", "c"}
    for k, c in (("a", 0.1), ("b", 1.0), ("c", 10.0)):
        beta, score = numpy_fit(x[where[k]], y[where[k]], w[where[k]], c, classes, balanced)
        if classes == 2:
            assert np.allclose(models[k].beta[0], beta, atol=1e-6)
        assert np.allclose(models[k].probabilities(x), score(x), atol=1e-6)


def test_groups_of_fits_and_no_rows(spark, monkeypatch):
    x, y, w = made(60, 3, 2, 4, 0)
    rows = [(x[i].tolist(), int(y[i]), [(f"f{i % 5}", 1.0), ("all", 1.0)]) for i in range(60)]
    df = spark.createDataFrame(rows, "x array<double>, y int, fits array<struct<fit:string,weight:double>>")
    together = logistic.fitted(df, "x", "y")
    monkeypatch.setattr(logistic, "MODEL_BYTES", 1)
    alone = logistic.fitted(df, "x", "y")
    assert set(alone) == set(together) and all(np.allclose(alone[k].beta, together[k].beta, atol=1e-9) for k in alone)
    assert logistic.fitted(df.limit(0), "x", "y") == {}


def test_separable_classes_converge(spark):
    rows = [([float(i)], int(i >= 10), [("f", 1.0)]) for i in range(20)]
    df = spark.createDataFrame(rows, "x array<double>, y int, fits array<struct<fit:string,weight:double>>")
    m = logistic.fitted(df, "x", "y", strength=1e4)["f"]
    assert m.steps < 40 and ((m.probabilities(np.arange(20.0)[:, None])[:, 1] > 0.5) == (np.arange(20) >= 10)).all()


def vectors(spark):
    from fieldlight.plans import inputs

    return inputs.windowed_vectors(spark, SF).toPandas()


def test_axes_equal_numpy(spark):
    """J34: every pair, window, outer and base fold refitted row by row."""
    got = {(r.pair, r.w, r.row_id, r.outer_fold, r.role): r.score for r in registry.queries()["j34_pair_axis_classifier"](spark, SF).collect()}
    v, want = vectors(spark), {}
    v["outer"], v["base"], v["truth"], v["pair"] = v.field % 5 % 2, v.field % 5 // 2 % 2, v.crop % 2, v.crop // 2
    for (pair, w), own in v.groupby(["pair", "w"]):
        x = np.stack(own.v.to_numpy())
        for o in (0, 1):
            tests = []
            for b in (0, 1):
                fit = ((own.outer != o) & (own.base != b)).to_numpy()
                if own.truth[fit].nunique() < 2:
                    continue
                f = own[fit]
                weight = (1 / (f.groupby("truth").field.transform("nunique") * f.groupby("field").field.transform("size"))).to_numpy()
                _, score = numpy_fit(x[fit], f.truth.to_numpy(), weight * len(f) / weight.sum(), 1.0)
                p = score(x)[:, 1]
                held = ((own.outer != o) & (own.base == b)).to_numpy()
                want |= {(pair, w, i, o, "train"): s for i, s in zip(own.row_id[held], p[held], strict=True)}
                tests.append(p)
            mine = (own.outer == o).to_numpy()
            if tests:
                want |= {(pair, w, i, o, "test"): s for i, s in zip(own.row_id[mine], np.mean(tests, axis=0)[mine], strict=True)}
    assert set(got) == set(want) and got and max(abs(got[k] - want[k]) for k in got) < 2e-6


def precision(y, s):
    out = 0.0
    for t in np.unique(s)[::-1]:
        out += y[s == t].sum() * y[s >= t].sum() / (s >= t).sum()
    return out / y.sum()


def test_detector_choice_equals_numpy(spark):
    """J35's choice of strength, scores and calls on a table with clear classes."""
    x, y, _ = made(180, 4, 2, 9)
    rows = [(i, [None if np.isnan(e) else float(e) for e in x[i]], int(y[i]), o, int(i % 3 == o), i // 3 % 3) for i in range(180) for o in range(3)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y int, outer_fold int, test int, inner int")
    found = {(r.outer_fold, r.id): r for r in nested.detected(df, [], "id", "x", "y", 3, (0.01, 0.3, 10.0)).collect()}
    at = np.arange(180)
    for o in range(3):
        train, tried = at % 3 != o, []
        for c in (0.01, 0.3, 10.0):
            s = np.full(180, np.nan)
            for i in range(3):
                fit, held = train & (at // 3 % 3 != i), train & (at // 3 % 3 == i)
                s[held] = numpy_fit(x[fit], y[fit], np.ones(fit.sum()), c, balanced=True)[1](x[held])[:, 1]
            s = np.round(s, 9)
            tried.append((-round(precision(y[train], s[train]), 9), c, s[train]))
        _, c, s = min(tried, key=lambda t: t[:2])
        points = [(t, (s >= t)[y[train] == 1].mean(), y[train][s >= t].mean(), (s >= t)[y[train] == 0].mean()) for t in np.unique(s)]
        limit = max((r, p, -f, t) for t, r, p, f in points if f <= 0.1)[3]
        want = numpy_fit(x[train], y[train], np.ones(train.sum()), c, balanced=True)[1](x)[:, 1]
        for i in at[at % 3 == o]:
            r = found[o, i]
            assert r.strength == c and abs(r.score - want[i]) < 1e-6 and abs(r.threshold - limit) < 1e-6 and r.call == (r.score >= r.threshold)


def test_lens_decisions_equal_numpy(spark):
    x, y, _ = made(160, 4, 2, 12)
    lenses = {"all": x, "one": x[:, :1]}
    rows = [(name, i, [None if np.isnan(e) else float(e) for e in v[i]], int(y[i]), i % 2, i // 2 % 3) for name, v in lenses.items() for i in range(160)]
    df = spark.createDataFrame(rows, "lens string, id long, x array<double>, y int, outer int, base int")
    found = {(r.lens, r.id): r for r in nested.lens_decisions(df, "lens", "id", "x", "y", "outer", "base", 2).collect()}
    at = np.arange(160)
    for name, v in lenses.items():
        for o in (0, 1):
            train, fit, own = at % 2 != o, (at % 2 != o) & (at // 2 % 3 != 0), at % 2 == o
            score = numpy_fit(v[train], y[train], np.ones(train.sum()), 1.0, balanced=True)[1](v)[:, 1]
            operating = np.round(numpy_fit(v[fit], y[fit], np.ones(fit.sum()), 1.0, balanced=True)[1](v)[:, 1], 9)
            calm = operating[train & ~fit & (y == 0)]
            limit = np.quantile(calm, 0.9, method="higher")
            strict = np.mean(calm >= limit) > 0.1
            for i in at[own]:
                r = found[name, i]
                assert abs(r.score - score[i]) < 1e-6 and abs(r.threshold - limit) < 1e-6
                if abs(operating[i] - limit) > 1e-6:
                    assert r.decision == (operating[i] > limit if strict else operating[i] >= limit)


@pytest.mark.parametrize(("name", "rows"), [("j36_nested_feature_sets", 12), ("j38_lens_evaluation", 7), ("j40_multinomial_models", 6)])
def test_whole_evaluations(spark, name, rows):
    found = registry.queries()[name](spark, SF).collect()
    assert len(found) == rows and all(0 <= (r.macro_f1 if "j40" in name else r.average_precision) <= 1 for r in found)


def test_stages_equal_numpy(spark):
    """J40: three classes, the model of the other folds for every row."""
    x, y, _ = made(150, 3, 3, 21, 0)
    df = spark.createDataFrame([("u", i, x[i].tolist(), int(y[i]), i % 3) for i in range(150)], "unit string, id long, x array<double>, y int, fold int")
    got = {r.id: r.predicted for r in nested.staged_classes(df, ["unit"], "id", "x", "y", "fold", 3, 3).collect()}
    for f in range(3):
        train = np.arange(150) % 3 != f
        p = numpy_fit(x[train], y[train], np.ones(train.sum()), 1.0, 3, True)[1](x)
        assert all(got[i] == p[i].argmax() for i in np.flatnonzero(~train) if np.sort(p[i])[-1] - np.sort(p[i])[-2] > 1e-6)
