"""Many logistic regressions in one job: Newton steps whose gradients and Hessians are sums over rows.

A row names the fits in which it trains, with its weight in each, so that folds, stages, settings and feature sets
need no copies of vectors. Each Newton step is one job for all fits: tasks add up gradients and Hessians of
their rows, the sums meet by fit, and a small system per fit is solved where they meet. Only coefficients
(fits times features) reach the driver and go to tasks; beyond MODEL_BYTES fits advance in several groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import added

#: Bytes of coefficients that the driver and every task hold at once.
MODEL_BYTES = 64 << 20


@dataclass
class Model:
    """x -> filled, with flags of missing features, scaled, times coefficients (one row, or one for each of several classes)."""

    fill: np.ndarray
    flags: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    factors: np.ndarray  # weights of classes
    steps: int = 0

    def design(self, x: np.ndarray) -> np.ndarray:
        """Scaled features with a constant last."""
        gone = np.isnan(x)
        full = np.concatenate([np.where(gone, self.fill, x), gone[:, self.flags].astype(float)], 1)
        return np.column_stack([(full - self.mean) / self.scale, np.ones(len(x))])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(self.design(x) @ self.beta.T)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.column_stack([np.zeros(len(z)), z]) if z.shape[1] == 1 else z
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _by_fit(frame: pd.DataFrame, x: str, fits: str) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(fit, places of its rows, their weights, their features) for every fit that a batch has."""
    pairs = [(f["fit"], i, f["weight"]) for i, many in enumerate(frame[fits]) if many is not None for f in many]
    if not pairs:
        return
    names, at, weights = zip(*pairs, strict=True)
    names, at, weights = np.array(names, object), np.array(at), np.array(weights, float)
    vectors = frame[x].to_numpy()
    for name in dict.fromkeys(names.tolist()):
        mine = names == name
        yield name, at[mine], weights[mine], np.array([np.asarray(vectors[i], dtype=float) for i in at[mine]])


SUM_DDL = "fit string, mass double, total array<double>"


def _sums(rows: DataFrame, x: str, y: str, fits: str, terms) -> DataFrame:
    """(fit, mass, total): terms(fit, features, classes, weights) -> array, added over all rows of a fit."""

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, list] = {}
        for frame in frames:
            classes = frame[y].to_numpy()
            for fit, at, w, values in _by_fit(frame, x, fits):
                got = terms(fit, values, classes[at].astype(int), w)
                if got is not None:
                    old = total.setdefault(fit, [0.0, 0.0])
                    total[fit] = [old[0] + w.sum(), old[1] + got]
        yield pd.DataFrame([(k, m, t.tolist()) for k, (m, t) in total.items()], columns=["fit", "mass", "total"])

    return added(rows.select(x, y, fits).mapInPandas(part, SUM_DDL), ["fit"], ["mass"], ["total"])


def _starts(rows: DataFrame, x: str, y: str, fits: str, classes: int, balanced: bool) -> dict[str, Model]:
    """Fill values, means, scales and class weights of every fit, from its own rows; coefficients are zero."""
    each = rows.select(F.explode(fits).alias("f"), x).select("f.fit", F.posexplode(F.transform(x, lambda v: F.when(~F.isnan(v), v))).alias("i", "v"))
    filled = each.groupBy("fit", "i").agg(F.coalesce(F.median("v"), F.lit(0.0)).alias("fill"), (F.count("v") < F.count("*")).alias("gone"))
    fill = {r.fit: sorted(r.s) for r in filled.groupBy("fit").agg(F.collect_list(F.struct("i", "fill", "gone")).alias("s")).collect()}  # features of a fit
    zero = {k: Model(np.array([a.fill for a in s]), np.array([a.i for a in s if a.gone], int), np.zeros(1), np.ones(1), np.zeros(1), np.ones(classes)) for k, s in fill.items()}

    def terms(fit: str, values: np.ndarray, c: np.ndarray, w: np.ndarray) -> np.ndarray:
        d = zero[fit].design(values)[:, :-1]
        return np.concatenate([w @ d, w @ (d * d), np.bincount(c, w, classes)])

    out = {}
    for r in _sums(rows, x, y, fits, terms).collect():
        m, d = zero[r.fit], (len(r.total) - classes) // 2
        mass = np.array(r.total[2 * d :])
        if (mass > 0).sum() < classes:
            continue  # a fit without rows of every class has no model
        mean = np.array(r.total[:d]) / r.mass
        var = np.array(r.total[d : 2 * d]) / r.mass - mean**2
        scale = np.where(var > 1e-12 * np.maximum(1.0, mean**2), np.sqrt(np.maximum(var, 0)), 1.0)
        factors = r.mass / (classes * mass) if balanced else np.ones(classes)
        out[r.fit] = replace(m, mean=mean, scale=scale, beta=np.zeros((1 if classes == 2 else classes, d + 1)), factors=factors)
    return out


def _stepped(now: dict[str, Model], rows: DataFrame, x: str, y: str, fits: str, strength) -> dict[str, tuple[float, np.ndarray]]:
    """Loss and Newton direction of every fit at its present coefficients."""
    shape = {k: m.beta.shape for k, m in now.items()}

    def terms(fit: str, values: np.ndarray, c: np.ndarray, w: np.ndarray) -> np.ndarray | None:
        if fit not in now:
            return None
        m = now[fit]
        d, w = m.design(values), w * m.factors[c]
        p = _softmax(d @ m.beta.T)
        loss = -(w @ np.log(np.maximum(p[np.arange(len(c)), c], 1e-300)))
        q = p[:, 1:] if len(m.beta) == 1 else p
        t = (c[:, None] == np.arange(p.shape[1])[None, :]).astype(float)[:, p.shape[1] - q.shape[1] :]
        gradient = ((q - t) * w[:, None]).T @ d
        k, size = q.shape[1], d.shape[1]
        hessian = np.empty((k, size, k, size))
        for a in range(k):
            for b in range(k):
                hessian[a, :, b, :] = (d * (w * q[:, a] * ((a == b) - q[:, b]))[:, None]).T @ d
        return np.concatenate([[loss], gradient.ravel(), hessian.ravel()])

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        fit = frame["fit"].iloc[0]
        m, c, (k, size) = now[fit], strength(fit), shape[fit]
        total = np.asarray(frame["total"].iloc[0], float) * c
        n = k * size
        free = np.tile(np.r_[np.ones(size - 1), 0.0], k)  # constants are not held back
        flat = m.beta.ravel()
        loss = total[0] + 0.5 * (free * flat) @ flat
        hessian = total[1 + n :].reshape(n, n) + np.diag(free + 1e-10)
        step = -np.linalg.lstsq(hessian, total[1 : 1 + n] + free * flat, rcond=None)[0]
        return pd.DataFrame({"fit": [fit], "loss": [loss], "step": [step.tolist()]})

    solved = _sums(rows, x, y, fits, terms).groupBy("fit").applyInPandas(solve, "fit string, loss double, step array<double>")
    return {r.fit: (r.loss, np.array(r.step).reshape(shape[r.fit])) for r in solved.collect()}


def fitted(rows: DataFrame, x: str, y: str, fits: str = "fits", strength=1.0, classes: int = 2, balanced: bool = False, most_steps: int = 40, tolerance: float = 1e-9) -> dict[str, Model]:
    """A model for every fit that rows name: least strength * weighted log loss + half the squared coefficients.

    fits: a column array<struct<fit string, weight double>>. strength: a number, or a function of the fit's name. Features
    (x, array of double) may be null or NaN: they are filled with the fit's median, with a flag for each feature that
    has such rows. Features are scaled by the fit's own weighted mean and deviation. balanced: classes weigh the same.
    A fit without rows of every class (y from 0) has no model.
    """
    of = strength if callable(strength) else (lambda _: strength)
    rows = rows.select(x, y, fits).persist()  # every step passes over them
    try:
        everything = _starts(rows, x, y, fits, classes, balanced)
        size = max((m.beta.nbytes for m in everything.values()), default=1)
        names, at_once = sorted(everything), max(1, MODEL_BYTES // (4 * size))
        done: dict[str, Model] = {}
        for begin in range(0, len(names), at_once):
            now = {k: everything[k] for k in names[begin : begin + at_once]}
            last: dict[str, tuple[float, np.ndarray, np.ndarray]] = {}  # loss, coefficients and step where each came from
            for n in range(most_steps):
                for k, (loss, step) in _stepped(now, rows, x, y, fits, of).items():
                    m = now[k]
                    if k in last and loss > last[k][0] + 1e-9 * max(1.0, abs(last[k][0])):  # too far: half the way
                        before = last[k]
                        last[k] = before[0], before[1], before[2] / 2
                        now[k] = replace(m, beta=before[1] + before[2] / 2)
                        continue
                    last[k] = loss, m.beta, step
                    now[k] = replace(m, beta=m.beta + step, steps=n + 1)
                    if np.abs(step).max() <= tolerance * max(1.0, np.abs(m.beta).max()):
                        done[k] = now.pop(k)
                if not now:
                    break
            done |= now
        return done
    finally:
        rows.unpersist()


def scored(rows: DataFrame, x: str, models: dict[str, Model], by: str | Column, name: str = "scores") -> DataFrame:
    """Adds scores: array<struct<fit, p array<double>>>, probabilities of the classes by every fit named in by (array of names) that has a model."""
    rows = rows.withColumn("_by", by if isinstance(by, Column) else F.col(by))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[list] = [[] for _ in range(len(frame))]
            wanted = frame.assign(_by=[None if b is None else [{"fit": f, "weight": 1.0} for f in b if f in models] for b in frame["_by"]])
            for fit, at, _, values in _by_fit(wanted, x, "_by"):
                for i, p in zip(at, models[fit].probabilities(values), strict=True):
                    out[i].append({"fit": fit, "p": p.tolist()})
            yield frame.drop(columns="_by").assign(**{name: out})

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_by").schema.fields), f"`{name}` array<struct<fit:string,p:array<double>>>"])
    return rows.mapInPandas(each, ddl)


def named(*parts) -> Column:
    """The name of a fit from its parts."""
    return F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def training(*which: tuple[Column, Column]) -> Column:
    """The column fits from (condition, name): where the condition holds, the row trains in that fit with weight 1."""
    entry = lambda ok, name: F.when(ok, F.struct(name.alias("fit"), F.lit(1.0).alias("weight")))
    return F.array_compact(F.array(*[entry(ok, name) for ok, name in which]))


def naming(*which: tuple[Column, Column]) -> Column:
    """An array of the names whose condition holds, for scored()."""
    return F.array_compact(F.array(*[F.when(ok, name) for ok, name in which]))
