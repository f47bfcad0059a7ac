"""Regression from sufficient statistics: one pass over the rows feeds every solver.

``gram`` sums Z'Z, Z'Y, Y'Y and n. Few columns are summed by generated expressions with partial aggregation; many by NumPy
products of Arrow batches, one result a task, added up by cell. Solvers are plain functions of the sums, and fits small.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import mix
from .series import lagged

#: Above this many columns the sums go through Arrow.
WIDE = 24


@dataclass
class Sums:
    """G = Z'Z, C = Z'Y, s = diag Y'Y, column sums of Y, and the number of rows."""

    g: np.ndarray
    c: np.ndarray
    s: np.ndarray
    y: np.ndarray
    n: int

    def error(self, w: np.ndarray) -> float:
        """Mean squared error over rows and outputs."""
        return max(0.0, float(self.s.sum() - 2 * (w * self.c).sum() + (w * (self.g @ w)).sum())) / max(1, self.n * self.c.shape[1])

    def r2(self, w: np.ndarray) -> float:
        """Pooled over all outputs, with one mean for them all."""
        rows = max(1, self.n * self.c.shape[1])
        total = self.s.sum() - self.y.sum() ** 2 / rows
        return float(1 - self.error(w) * rows / total) if total > 0 else 0.0


def gram(df: DataFrame, z: Sequence[Column], y: Sequence[Column] = (), wide: int = WIDE) -> Sums:
    """Sums over the complete rows of ``df``."""
    p, m = len(z), len(y)
    names = [f"c{i}" for i in range(p + m)]
    table = df.select(*(c.cast("double").alias(n) for c, n in zip((*z, *y), names, strict=True))).dropna()
    if p + m <= wide:
        cells = [(i, j) for i in range(p + m) for j in range(i, p + m) if i < p or i == j]
        r = table.agg(F.count("*").alias("n"), *(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i, j in cells), *(F.sum(names[p + k]).alias(f"y{k}") for k in range(m))).first()
        whole = np.zeros((p + m, p + m))
        for i, j in cells:
            whole[i, j] = whole[j, i] = r[f"s{i}_{j}"] or 0.0
        sums, n = np.array([r[f"y{k}"] or 0.0 for k in range(m)]), r["n"]
    else:

        def run(batches):
            total, count = np.zeros((p + m, p + m)), 0
            line = np.zeros(p + m)
            for b in batches:
                x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(p + m)])
                total, count, line = total + x.T @ x, count + len(x), line + x.sum(0)
            yield pa.RecordBatch.from_pydict({"i": np.repeat(np.arange(p + m + 1), p + m + 1), "j": np.tile(np.arange(p + m + 1), p + m + 1), "v": np.block([[total, line[:, None]], [line[None, :], np.full((1, 1), float(count))]]).reshape(-1)})

        whole = np.zeros((p + m + 1, p + m + 1))
        for r in table.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            whole[r["i"], r["j"]] = r["v"]
        sums, n = whole[p : p + m, -1], int(whole[-1, -1])
    return Sums(whole[:p, :p], whole[:p, p : p + m], np.diag(whole)[p : p + m].copy(), np.asarray(sums), int(n))


def ols(sums: Sums) -> np.ndarray:
    """Minimum-norm least squares; columns are scaled to one before the pseudo-inverse."""
    d = np.sqrt(np.where(np.diag(sums.g) > 0, np.diag(sums.g), 1.0))
    return np.linalg.pinv(sums.g / np.outer(d, d), hermitian=True) @ (sums.c / d[:, None]) / d[:, None]


def greedy(sums: Sums, density: float = 0.01, n_iter: int = 100, rel_tol: float = 1e-6) -> np.ndarray:
    """Rounds of least squares on the residual that let in the largest coefficients not yet chosen, and refit those chosen."""
    p, m = sums.c.shape
    k, chosen, w = max(1, round(density * p * m)), np.zeros((p, m), bool), np.zeros((p, m))
    last = sums.error(w)
    for _ in range(n_iter):
        step = ols(Sums(sums.g, sums.c - sums.g @ w, sums.s, sums.y, sums.n))
        step[chosen] = 0
        order = np.argsort(-np.abs(step), axis=None, kind="stable")[:k]
        order = order[step.reshape(-1)[order] != 0]
        if not len(order):
            break
        trial = chosen.copy()
        trial.reshape(-1)[order] = True
        fit = np.zeros((p, m))
        for j in range(m):
            own = np.flatnonzero(trial[:, j])
            if len(own):
                fit[own, j] = ols(Sums(sums.g[np.ix_(own, own)], sums.c[own, j : j + 1], sums.s, sums.y, sums.n))[:, 0]
        now = sums.error(fit)
        if last <= 0 or (last - now) / max(last, 1e-300) < rel_tol:
            break
        chosen, w, last = trial, fit, now
    return w


def soft(v: np.ndarray, t) -> np.ndarray:
    return np.sign(v) * np.maximum(np.abs(v) - t, 0)


def lasso(sums: Sums, lam: float = 1.0, n_iter: int = 10_000, rel_tol: float = 1e-6) -> np.ndarray:
    """Coordinate descent for the squared error / 2 + lam n |w|; all outputs move together."""
    p, m = sums.c.shape
    w, d = np.zeros((p, m)), np.diag(sums.g)
    for _ in range(n_iter):
        before = w.copy()
        for j in np.flatnonzero(d > 0):
            w[j] = soft(sums.c[j] - sums.g[j] @ w + d[j] * w[j], lam * sums.n) / d[j]
        moved = np.linalg.norm(w - before)
        if moved <= rel_tol or moved <= rel_tol * np.linalg.norm(w):
            break
    return w


def relaxed(g: np.ndarray, c: np.ndarray, lam: float, rho: float = 1.0, n_iter: int = 100, rel_tol: float = 1e-6, cut: float = 0.1, start=None):
    """Sparse relaxed regression by ADMM on given sums, with a last hard threshold of cut lam / rho. (coefficients, state to go on from)."""
    inverse = np.linalg.inv(g + rho * np.eye(len(g)))
    z, u = (np.zeros_like(c), np.zeros_like(c)) if start is None else start
    for _ in range(n_iter):
        x = inverse @ (c + rho * (z - u))
        z, last = soft(x + u, lam / rho), z
        u = u + x - z
        if max(np.linalg.norm(z - last), np.linalg.norm(x - z)) <= rel_tol * max(np.linalg.norm(last), 1e-12):
            break
    return np.where(np.abs(z) > cut * lam / rho, z, 0.0), (z, u)


def sr3(sums: Sums, lam: float = 1e-3, rho: float = 1.0, n_iter: int = 100, rel_tol: float = 1e-6) -> np.ndarray:
    return relaxed(sums.g, sums.c, lam, rho, n_iter, rel_tol, 0.1)[0]


@dataclass
class Path:
    """A regularisation path: one model a lambda, the best by error on rows held out."""

    num_steps: int = 20
    lambda_max: float = 1.0
    lambda_min: float = 1e-4
    rho: float = 1.0
    n_iter: int = 100
    rel_tol: float = 1e-6
    models: list[dict] = field(default_factory=list)

    def fit(self, df: DataFrame, z: Sequence[Column], y: Sequence[Column], row_id: str, held_out: float = 0.1, seed: int = 0) -> Path:
        """All rows count: a share of them by hash for the errors, the rest for the sums."""
        test = mix(F.col(row_id), seed) % 10_000 < int(held_out * 10_000)
        train, check = gram(df.where(~test), z, y), gram(df.where(test), z, y)
        if not check.n:
            check = train
        n, state = max(1, train.n), None
        self.models = []
        for lam in np.geomspace(self.lambda_max, self.lambda_min, self.num_steps):
            w, state = relaxed(train.g / n, train.c / n, lam, self.rho, self.n_iter, self.rel_tol, 0.5, state)
            self.models.append({"lambda": float(lam), "params": w.tolist(), "loss": check.error(w), "r2_score": check.r2(w), "density": float((w != 0).mean())})
        return self

    def best(self) -> np.ndarray:
        return np.array(min(self.models, key=lambda m: m["loss"])["params"])

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, m["lambda"], m["params"], m["loss"], m["r2_score"], m["density"]) for i, m in enumerate(self.models)], "step int, lambda double, params array<array<double>>, loss double, r2_score double, density double")

    def save(self, spark, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark, path: str) -> Path:
        return cls(**json.loads(spark.read.text(path, wholetext=True).first()[0]))


def predicted(z: Sequence[Column], w: np.ndarray) -> list[Column]:
    """z w as columns; zero coefficients leave no trace in the plan."""
    out = []
    for j in range(np.shape(w)[1]):
        terms = [c * float(v) for c, v in zip(z, np.asarray(w)[:, j], strict=True) if v]
        out.append(sum(terms[1:], terms[0]) if terms else F.lit(0.0))
    return out


Solver = Callable[[Sums], np.ndarray]


def identified(df: DataFrame, key: str, by: Sequence[str], states: Sequence[str], inputs: Sequence[str], solver: Solver = ols, dictionary=None, append: bool = False, lags: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(A, B) of next states = A states + B inputs, over all keys.

    ``dictionary`` replaces the features by its own, or adds to them (``append``); then A has the first len(states) of all
    features and B the others. With ``lags`` earlier rows are features, too.
    """
    table = lagged(df, key, by, states, inputs, lags)
    z = [F.col(f"{c}_lag{k}").cast("double") for k in range(lags + 1) for c in (*states, *inputs)]
    if dictionary is not None:
        z = [*z, *dictionary(z)] if append else dictionary(z)
    w = solver(gram(table, z, [F.col(f"{c}_next").cast("double") for c in states])).T
    return w[:, : len(states)], w[:, len(states) :]


def ransac(df: DataFrame, key: str, by: Sequence[str], states: Sequence[str], inputs: Sequence[str], row_id: str, hypotheses: int = 100, sample_multiplier: float = 1.0, tolerance: float = 1e-3, seed: int = 0) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """(A, B, rows with ``inlier``): the best of many exact fits to few rows, refitted to the rows within ``tolerance`` of it.

    The few rows of all hypotheses come from one bounded sample; all hypotheses are then counted in one pass over all rows.
    """
    table = lagged(df, key, by, states, inputs)
    names, outs = [f"{c}_lag0" for c in (*states, *inputs)], [f"{c}_next" for c in states]
    d = len(names)
    k = max(d, int(np.ceil(sample_multiplier * d)))
    drawn = table.withColumn("_h", mix(F.col(row_id), seed)).orderBy("_h", row_id).limit(max(4 * k, min(hypotheses * k, 20_000))).select(*names, *outs).toPandas().to_numpy(float)
    rng, models = np.random.default_rng(seed), []
    for _ in range(hypotheses if len(drawn) >= k else 0):
        own = drawn[rng.choice(len(drawn), k, replace=False)]
        if np.linalg.matrix_rank(own[:, :d]) == d:
            models.append(np.linalg.lstsq(own[:, :d], own[:, d:], rcond=None)[0])
    best = np.zeros((d, len(states)))
    if models:

        def run(batches):
            hits = np.zeros(len(models), np.int64)
            for b in batches:
                x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(d + len(outs))])
                for i, w in enumerate(models):
                    hits[i] += (np.linalg.norm(x[:, d:] - x[:, :d] @ w, axis=1) < tolerance).sum()
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(models)), "n": hits})

        found = table.select(*(F.col(c).cast("double") for c in (*names, *outs))).mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "i").first()
        best = models[found["i"]]
    marked = with_inliers(table, names, outs, best, tolerance)
    z, y = [F.col(c).cast("double") for c in names], [F.col(c).cast("double") for c in outs]
    refit = gram(marked.where("inlier"), z, y)
    w = (ols(refit) if refit.n >= d else best).T
    return w[:, : len(states)], w[:, len(states) :], marked


def with_inliers(table: DataFrame, names: Sequence[str], outs: Sequence[str], w: np.ndarray, tolerance: float) -> DataFrame:
    """``inlier``: the distance of the row's outputs from z w is below ``tolerance``."""
    gaps = [F.col(o) - p for o, p in zip(outs, predicted([F.col(c).cast("double") for c in names], w), strict=True)]
    return table.withColumn("inlier", F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])) < tolerance)
