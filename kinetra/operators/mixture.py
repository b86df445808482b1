"""Gaussian mixtures with full covariances, fitted by expectation and maximisation: one pass over the rows for each step."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.operators.cluster import kmeans_runs


@dataclass
class Mixture:
    columns: tuple[str, ...]
    weights: list[float]
    means: list[list[float]]
    covariances: list[list[list[float]]]
    log_likelihood: float
    bic: float
    aic: float
    converged: bool
    steps: int

    def predict(self, df: DataFrame, label: str = "label") -> DataFrame:
        """df with the component of the largest posterior as column arithmetic; ties go to the lowest number."""
        scores = []
        for k, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances, strict=True)):
            inverse = np.linalg.inv(np.linalg.cholesky(np.array(c)))
            score = F.lit(float(np.log(w) + np.log(np.diag(inverse)).sum()))
            for i, row in enumerate(inverse):
                part = F.lit(float(-row @ np.array(m)))
                for j in range(i + 1):
                    part = part + F.col(self.columns[j]).cast("double") * float(row[j])
                score = score - F.pow(part, F.lit(2.0)) / 2
            scores.append(F.struct(score.alias("s"), F.lit(-k).alias("k")))
        return df.withColumn(label, -F.array_max(F.array(*scores))["k"])

    def save(self, path: str) -> None:
        """The model as JSON in a shared folder."""
        SparkSession.active().createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, path: str) -> Mixture:
        facts = json.loads(SparkSession.active().read.text(path).first().value)
        return cls(**facts | {"columns": tuple(facts["columns"])})


@dataclass
class _State:
    """Components of one start; `hard` ones are centres whose rows belong to the nearest wholly."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    hard: bool = False

    def posterior(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """(rows by components: the share of each, the log-likelihood of the rows)."""
        if self.hard:
            far = np.stack([((x - m) ** 2).sum(axis=1) for m in self.means], axis=1)
            return np.eye(len(self.means))[far.argmin(axis=1)], 0.0
        logs = np.empty((len(x), len(self.means)))
        for k, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances, strict=True)):
            low = np.linalg.cholesky(c)
            logs[:, k] = np.log(w) - np.log(np.diag(low)).sum() - (np.linalg.solve(low, (x - m).T) ** 2).sum(axis=0) / 2
        top = logs.max(axis=1, keepdims=True)
        total = top + np.log(np.exp(logs - top).sum(axis=1, keepdims=True))
        return np.exp(logs - total), float(total.sum() - len(x) * x.shape[1] * np.log(2 * np.pi) / 2)


def _moments(df: DataFrame, columns: Sequence[str], states: dict) -> dict:
    """By start: weight of each component, its first and second moments about its present mean, and the log-likelihood; one pass for all starts."""
    names, d = list(states), len(columns)
    size = {s: len(states[s].means) * (1 + d + d * d) + 1 for s in names}
    ends = np.cumsum([0, *(size[s] for s in names)])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ends[-1])
        for batch in batches:
            whole = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            for at in range(0, len(whole), 4_096):
                x = whole[at : at + 4_096]
                for j, s in enumerate(names):
                    share, likely = states[s].posterior(x)
                    found = [share.sum(axis=0)]
                    apart = [x - m for m in states[s].means]
                    found += [share[:, k] @ y for k, y in enumerate(apart)]
                    found += [((y * share[:, k : k + 1]).T @ y).ravel() for k, y in enumerate(apart)]
                    total[ends[j] : ends[j + 1]] += np.concatenate([*found, [likely]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], ["cell", "s"])

    flat = np.zeros(ends[-1])
    for r in df.mapInArrow(blocks, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect():
        flat[r.cell] = r.s
    out = {}
    for j, s in enumerate(names):
        f, k = flat[ends[j] : ends[j + 1]], len(states[s].means)
        out[s] = f[:k], f[k : k + k * d].reshape(k, d), f[k + k * d : -1].reshape(k, d, d), float(f[-1])
    return out


def _maximised(state: _State, n: np.ndarray, first: np.ndarray, second: np.ndarray, reg: float) -> _State:
    n = n + 10 * np.finfo(float).eps
    shift = first / n[:, None]
    covariances = second / n[:, None, None] - shift[:, :, None] * shift[:, None, :] + reg * np.eye(first.shape[1])
    return _State(n / n.sum(), state.means + shift, covariances)


def gaussian_mixtures(df: DataFrame, columns: Sequence[str], ks: Sequence[int], restarts: int = 1, seed: int = 42, max_iter: int = 300, reg: float = 1e-6, tol: float = 1e-3) -> dict[int, Mixture]:
    """By k the likeliest of several starts. All starts of all k take each step in the same pass over all rows.

    A start begins with the clusters of a k-means run; `reg` is added to the diagonal of each covariance. It has converged when a
    step changes the mean log-likelihood of a row by less than tol. Rows with a null or NaN are left out; without rows a ValueError is
    raised.
    """
    data = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop().persist()
    try:
        rows, d = data.count(), len(columns)
        first = kmeans_runs(data, columns, ks, 1, [seed + r for r in range(restarts)])
        states = {s: _State(np.empty(0), np.array(m.centres), np.empty(0), hard=True) for s, m in first.items()}
        states = {s: _maximised(states[s], *x[:3], reg) for s, x in _moments(data, columns, states).items()}
        last, steps, moving = dict.fromkeys(states, -np.inf), dict.fromkeys(states, 0), dict.fromkeys(states)
        for _ in range(max_iter):
            for s, (n, m1, m2, likely) in _moments(data, columns, {s: states[s] for s in moving}).items():
                states[s], steps[s] = _maximised(states[s], n, m1, m2, reg), steps[s] + 1
                if abs(likely / rows - last[s]) < tol:
                    del moving[s]
                last[s] = likely / rows
            if not moving:
                break
        final = {s: x[3] for s, x in _moments(data, columns, states).items()}
    finally:
        data.unpersist()
    out = {}
    for k in ks:
        s = max(((k, seed + r) for r in range(restarts)), key=lambda s: (last[s], -s[1]))
        free = k * d * (d + 1) / 2 + k * d + k - 1
        state, likely = states[s], final[s]
        out[k] = Mixture(tuple(columns), state.weights.tolist(), state.means.tolist(), state.covariances.tolist(), likely, free * float(np.log(rows)) - 2 * likely, 2 * free - 2 * likely, s not in moving, steps[s])
    return out


def gaussian_mixture(df: DataFrame, columns: Sequence[str], k: int, restarts: int = 1, seed: int = 42, max_iter: int = 300) -> Mixture:
    """The likeliest of several starts, as in `gaussian_mixtures`."""
    return gaussian_mixtures(df, columns, [k], restarts, seed, max_iter)[k]
