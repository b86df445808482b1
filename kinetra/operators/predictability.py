"""How well a group can be told from scores: cross-validated, class-balanced multinomial regression, all folds in the same passes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.functions.quantiles import placed


def dealt(df: DataFrame, columns: Sequence[str], group: str, key: str, folds: int, seed: int) -> tuple[DataFrame, list]:
    """((columns as doubles, y, fold, weight), the groups by number): folds in hash order within each group; weights make every group count the same."""
    sizes = {r[0]: r[1] for r in df.where(F.col(group).isNotNull()).groupBy(group).count().orderBy(group).collect()}
    names, total = list(sizes), sum(sizes.values())
    if not names:
        raise ValueError("no rows with a group")
    of = lambda values: F.create_map(*[F.lit(x) for n, v in values.items() for x in (n, float(v))])[F.col(group)]
    order = F.struct(F.xxhash64(key, F.lit(seed)).alias("h"), F.col(key).alias("key"))
    fold = placed(df.select(F.col(group).alias("_g"), order.alias("_o")), ["_g"], "_o").select("_g", F.col("_o.key").alias("_k"), (F.col("before") % folds).alias("_fold"))
    joined = df.join(fold, (F.col(group) == F.col("_g")) & (F.col(key) == F.col("_k")))
    y, weight = of({g: k for k, g in enumerate(names)}), of({g: total / (len(names) * n) for g, n in sizes.items()})
    scores = [F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(columns)]
    return joined.select(*scores, y.alias("_y"), F.col("_fold").cast("double").alias("_fold"), weight.alias("_w")), names


def _posterior(x: np.ndarray, model: np.ndarray) -> np.ndarray:
    logits = x @ model
    logits = np.exp(logits - logits.max(axis=1, keepdims=True))
    return logits / logits.sum(axis=1, keepdims=True)


def _totals(data: DataFrame, size: int, of_block) -> np.ndarray:
    """The sum of of_block(scores and a one, y, fold, weight) over all blocks of rows."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            whole = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            for at in range(0, len(whole), 4_096):
                b = whole[at : at + 4_096]
                total += of_block(np.column_stack([b[:, :-3], np.ones(len(b))]), b[:, -3].astype(int), b[:, -2], b[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int64()), pa.array(total)], ["cell", "s"])

    flat = np.zeros(size)
    for r in data.mapInArrow(blocks, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect():
        flat[r.cell] = r.s
    return flat


def _newton_sums(data: DataFrame, models: dict[int, np.ndarray]) -> dict[int, tuple[float, float, np.ndarray, np.ndarray]]:
    """By fold, over the rows outside it: weight, weighted log-loss, gradient and Hessian at its model (columns by groups)."""
    p, c = next(iter(models.values())).shape
    each = 2 + p * c + (p * c) ** 2

    def of_block(x, y, fold, weight):
        out = []
        for k, model in models.items():
            here = fold != k
            xs, ws = x[here], weight[here][:, None]
            share, own = _posterior(xs, model), np.eye(c)[y[here]]
            loss = -(ws[:, 0] * np.log(np.maximum((share * own).sum(axis=1), 1e-300))).sum()
            z = (share[:, :, None] * xs[:, None, :]).reshape(len(xs), c * p)
            hessian = -(z * ws).T @ z
            for a in range(c):
                hessian[a * p : (a + 1) * p, a * p : (a + 1) * p] += (xs * ws * share[:, a : a + 1]).T @ xs
            out += [[ws.sum(), loss], (((share - own) * ws).T @ xs).ravel(), hessian.ravel()]
        return np.concatenate(out)

    flat = _totals(data, each * len(models), of_block).reshape(len(models), each)
    return {k: (f[0], f[1], f[2 : 2 + p * c], f[2 + p * c :].reshape(p * c, p * c)) for k, f in zip(models, flat, strict=True)}


def fit_folds(data: DataFrame, columns: int, groups: int, folds: int, penalty: float, max_iter: int = 100, tol: float = 1e-9) -> list[np.ndarray]:
    """A model (columns and a constant, by groups) for each fold, fitted on the rows outside it: damped Newton steps on mean log-loss + penalty / 2 * squared weights, constants free. All folds take each step in the same pass."""
    p = columns + 1
    shrunk = np.tile([penalty] * columns + [0.0], groups)
    models = {k: np.zeros((p, groups)) for k in range(folds)}
    kept: dict[int, tuple] = {}
    moving = dict.fromkeys(models)
    for _ in range(max_iter):
        for k, (weight, loss, gradient, hessian) in _newton_sums(data, {k: models[k] for k in moving}).items():
            flat = models[k].T.ravel()
            goal = loss / max(weight, 1e-300) + (shrunk * flat * flat).sum() / 2
            if k in kept and goal > kept[k][0] + 1e-4 * kept[k][3] * kept[k][4] + 1e-14:  # too far: half the step from where it was
                goal, flat, step, length, slope = kept[k]
                length /= 2
            else:
                slope_at = gradient / max(weight, 1e-300) + shrunk * flat
                step = -np.linalg.lstsq(hessian / max(weight, 1e-300) + np.diag(shrunk), slope_at, rcond=None)[0]
                length, slope = 1.0, float(slope_at @ step)
            if -slope * length < tol:
                del moving[k]
            kept[k] = goal, flat, step, length, slope
            models[k] = (flat + length * step).reshape(groups, p).T
        if not moving:
            break
    return [models[k] for k in range(folds)]


def city_balanced_accuracy(df: DataFrame, columns: Sequence[str], group: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """One row (balanced_accuracy_mean, balanced_accuracy_std, chance) over stratified folds.

    Folds are dealt by hash order within each group, keys being distinct and rows without a group left out; weights make every group count the same;
    the penalty is 1/total weight. What a task holds is bounded by groups and columns: folds * (groups * (columns + 1)) ** 2 numbers.
    """
    data, names = dealt(df, columns, group, key, folds, seed)
    data, c = data.persist(), len(names)
    models = fit_folds(data, len(columns), c, folds, folds / (data.count() * (folds - 1)))

    def of_block(x, y, fold, weight):
        found = np.zeros((folds, c, 2))
        for k, model in enumerate(models):
            here = fold == k
            np.add.at(found, (k, y[here], 0), 1)
            np.add.at(found, (k, y[here], 1), (x[here] @ model).argmax(axis=1) == y[here])
        return found.ravel()

    found = _totals(data, folds * c * 2, of_block).reshape(folds, c, 2)
    data.unpersist()
    scores = [(float(np.mean([hit / n for n, hit in f if n])) if f[:, 0].any() else 0.0,) for f in found]
    out = df.sparkSession.createDataFrame(scores, "s double")
    return out.agg(F.avg("s").alias("balanced_accuracy_mean"), F.stddev_samp("s").alias("balanced_accuracy_std"), F.lit(1.0 / c).alias("chance"))
