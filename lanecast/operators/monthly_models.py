"""One multinomial logistic model a month, each of all months before it, from sums over the months.

A model is a point, so the driver holds months x classes x features numbers. What data contribute are sums: per month
counts, means and squares (each model standardises by its own months), and per step the losses, gradients and curvatures of all
models, which one pass over the rows takes together: a row of month m adds to every model after m. The start is the fit of the first
`least_months`, which all models have seen; then all take Newton steps, halved where the loss would rise. A curvature of every model costs
some classes x features times what its gradient does. So beyond EXACT_ROWS rows, or where the tasks' curvatures of all models would be more
than EXACT_BYTES, they are taken once, at the start, by month, and summed over each model's months; it takes more steps then, but each
is a gradient only, and they go to the same penalised optimum, which depends on neither the start nor the curvature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ADDERS = 64  # tasks that add up what the others found; the driver adds up theirs
STEPS = 200
SUMS_BYTES = 1 << 26  # of all arrays that the driver adds up, where there may be fewer adders
EXACT_BYTES = 1 << 31
EXACT_ROWS = 1 << 16
CHUNK = 1024  # rows whose probabilities by all models are held at once
TOLERANCE = 1e-8  # of the mean gradient


@dataclass
class Models:
    """weights[i] is the model for month `first + i`: classes x (1 + features), of the features as given."""

    first: int
    weights: np.ndarray
    trained: np.ndarray  # rows

    def score(self, rows: DataFrame, ahead: int = 0) -> DataFrame:
        """rows (month, x and others) with `probs`, by the model for the month that is `ahead` months earlier; rows without one go."""
        weights, first, names = self.weights, self.first + ahead, [c for c in rows.columns if c != "x"]

        def read(batches):
            for batch in batches:
                k = batch.column("month").to_numpy() - first
                batch = batch.filter(pa.array((k >= 0) & (k < len(weights))))
                k, x = k[(k >= 0) & (k < len(weights))], _matrix(batch)
                out = np.empty((len(k), weights.shape[1] if len(weights) else 0))
                for m in np.unique(k):
                    out[k == m] = _softmax(x[k == m] @ weights[m].T)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(out.tolist(), pa.list_(pa.float64()))], [*names, "probs"])

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names)
        return rows.mapInArrow(read, f"{schema}, probs array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """x with a leading 1."""
    x = batch.column("x")
    n = len(x)
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.hstack([np.ones((n, 1)), flat.reshape(n, -1)]) if n else np.ones((0, 1))


def _softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=-1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=-1, keepdims=True)
    return z


def _runs(month: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Slices of one month each, of CHUNK rows at most."""
    ends = [*(np.flatnonzero(np.diff(month)) + 1), len(month)]
    for lo, hi in zip([0, *ends], ends, strict=False):
        for at in range(lo, hi, CHUNK):
            yield int(month[lo]), slice(at, min(at + CHUNK, hi))


def _summed(rows: DataFrame, shape: tuple[int, ...], add: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """The sum over tasks of an array that `add` fills from (array, month, matrix, label) of each batch."""

    def part(batches):
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                order = np.argsort(batch.column("month").to_numpy(), kind="stable")
                add(total, batch.column("month").to_numpy()[order], _matrix(batch)[order], batch.column("label").to_numpy()[order])
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def together(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sums": [sum(np.frombuffer(b) for b in group["sums"]).tobytes()]})

    parts = rows.select("month", "x", "label").mapInArrow(part, "sums binary")
    adders = min(ADDERS, max(1, SUMS_BYTES // (8 * int(np.prod(shape)))))
    found = parts.withColumn("adder", F.spark_partition_id() % adders).groupBy("adder").applyInPandas(together, "sums binary").collect()  # at most ADDERS rows of the array's size
    return sum((np.frombuffer(r["sums"]) for r in found), np.zeros(int(np.prod(shape)))).reshape(shape)


def fitted(rows: DataFrame, months: int, classes: int, features: int, least_months: int = 12, c: float = 1.0, tolerance: float = TOLERANCE) -> Models:
    """rows: month (0 to months - 1), label (0 to classes - 1), x (array of doubles, as many as features); stored, best dealt evenly and each part in order of month.

    Models for the months least_months .. months - 1; the penalty is |w|^2 / (2 c) without the intercepts, as with a sum of losses."""
    d, count = features + 1, max(0, months - least_months)
    if not count:
        return Models(least_months, np.zeros((0, classes, d)), np.zeros(0))

    def moments(total, month, x, _):
        for m in np.unique(month):
            v = x[month == m]
            total[m, 0] += len(v)
            total[m, 1 : 1 + d] += v.sum(axis=0)
            total[m, 1 + d :] += (v * v).sum(axis=0)

    sums = np.cumsum(_summed(rows, (months, 1 + 2 * d), moments), axis=0)[least_months - 1 : months - 1]
    n = sums[:, 0]
    safe = np.maximum(n, 1)[:, None]
    mean = sums[:, 2 : 1 + d] / safe
    sd = np.sqrt(np.maximum(sums[:, 2 + d :] / safe - mean**2, 0))
    sd[sd < 1e-12] = 1.0
    scale = np.zeros((count, d, d))  # of each model, from features with a leading 1 to standardised ones
    scale[:, 0, 0] = 1.0
    scale[:, 1:, 0] = -mean / sd
    scale[:, np.arange(1, d), np.arange(1, d)] = 1 / sd
    ridge = np.r_[1e-9, np.full(d - 1, 1 / c)]  # the intercepts' is there for the solver alone
    raw = lambda v: np.einsum("fkd,fde->fke", v, scale)  # noqa: E731  weights for the features as given

    size = classes * d
    pairs = [(a, b) for a in range(classes) for b in range(a, classes)]

    def squares(v):
        """v v' of each row, flat."""
        return (v[:, :, None] * v[:, None, :]).reshape(len(v), d * d)

    def evaluate(w: np.ndarray, models: range, curved: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Losses, gradients and curvatures of the models at w, in the features as given."""
        shape = (len(models), 1 + size + curved * size * size)

        def add(total, month, x, label):
            for m, at in _runs(month):
                first = max(models.start, m - least_months + 1)  # the models from here on have seen month m
                open_, v, y = w[first : models.stop], x[at], label[at]
                if not len(open_):
                    continue
                p = _softmax((v @ open_.reshape(-1, d).T).reshape(len(v), len(open_), classes))
                out = total[first - models.start :]
                out[:, 0] -= np.log(np.maximum(p[np.arange(len(v)), :, y], 1e-300)).sum(axis=0)
                if curved:
                    h, vv = out[:, 1 + size :].reshape(len(open_), classes, d, classes, d), squares(v).T
                    for a, b in pairs:
                        c = (vv @ (p[:, :, a] * ((a == b) - p[:, :, b]))).T.reshape(-1, d, d)
                        h[:, a, :, b, :] += c
                        if a != b:
                            h[:, b, :, a, :] += c
                p[np.arange(len(v)), :, y] -= 1
                out[:, 1 : 1 + size] += (p.reshape(len(v), -1).T @ v).reshape(len(open_), size)

        total = _summed(rows.where(F.col("month") < least_months + models.stop - 1), shape, add)  # the last of them has seen no others
        return total[:, 0], total[:, 1 : 1 + size].reshape(-1, classes, d), total[:, 1 + size :].reshape(len(models), -1)

    def curvatures(w: np.ndarray) -> np.ndarray:
        """Of each model's months, at one point (features as given)."""

        def add(total, month, x, _):
            for m, at in _runs(month):
                v = x[at]
                p = _softmax(v @ w.T)
                total[m] += np.stack([p[:, a] * ((a == b) - p[:, b]) for a, b in pairs]) @ squares(v)

        half = np.cumsum(_summed(rows, (months, len(pairs), d * d), add), axis=0)[least_months - 1 : months - 1].reshape(count, len(pairs), d, d)
        h = np.zeros((count, classes, d, classes, d))
        for n_, (a, b) in enumerate(pairs):
            h[:, a, :, b, :] = h[:, b, :, a, :] = half[:, n_]
        return h

    def descend(v: np.ndarray, models: range, fixed: np.ndarray | None = None) -> np.ndarray:
        """v with these models at their optimum."""
        best, best_loss = v.copy(), np.full(count, np.inf)
        move, step, done = np.zeros_like(v), np.ones(count), np.ones(count, bool)
        done[models.start : models.stop] = False
        for _ in range(STEPS):
            loss, gradient, curvature = evaluate(raw(v), models, fixed is None)
            for k, f in enumerate(models):
                if done[f]:
                    continue
                total = loss[k] + 0.5 * (v[f] ** 2 * ridge).sum()
                if total > best_loss[f] + 1e-12 * abs(best_loss[f]):  # too far
                    step[f] /= 2
                    done[f] = step[f] < 1e-6
                else:
                    best[f], best_loss[f], step[f] = v[f], total, 1.0
                    g = gradient[k] @ scale[f].T + v[f] * ridge
                    done[f] = np.abs(g).max() <= tolerance * max(n[f], 1)
                    wide = np.kron(np.eye(classes), scale[f])
                    h = (curvature[k] if fixed is None else fixed[f]).reshape(size, size)
                    move[f] = np.linalg.solve(wide @ h @ wide.T + np.diag(np.tile(ridge, classes)), g.ravel()).reshape(classes, d)
                v[f] = best[f] if done[f] else best[f] - step[f] * move[f]
            if done.all():
                break
        return best

    start = descend(np.zeros((count, classes, d)), range(1))
    w0 = raw(start)[0]
    v = np.stack([w0 @ np.linalg.inv(m) for m in scale])  # the same point for every model, in its own scale
    exact = n[-1] <= EXACT_ROWS and rows.rdd.getNumPartitions() * count * size * size * 8 <= EXACT_BYTES
    return Models(least_months, raw(descend(v, range(count), None if exact else curvatures(w0))), n)
