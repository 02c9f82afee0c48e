"""Dense passes over feature vectors: sums, maps by a matrix, and linear heads fitted together.

A pass reads Arrow batches, works on each as one matrix, and returns one flat vector of sums per task; the sums of all
tasks are added by a shuffle, so the driver receives one vector whatever the number of tasks or rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DESCENT = 1e-4
#: Entries of all Hessians that may come to the driver in a pass (32 MB), and products in one step beyond that.
HESSIAN_VALUES = 1 << 22
PRODUCTS = 20


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long lists as a two-dimensional array."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def summed(df: DataFrame, size: int, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all batches of ``part(batch)``, a vector of ``size`` doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["at", "v"])

    rows = df.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(size)
    out[rows["at"].to_numpy(np.int64)] = rows["v"].to_numpy()
    return out


def mapped(features: Column, df: DataFrame, weights: np.ndarray | None, centre: np.ndarray, scale: np.ndarray | None = None) -> Column:
    """(features - centre) / scale, times ``weights``; the arrays are broadcast and their size is that of a vector's map."""
    shared = df.sparkSession.sparkContext.broadcast((weights, centre, scale))

    @F.arrow_udf("array<double>")
    def apply(column: pa.Array) -> pa.Array:
        weights, centre, scale = shared.value
        there = column.drop_null()
        x = matrix(there) - centre if len(there) else np.zeros((0, len(centre)))
        x = x if scale is None else x / scale
        x = x if weights is None else x @ weights
        width = x.shape[1]
        known = np.asarray(column.is_valid())
        ends = np.concatenate([[0], np.cumsum(known * width)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()), mask=pa.array(~known))

    return apply(features)


def moments(df: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and population deviation of each feature, summed around the least row to keep digits."""
    least = df.agg(F.min("features")).first()[0]
    if least is None:
        return 0, np.zeros(d), np.zeros(d)
    origin = np.array([float(v) for v in least])

    def part(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column("features")) - origin
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    total = summed(df.select("features"), 1 + 2 * d, part)
    n, mean = total[0], total[1 : d + 1] / total[0]
    return int(n), mean + origin, np.sqrt(np.maximum(total[d + 1 :] / n - mean * mean, 0))


def top_directions(df: DataFrame, d: int, k: int, mean: np.ndarray, rows: int, passes: int = 40, tolerance: float = 1e-10) -> np.ndarray:
    """The ``k`` leading eigenvectors of the covariance by block Krylov steps: each pass adds C times the newest block.

    Only ``d`` times block values reach the driver in a pass. The space is exact once it holds ``d`` directions, and the
    passes stop earlier when the wanted directions no longer leave it.
    """
    block = min(d, k + 8)
    newest = np.linalg.qr(np.random.default_rng(1).normal(size=(d, block)))[0]
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    for _ in range(passes):
        width = newest.shape[1]

        def part(batch: pa.RecordBatch, v=newest) -> np.ndarray:
            x = matrix(batch.column("features")) - mean
            return (x.T @ (x @ v)).ravel()

        fresh = summed(df.select("features"), d * width, part).reshape(d, width) / max(rows, 1)
        basis, image = np.hstack([basis, newest]), np.hstack([image, fresh])
        small = basis.T @ image
        values, inner = np.linalg.eigh((small + small.T) / 2)
        pick = np.argsort(values)[::-1][:k]
        found = basis @ inner[:, pick]
        left = image @ inner[:, pick] - found * values[pick]
        if basis.shape[1] >= d or np.linalg.norm(left, axis=0).max() <= tolerance * max(values.max(), 1e-300):
            break
        rest = fresh
        for _ in range(2):
            rest = rest - basis @ (basis.T @ rest)
        u, s, _ = np.linalg.svd(rest, full_matrices=False)
        newest = u[:, s > 1e-12 * max(s[0], 1e-300)][:, : d - basis.shape[1]]
        if newest.shape[1] == 0:
            break
    return found


@dataclass(frozen=True)
class Losses:
    """The loss of each head; heads are numbers of columns of ``y``. This is what tasks get."""

    heads: np.ndarray
    logistic: np.ndarray
    huber: np.ndarray
    delta: float

    def only(self, which: np.ndarray) -> Losses:
        return Losses(self.heads[which], self.logistic[which], self.huber[which], self.delta)

    def rows(self, batch: pa.RecordBatch, w: np.ndarray) -> tuple[np.ndarray, ...]:
        """Features with a constant, and for each row and head the loss, its slope and its bend."""
        x = matrix(batch.column("features"))
        x = np.hstack([x, np.ones((len(x), 1))])
        y = matrix(batch.column("y"))[:, self.heads]
        z = x @ w.T
        r = z - y
        p = 0.5 * (1 + np.tanh(z / 2))
        bent = np.clip(r, -self.delta, self.delta)
        loss = np.where(self.logistic, np.logaddexp(0, z) - y * z, np.where(self.huber, bent * (r - bent / 2), r * r))
        slope = np.where(self.logistic, p - y, np.where(self.huber, bent, 2 * r))
        bend = np.where(self.logistic, p * (1 - p), np.where(self.huber, (np.abs(r) <= self.delta).astype(float), 2.0))
        return x, loss, slope, bend


class Curves:
    """Values, gradients and curvature of many linear heads, all from one pass over the rows that are still needed.

    Head ``heads[j]`` (a column of ``y``) has loss ``kinds[heads[j]]`` and penalty ``l2[j]``; the value is ``share`` times the mean of the
    weighted loss plus half of ``l2`` times the squared weights and bias. While all Hessians together have at most
    ``HESSIAN_VALUES`` entries a pass brings their upper halves; beyond that it brings their diagonals, and ``product`` is a pass that
    multiplies every Hessian by a direction.
    """

    def __init__(self, train: DataFrame, d: int, kinds: list[str], heads: np.ndarray, weights: np.ndarray, l2: np.ndarray, share: np.ndarray, delta: float):
        kind = np.array([kinds[h] for h in heads])
        self.train, self.width, self.l2, self.losses = train, d + 1, l2, Losses(heads, kind == "logistic", kind == "huber", delta)
        self.scale = share * weights / max(train.count(), 1)
        self.dense = len(heads) * self.width * (self.width + 1) // 2 <= HESSIAN_VALUES
        self.upper = np.triu_indices(self.width)

    def _pass(self, size: int, part: Callable[[pa.RecordBatch, np.ndarray], np.ndarray], *sent: np.ndarray) -> np.ndarray:
        shared = self.train.sparkSession.sparkContext.broadcast(sent)
        total = summed(self.train, size, lambda batch: part(batch, *shared.value))
        shared.unpersist()
        return total

    def evaluate(self, w: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Value, gradient and curvature (whole matrices, or diagonals) of the heads in ``which`` at ``w``."""
        k, width, dense, upper, losses = len(which), self.width, self.dense, self.upper, self.losses.only(which)
        bends = len(upper[0]) if dense else width

        def part(batch: pa.RecordBatch, w: np.ndarray) -> np.ndarray:
            x, loss, slope, bend = losses.rows(batch, w)
            if dense:
                curve = np.stack([((x * bend[:, j : j + 1]).T @ x)[upper] for j in range(k)])
            else:
                curve = bend.T @ (x * x)
            return np.concatenate([loss.sum(0), (slope.T @ x).ravel(), curve.ravel()])

        total = self._pass(k * (1 + width + bends), part, w)
        scale, l2 = self.scale[which], self.l2[which]
        value = total[:k] * scale + 0.5 * l2 * (w * w).sum(1)
        grad = total[k : k * (1 + width)].reshape(k, width) * scale[:, None] + l2[:, None] * w
        curve = total[k * (1 + width) :].reshape(k, bends) * scale[:, None]
        if not dense:
            return value, grad, curve + l2[:, None]
        full = np.zeros((k, width, width))
        full[:, upper[0], upper[1]] = curve
        full[:, upper[1], upper[0]] = curve
        return value, grad, full + l2[:, None, None] * np.eye(width)

    def product(self, w: np.ndarray, v: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Each head's Hessian at ``w`` times its row of ``v``."""
        losses = self.losses.only(which)

        def part(batch: pa.RecordBatch, w: np.ndarray, v: np.ndarray) -> np.ndarray:
            x, _, _, bend = losses.rows(batch, w)
            return ((bend * (x @ v.T)).T @ x).ravel()

        total = self._pass(v.size, part, w, v).reshape(v.shape)
        return total * self.scale[which][:, None] + self.l2[which][:, None] * v

    def step(self, w: np.ndarray, grad: np.ndarray, curve: np.ndarray, shift: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The Newton step, or what conjugate gradients have of it; ``shift`` is added to each diagonal."""
        if self.dense:
            damped = curve + shift[:, None, None] * np.eye(self.width)
            tiny = 1e-13 * np.trace(damped, axis1=1, axis2=2) / self.width + 1e-300
            return np.linalg.solve(damped + tiny[:, None, None] * np.eye(self.width), grad[:, :, None])[:, :, 0]
        ease = 1.0 / np.maximum(curve + shift[:, None], 1e-12)
        x, r = np.zeros_like(grad), grad.copy()
        z = ease * r
        v, rz = z.copy(), (r * z).sum(1)
        goal = np.linalg.norm(grad, axis=1) * np.minimum(0.1, np.sqrt(np.linalg.norm(grad, axis=1)))
        for _ in range(PRODUCTS):
            left = np.linalg.norm(r, axis=1) > goal
            if not left.any():
                break
            hv = self.product(w, v, which) + shift[:, None] * v
            along = (v * hv).sum(1)
            a = np.where(left & (along > 0), rz / np.where(along > 0, along, 1.0), 0.0)
            x, r = x + a[:, None] * v, r - a[:, None] * hv
            z = ease * r
            now = (r * z).sum(1)
            v, rz = z + np.where(left & (rz > 0), now / np.where(rz > 0, rz, 1.0), 0.0)[:, None] * v, now
        return x


def minimise(curves: Curves, max_iter: int, tolerance: float = 1e-7) -> np.ndarray:
    """Damped Newton steps for all heads at once; each trial of a step is one pass, and heads at their minimum leave it.

    A step that does not lower the value enough is worked out again from the curvature at hand, with a larger shift.
    """
    n = len(curves.l2)
    w, shift = np.zeros((n, curves.width)), np.zeros(n)
    value, grad, curve = curves.evaluate(w, np.arange(n))
    stuck = np.zeros(n, bool)
    for _ in range(max_iter):
        which = np.flatnonzero((np.abs(grad).max(axis=1) > tolerance) & ~stuck)
        if not len(which):
            break
        step = curves.step(w[which], grad[which], curve[which], shift[which], which)
        slope = (step * grad[which]).sum(1)
        trial = w[which] - step
        f, g, c = curves.evaluate(trial, which)
        good = (slope > 0) & (f <= value[which] - DESCENT * slope + 1e-15 * np.abs(value[which]))
        kept, back = which[good], which[~good]
        w[kept], value[kept], grad[kept], curve[kept] = trial[good], f[good], g[good], c[good]
        shift[kept] = np.where(shift[kept] < 1e-8, 0.0, shift[kept] / 10)
        diagonal = curve[back].diagonal(axis1=1, axis2=2) if curves.dense else curve[back]
        shift[back] = np.maximum(10 * shift[back], 1e-3 * diagonal.max(axis=1) + 1e-12)
        stuck[back] = shift[back] > 1e10 * (1 + diagonal.max(axis=1))
    return w


def fit(
    train: DataFrame, d: int, kinds: list[str], heads: np.ndarray, weights: np.ndarray, l2: np.ndarray, share: np.ndarray, delta: float, max_iter: int
) -> np.ndarray:
    """Weights and bias of each problem of ``Curves``. ``train`` has ``features`` and ``y``, one entry for each head.

    What reaches the driver in a pass is at most ``HESSIAN_VALUES`` curvatures and two values for each weight, added by a shuffle.
    """
    return minimise(Curves(train, d, kinds, heads, weights, l2, share, delta), max_iter)
