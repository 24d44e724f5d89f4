"""Many logistic regressions fitted together: all strengths of the penalty on all folds, in the same passes over the rows.

Rows are packed once into blocks of numbers. A pass takes the weights of all models to the tasks, and each task returns one
row: the sums of losses and gradients over its blocks, for all models. The driver holds the weights only and moves every
model by its own L-BFGS step, so the number of passes is that of the slowest model and not the sum over the models.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.session import cut_lineage, shuffle_width

#: Numbers of one packed block, and of the class scores that a task holds at a time.
BLOCK_NUMBERS = 1 << 19
SCORES = 1 << 21
#: Weights that go to the tasks at once, 8 bytes each; more models are fitted in several rounds.
MAX_WEIGHTS = 1 << 23
#: Bytes of the tasks' sums that come to the driver directly; above it they are added up in between.
DIRECT_BYTES = 64 << 20
MEMORY = 10
ARMIJO = 1e-4
GRADIENT = 1e-6
IMPROVEMENT = 1e-10


@dataclass
class Fits:
    """weights[fold, draw]: classes x (features + 1), the intercept last, for features scaled by the fold's training rows."""

    weights: np.ndarray
    gradients: np.ndarray
    losses: np.ndarray
    means: np.ndarray
    scales: np.ndarray
    passes: int


def pack(df: DataFrame, features: str = "features", label: str = "label", fold: str = "fold") -> DataFrame:
    """(rows, x, y, f): blocks of rows as numbers, written to the shared folder."""
    kind = df.schema[features].dataType.typeName()
    values = F.col(features) if kind == "array" else vector_to_array(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            width = len(flat) // batch.num_rows
            x = flat.reshape(batch.num_rows, width)
            y, f = (batch.column(i).to_numpy(zero_copy_only=False).astype("<i4") for i in (1, 2))
            step = max(1, BLOCK_NUMBERS // max(1, width))
            for a in range(0, len(x), step):
                part = slice(a, a + step)
                yield pa.RecordBatch.from_arrays([
                    pa.array([len(x[part])], pa.int32()), pa.array([x[part].astype("<f8").tobytes()], pa.binary()),
                    pa.array([y[part].tobytes()], pa.binary()), pa.array([f[part].tobytes()], pa.binary())], ["rows", "x", "y", "f"])

    chosen = df.select(values.cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"), F.col(fold).cast("int").alias("f"))
    return cut_lineage(chosen.mapInArrow(run, "rows int, x binary, y binary, f binary"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            n, x, y, f = (batch.column(c)[i] for c in range(4))
            yield (np.frombuffer(x.as_buffer(), "<f8").reshape(n.as_py(), -1), np.frombuffer(y.as_buffer(), "<i4"),
                   np.frombuffer(f.as_buffer(), "<i4"))


def _sum(blocks: DataFrame, one, numbers: int) -> np.ndarray:
    """The sum of `one(x, y, f)` over all blocks: one row from each task, added up in groups of tasks where there are many."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(numbers)
        for x, y, f in _blocks(batches):
            total += one(x, y, f)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()),
                                          pa.array([total.tobytes()], pa.binary())], ["part", "total"])

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total = sum(np.frombuffer(x.as_buffer()) for x in table.column("total"))
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "total": pa.array([total.tobytes()], pa.binary())})

    sums = blocks.mapInArrow(run, "part int, total binary")
    # Files of one pass are read by at most so many tasks.
    tasks = max(len(blocks.inputFiles()), shuffle_width(blocks.sparkSession))
    if tasks * numbers * 8 > DIRECT_BYTES:
        sums = sums.groupBy(F.pmod("part", F.lit(int(np.ceil(np.sqrt(tasks)))))).applyInArrow(join, "part int, total binary")
    rows = sorted(sums.collect(), key=lambda r: r.part)
    return sum((np.frombuffer(r.total) for r in rows), np.zeros(numbers))


def _moments(blocks: DataFrame, folds: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training rows of each fold, and mean and population deviation of the features over them."""
    def first(x, y, f):
        out = np.zeros((folds, 1 + width))
        for i in range(folds):
            own = x[f == i] if folds > 1 else x
            out[i, 0], out[i, 1:] = len(own), own.sum(axis=0)
        return out.ravel()

    sums = _sum(blocks, first, folds * (1 + width)).reshape(folds, 1 + width)
    train = sums.sum(axis=0) - sums if folds > 1 else sums
    means = train[:, 1:] / np.maximum(train[:, :1], 1)

    def second(x, y, f):
        out = np.zeros((folds, width))
        for i in range(folds):
            out[i] = ((x[f != i if folds > 1 else slice(None)] - means[i]) ** 2).sum(axis=0)
        return out.ravel()

    spread = np.sqrt(_sum(blocks, second, folds * width).reshape(folds, width) / np.maximum(train[:, :1], 1))
    return train[:, 0], means, spread


def _scores(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """rows x models x classes."""
    return np.einsum("nd,mkd->nmk", x, weights[:, :, :-1], optimize=True) + weights[:, :, -1]


def _evaluate(blocks: DataFrame, weights: np.ndarray, fold: np.ndarray, means: np.ndarray, scales: np.ndarray, single: bool):
    """Summed losses and gradients of the models `weights` (model x class x feature), each over the rows outside its fold
    (`single`: over all rows)."""
    models, classes, width = weights.shape
    shared = blocks.sparkSession.sparkContext.broadcast((weights, fold, means, scales))

    def one(x, y, f):
        weights, fold, means, scales = shared.value
        loss, gradient = np.zeros(models), np.zeros(weights.shape)
        for i in np.unique(fold):
            own = np.flatnonzero(fold == i)
            rows = np.flatnonzero(f != i) if not single else np.arange(len(x))
            step = max(1, SCORES // (len(own) * classes))
            for a in range(0, len(rows), step):
                part = rows[a:a + step]
                scaled = (x[part] - means[i]) * scales[i]
                z = _scores(scaled, weights[own])
                z -= z.max(axis=2, keepdims=True)
                true = np.take_along_axis(z, y[part][:, None, None].astype(np.int64), axis=2)[:, :, 0]
                np.exp(z, out=z)
                total = z.sum(axis=2)
                loss[own] += (np.log(total) - true).sum(axis=0)
                z /= total[:, :, None]
                z[np.arange(len(part))[:, None], np.arange(len(own))[None, :], y[part][:, None]] -= 1
                gradient[own, :, :-1] += np.einsum("nmk,nd->mkd", z, scaled, optimize=True)
                gradient[own, :, -1] += z.sum(axis=0)
        return np.concatenate((loss, gradient.ravel()))

    out = _sum(blocks, one, models * (1 + classes * width))
    shared.unpersist()
    return out[:models], out[models:].reshape(weights.shape)


class _Path:
    """One model on its way down, by L-BFGS with halved steps."""

    def __init__(self, size: int) -> None:
        self.x, self.trial = np.zeros(size), np.zeros(size)
        self.f, self.g = np.inf, np.zeros(size)
        self.step, self.way = 1.0, np.zeros(size)
        self.pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
        self.moves, self.done = 0, False

    def take(self, f: float, g: np.ndarray, most: int) -> None:
        """The value and gradient at `trial`."""
        if np.isfinite(self.f) and f > self.f + ARMIJO * self.step * (self.g @ self.way):
            self.step /= 2
            self.done = self.step < 1e-12
        else:
            s, y, gain = self.trial - self.x, g - self.g, self.f - f
            if self.moves and s @ y > 1e-12:
                self.pairs = [*self.pairs[1 - MEMORY:], (s, y, 1 / (s @ y))]
            self.x, self.f, self.g = self.trial, f, g
            self.moves += 1
            self.done = self.moves > most or np.abs(g).max() <= GRADIENT or gain <= IMPROVEMENT * max(1.0, abs(f))
            self.way, self.step = self._direction(), 1.0
            if not self.pairs:
                self.step = min(1.0, 1 / max(1e-12, np.linalg.norm(g)))
        self.trial = self.x + self.step * self.way

    def _direction(self) -> np.ndarray:
        q, kept = self.g.copy(), []
        for s, y, r in reversed(self.pairs):
            a = r * (s @ q)
            q -= a * y
            kept.append(a)
        if self.pairs:
            s, y, r = self.pairs[-1]
            q /= r * (y @ y)
        for (s, y, r), a in zip(self.pairs, reversed(kept)):
            q += (a - r * (y @ q)) * s
        return -q


def fit_many(blocks: DataFrame, classes: int, strengths: Sequence[float], folds: int = 1, max_iter: int = 100) -> Fits:
    """Multinomial models on z-scored features (population deviation), one for each fold's other rows and each strength of the
    L2 penalty: mean loss + strength / 2 * sum of squares of all weights but the intercepts. With one fold, on all rows.

    An empty table, or features without spread, give weights of zero."""
    first = blocks.select("x", "rows").head()
    width = len(first.x) // 8 // first.rows if first else 0
    counts, means, spread = _moments(blocks, folds, width)
    scales = np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 0)
    shape = (classes, width + 1)
    at_once = max(1, MAX_WEIGHTS // (folds * classes * (width + 1)))
    weights, gradients = (np.zeros((folds, len(strengths), *shape)) for _ in range(2))
    losses, passes = np.zeros((folds, len(strengths))), 0
    for begin in range(0, len(strengths), at_once):
        own = [(i, d) for i in range(folds) for d in range(begin, min(len(strengths), begin + at_once))]
        paths = [_Path(classes * (width + 1)) for _ in own]
        while active := [m for m, p in enumerate(paths) if not p.done]:
            trial = np.stack([paths[m].trial.reshape(shape) for m in active])
            loss, gradient = _evaluate(blocks, trial, np.array([own[m][0] for m in active]), means, scales, folds == 1)
            passes += 1
            for j, m in enumerate(active):
                i, d = own[m]
                free = trial[j].copy()
                free[:, -1] = 0
                n = max(counts[i], 1)
                paths[m].take(loss[j] / n + strengths[d] / 2 * (free ** 2).sum(), (gradient[j] / n + strengths[d] * free).ravel(), max_iter)
        for (i, d), p in zip(own, paths):
            weights[i, d], gradients[i, d], losses[i, d] = p.x.reshape(shape), p.g.reshape(shape), p.f
    return Fits(weights, gradients, losses, means, scales, passes)


def fold_accuracies(blocks: DataFrame, fits: Fits) -> np.ndarray:
    """fold x draw: the share of the fold's own rows that its models label rightly (the first class on ties), in one pass."""
    folds, draws = fits.weights.shape[:2]
    shared = blocks.sparkSession.sparkContext.broadcast(fits)

    def one(x, y, f):
        fits, out = shared.value, np.zeros((folds, draws + 1))
        for i in range(folds):
            rows = np.flatnonzero(f == i)
            step = max(1, SCORES // (draws * fits.weights.shape[2]))
            for a in range(0, len(rows), step):
                part = rows[a:a + step]
                z = _scores((x[part] - fits.means[i]) * fits.scales[i], fits.weights[i])
                out[i, :draws] += (z.argmax(axis=2) == y[part][:, None]).sum(axis=0)
                out[i, draws] += len(part)
        return out.ravel()

    out = _sum(blocks, one, folds * (draws + 1)).reshape(folds, draws + 1)
    shared.unpersist()
    return np.divide(out[:, :draws], out[:, draws:], out=np.full((folds, draws), np.nan), where=out[:, draws:] > 0)


def gradient_at(blocks: DataFrame, weights: np.ndarray, strength: float) -> np.ndarray:
    """The gradient of the objective over all rows, for features that are already scaled, at weights (class x feature)."""
    width = weights.shape[1] - 1
    _, gradient = _evaluate(blocks, weights[None], np.zeros(1, np.int64), np.zeros((1, width)), np.ones((1, width)), True)
    rows = blocks.agg(F.sum("rows")).head()[0] or 1
    free = weights.copy()
    free[:, -1] = 0
    return gradient[0] / rows + strength * free
