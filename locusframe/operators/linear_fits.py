"""Linear models on all variants, solved to their optimum by passes over subjects kept in place.

Each subject's listed inputs are one row of a written table. A pass is one Spark job that returns sums
over subjects; no genotype moves. Work and memory of a task grow with the listed cells, those of the
driver with the number of variants. Unlisted cells are 0.

`fit_lasso` walks down a path of penalties. At each it solves a quadratic model on an active set, the inputs
that the strong rule lets through, and then tests the optimality of every input by a pass; inputs that
fail join the set. `fit_logistic` takes Newton steps whose equations are solved by conjugate gradients,
one pass for each product with the Hessian.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators.subject_training import CHUNK, _added, _SUMS, subject_rows
from locusframe.session import materialise

#: Inputs whose products a pass adds up as one matrix (32 MB); larger active sets are solved by gradient steps.
GRAM = 2048
#: Steps of the path from the smallest penalty that keeps every input out down to the one asked for.
PATH = 8
#: Newton steps and passes that a fit may take before it is reported as not converged.
STEPS, PASSES = 100, 10_000


@dataclass
class Block:
    """Some subjects: their listed cells, covariates and labels."""

    row: np.ndarray
    col: np.ndarray
    value: np.ndarray
    covariates: np.ndarray
    y: np.ndarray

    def times(self, w: np.ndarray, inputs: int) -> np.ndarray:
        """Sums of inputs, intercept and covariates weighed by `w`."""
        z = np.bincount(self.row, self.value * w[self.col], len(self.y)) if len(self.col) else np.zeros(len(self.y))
        return z + w[inputs] + self.covariates @ w[inputs + 1 :]

    def back(self, r: np.ndarray, inputs: int) -> np.ndarray:
        """Sums over the subjects of inputs, intercept and covariates weighed by `r`."""
        g = np.bincount(self.col, self.value * r[self.row], inputs) if len(self.col) else np.zeros(inputs)
        return np.concatenate([g, [r.sum()], self.covariates.T @ r])


@dataclass
class Design:
    """Rows of the training subjects and what all passes share."""

    rows: DataFrame
    inputs: np.ndarray
    covariates: int
    n: int

    @property
    def width(self) -> int:
        return len(self.inputs) + 1 + self.covariates

    def total(self, sums: Callable[[Block], np.ndarray]) -> np.ndarray:
        """`sums(block)` added up over all subjects: one Spark job."""
        shared = self.rows.sparkSession.sparkContext.broadcast(cloudpickle.dumps((self.inputs, sums)))

        def run(batches):
            inputs, each = cloudpickle.loads(shared.value)
            total = None
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                lengths = batch["node"].value_lengths().to_numpy(zero_copy_only=False)
                nodes = batch["node"].flatten().to_numpy()
                at = np.searchsorted(inputs, nodes)
                known = inputs[np.minimum(at, len(inputs) - 1)] == nodes if len(inputs) else np.zeros(len(nodes), bool)
                row = np.repeat(np.arange(batch.num_rows), lengths)[known]
                covariates = batch["covariates"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                block = Block(row, at[known], batch["value"].flatten().to_numpy(zero_copy_only=False)[known], covariates, batch["label"].to_numpy(zero_copy_only=False))
                found = each(block)
                total = found if total is None else total + found
            if total is not None:
                starts = range(0, len(total), CHUNK)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(starts)), pa.int64()), pa.array([total[s : s + CHUNK].tobytes() for s in starts], pa.binary())], names=["chunk", "values"]
                )

        found = self.rows.mapInArrow(run, _SUMS).groupBy("chunk").applyInArrow(_added, _SUMS).toArrow().sort_by("chunk")
        shared.destroy()
        return np.concatenate([np.frombuffer(v, np.float64) for v in found["values"].to_pylist()])


def _design(geno: DataFrame, subjects: DataFrame, covariates: list[str]) -> Design | None:
    """Written rows of the subjects that have a label and all covariates; None without any."""
    whole = subjects.dropna(subset=["label", *covariates])
    rows = subject_rows(geno, whole, covariates)
    n = rows.count()
    if n == 0:
        return None
    variants = geno.select(F.col("variant_id").cast("long").alias("node")).dropna().distinct().sort("node")
    return Design(rows, variants.toArrow()["node"].to_numpy(), len(covariates), n)


def _link(z: np.ndarray) -> np.ndarray:
    return np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), 1 - 1 / (1 + np.exp(-np.abs(z))))


# ---------------------------------------------------------------- lasso


@dataclass
class Scaling:
    """Inputs and covariates as (x - mean) / scale; the intercept stays."""

    mean: np.ndarray
    scale: np.ndarray
    constant: np.ndarray

    def raw(self, w: np.ndarray, intercept: int) -> np.ndarray:
        """Weights on the inputs as they are listed."""
        out = w / self.scale
        out[intercept] -= (out * self.mean).sum()
        return out


def _scaling(design: Design, normalise: bool) -> Scaling:
    p, width = len(design.inputs), design.width

    def sums(block: Block, p=p) -> np.ndarray:
        squares = Block(block.row, block.col, block.value**2, block.covariates**2, block.y)
        one = np.ones(len(block.y))
        return np.concatenate([block.back(one, p), squares.back(one, p)])

    first, second = np.split(design.total(sums) / design.n, 2)
    variance = np.maximum(second - first**2, 0)
    constant = variance <= 1e-12 * np.maximum(second, 1e-300)
    mean, scale = np.zeros(width), np.ones(width)
    if normalise:
        mean, scale = first, np.where(constant, 1.0, np.sqrt(variance))
    mean[p], scale[p], constant[p] = 0.0, 1.0, False
    return Scaling(mean, scale, constant)


def _gradient(design: Design, scaling: Scaling, w: np.ndarray, regression: bool) -> np.ndarray:
    """Gradient of the mean loss by the scaled weights, and the mean loss last: one pass."""
    p, raw = len(design.inputs), scaling.raw(w, len(design.inputs))

    def sums(block: Block, p=p, raw=raw) -> np.ndarray:
        z = block.times(raw, p)
        r = z - block.y if regression else _link(z) - block.y
        loss = (r**2).sum() / 2 if regression else (np.logaddexp(0, z) - block.y * z).sum()
        return np.append(block.back(r, p), loss)

    found = design.total(sums) / design.n
    g = found[:-1]
    return np.append((g - scaling.mean * g[p]) / scaling.scale, found[-1])


def _products(design: Design, scaling: Scaling, w: np.ndarray, kept: np.ndarray, regression: bool) -> np.ndarray:
    """Hessian of the mean loss by the scaled weights in `kept`: one pass."""
    p, raw = len(design.inputs), scaling.raw(w, len(design.inputs))
    place = np.full(design.width, -1)
    place[kept] = np.arange(len(kept))
    mean, scale = scaling.mean[kept], scaling.scale[kept]

    def sums(block: Block, p=p, raw=raw) -> np.ndarray:
        total = np.zeros((len(kept), len(kept)))
        z = block.times(raw, p)
        weight = np.ones(len(z)) if regression else _link(z) * (1 - _link(z))
        here = place[block.col] >= 0
        row, col, value = block.row[here], place[block.col[here]], block.value[here]
        others = np.concatenate([np.ones((len(z), 1)), block.covariates], axis=1)
        wanted = place[p:] >= 0
        for start in range(0, len(z), 1024):
            end = min(start + 1024, len(z))
            inside = (row >= start) & (row < end)
            x = np.zeros((end - start, len(kept)))
            np.add.at(x, (row[inside] - start, col[inside]), value[inside])
            x[:, place[p:][wanted]] = others[start:end, wanted]
            x = (x - mean) / scale
            total += x.T @ (x * weight[start:end, None])
        return total.ravel()

    return design.total(sums).reshape(len(kept), len(kept)) / design.n


def _descend(h: np.ndarray, g: np.ndarray, w: np.ndarray, penalty: np.ndarray, tolerance: float) -> np.ndarray:
    """Minimum of g·(v - w) + (v - w)'h(v - w) / 2 + penalty·|v| by coordinate descent."""
    v, slope = w.copy(), g.copy()
    for _ in range(10_000):
        most = 0.0
        for j in range(len(v)):
            if h[j, j] <= 1e-12:
                continue
            at = v[j] - slope[j] / h[j, j]
            to = np.sign(at) * max(abs(at) - penalty[j] / h[j, j], 0.0)
            if to != v[j]:
                slope += h[:, j] * (to - v[j])
                most = max(most, abs(to - v[j]) * h[j, j])
                v[j] = to
        if most < tolerance:
            break
    return v


def _residual(g: np.ndarray, w: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """How far each weight is from its optimality condition."""
    return np.where(w != 0, np.abs(g + penalty * np.sign(w)), np.maximum(np.abs(g) - penalty, 0.0))


def fit_lasso(
    geno: DataFrame, subjects: DataFrame, l1: float, covariates: list[str] | None = None, regression: bool = False,
    normalise: bool = True, tolerance: float = 1e-9,
) -> DataFrame:
    """(src, w, kkt): weights of the inputs that minimise mean loss + l1 * sum |w|, and each one's optimality residual.

    The loss is half the squared error or the cross-entropy. `subjects` holds subject_id, label and the
    covariates; covariates and the intercept, the row with src null, carry no penalty. With `normalise`, inputs have mean
    0 and variance 1 over the training subjects, and weights are given for inputs so scaled. Rows without a label
    or a covariate are left out; an input without variation has weight 0. No subjects: no rows.
    """
    covs, spark, schema = list(covariates or []), geno.sparkSession, "src long, w double, kkt double"
    design = _design(geno, subjects, covs)
    if design is None:
        return spark.createDataFrame([], schema)
    p, scaling = len(design.inputs), _scaling(design, normalise)
    free = np.arange(p, design.width)
    penalised = np.concatenate([np.ones(p), np.zeros(design.width - p)])
    usable = ~scaling.constant
    w = np.zeros(design.width)

    def solve(w: np.ndarray, active: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Optimum over `active`, and the gradient there of all."""
        step, ahead, pace = 1.0, w, 1.0
        found = _gradient(design, scaling, w, regression)
        for _ in range(PASSES):
            g, loss = found[:-1], found[-1]
            if _residual(g[active], w[active], penalty[active]).max(initial=0.0) < tolerance:
                break
            cost = loss + (penalty * np.abs(w)).sum()
            if len(active) <= GRAM:
                h = _products(design, scaling, w, active, regression)
                move = np.zeros(design.width)
                move[active] = _descend(h, g[active], w[active], penalty[active], tolerance / 10) - w[active]
                fall, size = (g * move).sum() + (penalty * (np.abs(w + move) - np.abs(w))).sum(), 1.0
                while True:
                    tried = _gradient(design, scaling, w + size * move, regression)
                    if tried[-1] + (penalty * np.abs(w + size * move)).sum() <= cost + 0.1 * size * fall + 1e-13 * abs(cost) or size < 1e-8:
                        break
                    size /= 2
                w, found = w + size * move, tried
                continue
            # Accelerated proximal gradient steps, restarted where the cost rises.
            from_ = _gradient(design, scaling, ahead, regression)
            while True:
                to = ahead.copy()
                moved = ahead[active] - from_[:-1][active] * step
                to[active] = np.sign(moved) * np.maximum(np.abs(moved) - penalty[active] * step, 0.0)
                tried, gap = _gradient(design, scaling, to, regression), to - ahead
                if tried[-1] <= from_[-1] + (from_[:-1] * gap).sum() + (gap**2).sum() / (2 * step) + 1e-13 * abs(from_[-1]):
                    break
                step /= 2
            if tried[-1] + (penalty * np.abs(to)).sum() > cost:
                ahead, pace = w, 1.0
                continue
            faster = (1 + (1 + 4 * pace**2) ** 0.5) / 2
            ahead, w, found, pace = to + (pace - 1) / faster * (to - w), to, tried, faster
        return w, found[:-1]

    w, g = solve(w, free[usable[free]], penalised * 0)
    start = float(np.abs(g[:p][usable[:p]]).max(initial=0.0))
    path = np.geomspace(start, l1, PATH + 1)[1:] if 0 < l1 < start else [l1]
    before = max(start, l1)
    for penalty in path:
        weights = penalised * penalty
        # The strong rule: inputs below this are most likely 0 at the next penalty; the test below makes it sure.
        kept = usable & ((w != 0) | (np.abs(g) >= 2 * penalty - before) | (penalised == 0))
        while True:
            w, g = solve(w, np.flatnonzero(kept), weights)
            failed = usable & ~kept & (_residual(g, w, weights) > tolerance)
            if not failed.any():
                break
            kept |= failed
        before = penalty
    residual = np.where(usable, _residual(g, w, penalised * l1), 0.0)
    rows = pa.table({"src": pa.array([*design.inputs.tolist(), None], pa.int64()), "w": w[: p + 1], "kkt": residual[: p + 1]})
    return materialise(spark.createDataFrame(rows, schema))


# ---------------------------------------------------------------- logistic comparator


def fit_logistic(geno: DataFrame, subjects: DataFrame, covariates: list[str] | None = None, tolerance: float = 1e-9) -> DataFrame:
    """(variant_id, coefficient): unpenalised logistic fit with intercept, from the largest coefficient down, nulls last.

    Where a combination of the inputs separates the labels there is no optimum, and every coefficient is null.
    Among dependent inputs the fit is the one that Newton steps from 0 reach. Rows without a label or a covariate
    are left out. No subjects: no rows.
    """
    covs, spark, schema = list(covariates or []), geno.sparkSession, "variant_id long, coefficient double"
    design = _design(geno, subjects, covs)
    if design is None:
        return spark.createDataFrame([], schema)
    p = len(design.inputs)

    def state(w: np.ndarray) -> tuple[np.ndarray, float, float, np.ndarray]:
        """Gradient, loss, number of subjects on the wrong side and diagonal of the Hessian: one pass."""

        def sums(block: Block, p=p, w=w) -> np.ndarray:
            z = block.times(w, p)
            q = _link(z)
            squares = Block(block.row, block.col, block.value**2, block.covariates**2, block.y)
            wrong = (z * (2 * block.y - 1) <= 0).sum()
            return np.concatenate([block.back(q - block.y, p), squares.back(q * (1 - q), p), [(np.logaddexp(0, z) - block.y * z).sum(), wrong]])

        found = design.total(sums)
        width = design.width
        return found[:width] / design.n, found[-2] / design.n, found[-1], found[width : 2 * width] / design.n

    def curved(w: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Product of the Hessian with `v`: one pass."""

        def sums(block: Block, p=p, w=w, v=v) -> np.ndarray:
            q = _link(block.times(w, p))
            return block.back(q * (1 - q) * block.times(v, p), p)

        return design.total(sums) / design.n

    w = np.zeros(design.width)
    g, loss, wrong, diagonal = state(w)
    fitted, last, before = False, 0.0, np.inf
    for _ in range(STEPS):
        if np.abs(g).max() < tolerance:
            if last <= 1e-3 * (1 + np.abs(w).max()) or last < 0.1 * before:
                fitted = True
                break
            if last > 0.5 * before:  # separated but for ties: the gradient fades, the steps stay long
                break
        if wrong == 0:  # a plane separates the labels
            break
        # Conjugate gradients, more exact as the fit comes closer.
        goal = min(0.1, np.linalg.norm(g) ** 0.5) * np.linalg.norm(g)
        scale = 1 / np.maximum(diagonal, 1e-12 * diagonal.max())
        move, r = np.zeros_like(w), -g
        s = scale * r
        d, rs = s, r @ s
        for _ in range(2 * design.width):
            hd = curved(w, d)
            bend = d @ hd
            if bend <= 1e-14 * (d @ d) * diagonal.max():
                break
            move, r = move + rs / bend * d, r - rs / bend * hd
            if np.linalg.norm(r) <= goal:
                break
            s = scale * r
            d, rs = s + (r @ s) / rs * d, r @ s
        part = 1.0
        while True:
            tried = state(w + part * move)
            if tried[1] <= loss + 1e-4 * part * (g @ move) + 1e-13 or part < 1e-8:
                break
            part /= 2
        w, last, before = w + part * move, part * np.abs(move).max() or np.inf, last or np.inf
        g, loss, wrong, diagonal = tried
    values = w[:p] if fitted else np.full(p, np.nan)
    rows = pa.table({"variant_id": design.inputs, "coefficient": pa.array(values, pa.float64(), mask=np.isnan(values))})
    return materialise(spark.createDataFrame(rows, schema)).orderBy(F.desc_nulls_last("coefficient"), "variant_id")
