"""Logistic fits of many trials and folds in the same passes over the data.

A pass takes current coefficients of all (fold, trial) problems to the executors and
returns gradients, Hessians and losses: a few numbers per problem, whatever the number of rows. The
driver takes proximal Newton steps. So a study of 100 trials by 5 folds costs about ten
passes, not hundreds of fits. Rows with equal features, label and fold are counted once first.

Sums do not depend on the partitioning: the counted rows are dealt to buckets by their hash, sorted and packed,
a bucket is summed as a whole, and bucket sums are added in the order of a fixed tree. So a fit from other
partitions gives equal bits, and the driver receives at most ``FAN`` arrays, however many tasks there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderframe.functions.shipping import by_value
from cinderframe.operators.probability import CUTOFFS
from cinderframe.operators.sampling import stratified_folds
from cinderframe.session import written

by_value(__name__)

ROWS = 4096
MOST_BUCKETS = 4096
FAN = 32
SALTS = 4


@dataclass
class Problems:
    """Coefficients (with intercept first) of every fold and trial, on raw features."""

    fold: np.ndarray
    weight: np.ndarray  # of the negative and of the positive class
    beta: np.ndarray


def _packed(width: int):
    """One row per bucket from rows sorted by bucket: its matrix of features, label, fold and count."""

    def run(batches):
        import pyarrow as pa

        def done():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.concatenate(held).tobytes()], pa.binary())], ["bucket", "rows"])

        at, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column(0).to_numpy()
            matrix = np.stack([batch.column(1 + k).to_numpy().astype(np.float64) for k in range(width)], 1)
            cuts = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):
                if bucket[a] != at:
                    if at is not None:
                        yield done()
                    at, held = int(bucket[a]), []
                held.append(matrix[a:b])
        if at is not None:
            yield done()

    return run


@dataclass(frozen=True)
class Packed:
    """A written table with a row per bucket, and how many buckets there may be."""

    table: DataFrame
    buckets: int


def count_equal(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of ``columns`` with their number of rows ``n_rows``, as a written table.

    Studies of many fits take their rows from one such table: its size follows the distinct rows.
    """
    return written(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")), "equal-rows")


def count_in_folds(
    rows: DataFrame, names: Sequence[str], label: str, key: Column, ids: Sequence[Column], *, folds: int, tasks: int | None = None
) -> DataFrame:
    """Distinct values of the features ``names``, ``label`` and ``fold`` with their number of rows ``n_rows``, as a written table.

    Folds are those of ``sampling.stratified_folds`` by ``ids``, which are computed from the one column that ``key`` makes of a row, named ``__key``.
    Their shuffle holds every row. Where features repeat, a row goes through it with a hash in place of its features: the distinct features are counted
    first, and a hash that two of them share is not used. Where less than seven rows of eight repeat others, or every hash is shared, rows keep their features.
    """
    names = list(names)
    for salt in range(SALTS):
        code = F.xxhash64(F.lit(salt), *names, *[F.col(n).isNull() for n in names]).alias("__code")
        seen = written(rows.groupBy(code, *names).agg(F.count(F.lit(1)).alias("__n")), "distinct-rows")
        distinct, codes, total = seen.agg(F.count(F.lit(1)), F.countDistinct("__code"), F.coalesce(F.sum("__n"), F.lit(0))).first()
        if distinct * 8 > total:
            break
        if distinct == codes:
            folded = stratified_folds(rows.select(key.alias("__key"), label, code), label, ids, k=folds, tasks=tasks)
            counted = folded.groupBy("__code", label, "fold").agg(F.count(F.lit(1)).alias("n_rows"))
            return written(counted.join(seen.drop("__n"), "__code").select(*names, label, "fold", "n_rows"), "equal-rows")
    return count_equal(stratified_folds(rows.select(key.alias("__key"), label, *names), label, ids, k=folds, tasks=tasks), [*names, label, "fold"])


def pack(folded: DataFrame, features: Sequence[str], label: str, count: str | None = None) -> Packed:
    """The counted rows of ``folded`` (features, label, ``fold``) as a written table of buckets.

    A row of ``folded`` stands for ``count`` equal ones. The number of buckets follows from the number of distinct rows alone, at most ``MOST_BUCKETS``.
    """
    features = list(features)
    values = [F.col(f).cast("double").alias(f) for f in features]
    counted = written(folded.groupBy(*values, F.col(label).cast("int").alias("__y"), "fold").agg((F.sum(count) if count else F.count(F.lit(1))).alias("__n")), "counted")
    columns = [*features, "__y", "fold", "__n"]
    buckets = min(max(-(-counted.count() // ROWS), 1), MOST_BUCKETS)
    dealt = counted.withColumn("__bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets))).repartition("__bucket")
    ordered = dealt.sortWithinPartitions("__bucket", *columns).select("__bucket", *columns)
    return Packed(written(ordered.mapInArrow(_packed(len(columns)), "bucket long, rows binary"), "buckets"), buckets)


def _arrays(rows: bytes, width: int):
    matrix = np.frombuffer(rows, np.float64).reshape(-1, width + 3)
    for at in range(0, len(matrix), ROWS):
        part = matrix[at : at + ROWS]
        yield np.column_stack([np.ones(len(part)), part[:, :width]]), part[:, width].astype(np.int64), part[:, width + 1].astype(np.int64), part[:, width + 2]


def _added(batches):
    """Sum of the arrays of each group, in the order of their buckets; input sorted by group and bucket."""
    import pyarrow as pa

    at, total = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["bucket", "sums"])

    for batch in batches:
        for group, sums in zip(batch.column(0).to_pylist(), batch.column(2)):
            part = np.frombuffer(sums.as_py())
            if group != at:
                if at is not None:
                    yield done()
                at, total = group, part.copy()
            else:
                total += part
    if at is not None:
        yield done()


def _summed(packed: Packed, task, shape: int, width: int) -> np.ndarray:
    """Sum over buckets of the one array that ``task`` makes of a bucket's rows, by a tree of ``FAN`` branches a node."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for bucket, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums = np.ascontiguousarray(task(_arrays(rows.as_py(), width)), np.float64).ravel().tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([sums], pa.binary())], ["bucket", "sums"])

    sums, buckets = packed.table.mapInArrow(run, "bucket long, sums binary"), packed.buckets
    while buckets > FAN:
        group = F.floor(F.col("bucket") / FAN).alias("group")
        sums = sums.select(group, "bucket", "sums").repartition("group").sortWithinPartitions("group", "bucket").mapInArrow(_added, "bucket long, sums binary")
        buckets = -(-buckets // FAN)
    total = np.zeros(shape)
    for part in sorted(sums.collect(), key=lambda r: r["bucket"]):  # at most FAN arrays
        total += np.frombuffer(part["sums"])
    return total


def _class_moments(width, folds):
    def task(parts):
        out = np.zeros((folds, 2, 1 + 2 * width))
        for x, y, fold, n in parts:
            for k in range(folds):
                for c in (0, 1):
                    mine = (fold == k) & (y == c)
                    w = n[mine, None]
                    out[k, c] += np.concatenate([[w.sum()], (w * x[mine]).sum(0), (w * x[mine] ** 2).sum(0)])
        return out

    return task


def _newton_moments(problems: Problems):
    beta, fold_of, weight = problems.beta, problems.fold, problems.weight
    width = beta.shape[1]
    a, b = np.triu_indices(width)

    def task(parts):
        slope, curve, loss = np.zeros_like(beta), np.zeros((len(beta), len(a))), np.zeros(len(beta))
        for x, y, fold, n in parts:
            for k in np.unique(fold):
                rows, active = fold == k, np.flatnonzero(fold_of != k)
                own, target = x[rows], y[rows, None]
                eta = own @ beta[active].T
                small = np.exp(-np.abs(eta))
                p = np.where(eta >= 0, 1.0, small) / (1.0 + small)
                w = np.where(target == 1, weight[active, 1], weight[active, 0]) * n[rows, None]
                loss[active] += (w * (np.log1p(small) + np.maximum(eta, 0) - target * eta)).sum(0)
                slope[active] += (w * (p - target)).T @ own
                curve[active] += (w * p * (1 - p)).T @ (own[:, a] * own[:, b])
        return np.concatenate([slope.ravel(), curve.ravel(), loss])

    return task


def _held_out_counts(problems: Problems):
    beta, fold_of = problems.beta, problems.fold
    edges = np.array(CUTOFFS)

    def task(parts):
        out = np.zeros((len(beta), len(edges) + 1, 2))
        for x, y, fold, n in parts:
            for k in np.unique(fold):
                rows, active = fold == k, np.flatnonzero(fold_of == k)
                p = 1.0 / (1.0 + np.exp(-np.clip(x[rows] @ beta[active].T, -700, 700)))
                bucket = (p[:, :, None] >= edges).sum(2)
                for i, problem in enumerate(active):
                    for c in (0, 1):
                        mine = y[rows] == c
                        out[problem, :, c] += np.bincount(bucket[mine, i], n[rows][mine], len(edges) + 1)
        return out

    return task


def _proximal_step(beta, slope, curve, l1, l2, sweeps: int = 200):
    """The minimum of the quadratic model plus penalties, for all problems at once; the intercept is free.

    Without an L1 part it is one linear system each. Else coordinate descent, from the system's solution, finds the
    coefficients that stay and their signs, and their own system the values, where it keeps the signs: descent alone creeps along near
    collinear features.
    """
    ridge = np.broadcast_to(l2[:, None] * (np.arange(beta.shape[1]) > 0), beta.shape)
    system = curve + (ridge + 1e-12)[:, :, None] * np.eye(beta.shape[1])
    step = np.linalg.solve(system, -(slope + ridge * beta)[:, :, None])[:, :, 0]
    bent = np.flatnonzero(l1 > 0)
    if len(bent):
        near = _descended(step[bent], beta[bent], slope[bent], curve[bent], l1[bent], l2[bent], sweeps)
        sign = np.sign(beta[bent] + near)
        sign[:, 0] = 0
        stays = sign != 0
        stays[:, 0] = True
        eye = np.eye(beta.shape[1])
        own = np.where(stays[:, :, None], system[bent], eye)
        wanted = np.where(stays, -(slope + ridge * beta)[bent] - l1[bent, None] * sign, -beta[bent])
        solved = np.linalg.solve(own, wanted[:, :, None])[:, :, 0]
        solved = np.where(stays, solved, -beta[bent])
        same = (np.sign(beta[bent] + solved) == sign)[:, 1:].all(1)
        step[bent] = np.where(same[:, None], solved, near)
    return step


def _descended(step, beta, slope, curve, l1, l2, sweeps):
    for _ in range(sweeps):
        before = step.copy()
        for i in range(beta.shape[1]):
            h = curve[:, i, i] + (l2 if i else 0.0) + 1e-12
            rest = slope[:, i] + np.einsum("pj,pj->p", curve[:, i], step) - curve[:, i, i] * step[:, i]
            if i:
                want = (curve[:, i, i] * beta[:, i] - rest) / h
                step[:, i] = np.sign(want) * np.maximum(np.abs(want) - l1 / h, 0) - beta[:, i]
            else:
                step[:, 0] = -rest / h
        if np.abs(step - before).max() < 1e-10:
            break
    return step


@dataclass
class Solution:
    """Coefficients (intercept first) per problem, on standardised and on raw features, with the numbers behind them.

    ``slope`` is the gradient of the mean weighted loss at ``beta``; ``l1`` and ``l2`` are the penalties on that scale, ``whole``
    the total weight.
    """

    raw: Problems
    beta: np.ndarray
    slope: np.ndarray
    l1: np.ndarray
    l2: np.ndarray
    whole: np.ndarray
    mean: np.ndarray
    sd: np.ndarray

    def residual(self) -> np.ndarray:
        """Distance of the penalised gradient from zero, per problem and coefficient; zero everywhere proves the optimum."""
        l1, l2 = self.l1[:, None], self.l2[:, None]
        at = self.slope[:, 1:] + l2 * self.beta[:, 1:]
        inner = np.where(self.beta[:, 1:] != 0, np.abs(at + l1 * np.sign(self.beta[:, 1:])), np.maximum(np.abs(at) - l1, 0))
        return np.concatenate([np.abs(self.slope[:, :1]), inner], 1)


def solve(packed: Packed, width: int, folds: int, fold_of: np.ndarray, recipes: Sequence, rounds: int, tolerance: float) -> Solution:
    """Proximal Newton fits of all problems; a problem trains on the folds other than its own (-1: on all)."""
    full_width = width + 1
    sums = _summed(packed, _class_moments(full_width, folds), folds * 2 * (1 + 2 * full_width), width).reshape(folds, 2, -1)
    train = np.stack([sums.sum(0) - (sums[k] if k >= 0 else 0.0) for k in fold_of])
    n, total = train[:, :, 0], train.sum(1)
    mean = total[:, 2 : full_width + 1] / np.maximum(total[:, :1], 1)
    sd = np.sqrt(np.maximum(total[:, full_width + 2 :] / np.maximum(total[:, :1], 1) - mean**2, 0))
    sd[sd < 1e-12] = 1.0
    weight = np.ones((len(recipes), 2))
    for i, t in enumerate(recipes):
        if t.class_weight == "balanced":
            weight[i] = n[i].sum() / (2 * np.maximum(n[i], 1))
        elif t.class_weight == "custom":
            weight[i, 1] = t.positive_weight
    whole = (weight * n).sum(1)
    strength = 1.0 / (np.array([t.C for t in recipes]) * whole)
    shares = np.array([t.elastic_net for t in recipes])
    l1, l2 = strength * shares, strength * (1 - shares)
    # Standardised features are affine in the raw ones: turn takes coefficients back.
    turn = np.zeros((len(recipes), full_width, full_width))
    turn[:, 0, 0] = 1
    turn[:, 0, 1:] = -mean / sd
    turn[:, np.arange(1, full_width), np.arange(1, full_width)] = 1 / sd
    a, b = np.triu_indices(full_width)
    beta = np.zeros((len(recipes), full_width))
    last, last_value = beta.copy(), np.full(len(recipes), np.inf)
    for _ in range(rounds):
        raw = Problems(fold_of, weight, np.einsum("pij,pj->pi", turn, beta))
        flat = _summed(packed, _newton_moments(raw), len(recipes) * (full_width + len(a) + 1), width)
        slope, curve, loss = np.split(flat, np.cumsum([len(recipes) * full_width, len(recipes) * len(a)]))
        full = np.zeros((len(recipes), full_width, full_width))
        full[:, a, b] = full[:, b, a] = curve.reshape(len(recipes), -1)
        slope = np.einsum("pji,pj->pi", turn, slope.reshape(-1, full_width)) / whole[:, None]
        full = np.einsum("pji,pjk,pkl->pil", turn, full, turn) / whole[:, None, None]
        value = loss / whole + l1 * np.abs(beta[:, 1:]).sum(1) + l2 / 2 * (beta[:, 1:] ** 2).sum(1)
        worse = value > last_value + 1e-12
        step = _proximal_step(beta, slope, full, l1, l2)
        following = np.where(worse[:, None], (beta + last) / 2, beta + step)
        if np.abs(following - beta).max() < tolerance:
            break
        last, last_value = np.where(worse[:, None], last, beta), np.where(worse, last_value, value)
        beta = following
    return Solution(raw, beta, slope, l1, l2, whole, mean, sd)


def search(folded: DataFrame, features: Sequence[str], trials: Sequence, *, folds: int = 5, label: str = "ignited", count: str | None = None, rounds: int = 40, tolerance: float = 1e-6) -> list[float]:
    """Mean best-F1 over folds of every trial (``learning.Recipe``), in the order of ``trials``; a row stands for ``count`` equal ones."""
    packed, width = pack(folded, features, label, count), len(features)
    fold_of = np.repeat(np.arange(folds), len(trials))
    solution = solve(packed, width, folds, fold_of, [t for _ in range(folds) for t in trials], rounds, tolerance)
    shape = (len(fold_of), len(CUTOFFS) + 1, 2)
    counts = _summed(packed, _held_out_counts(solution.raw), int(np.prod(shape)), width).reshape(shape)
    reached = counts[:, ::-1].cumsum(1)[:, ::-1][:, 1:]  # rows at or above each cutoff
    positives = counts[:, :, 1].sum(1, keepdims=True)
    found, called = reached[:, :, 1], reached.sum(2)
    f1 = np.where(positives + called > 0, 2 * found / np.maximum(positives + called, 1), 0.0).max(1)
    return f1.reshape(folds, len(trials)).mean(0).tolist()


def fit(df: DataFrame, features: Sequence[str], recipes: Sequence, *, label: str = "ignited", count: str | None = None, rounds: int = 80, tolerance: float = 1e-10) -> Solution:
    """Fits of every recipe on all rows, in the same passes; a row stands for ``count`` equal ones."""
    packed = pack(df.withColumn("fold", F.lit(0)), features, label, count)
    return solve(packed, len(features), 1, np.full(len(recipes), -1), list(recipes), rounds, tolerance)
