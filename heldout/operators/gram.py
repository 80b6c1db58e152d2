"""One-pass linear models: additive moments, small solves, row products.

A fit needs only n, sums and cross products of its rows.  Those are summed in
Arrow batches per task, then per key and block of features; the driver puts a
key's blocks together to solve.  Train sizes, folds, doses and penalties are combinations of
such blocks, so no candidate ever rescans the fit rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heldout.functions.checks import EvaluationError

SCALE_FLOOR = 1e-12
FLUSH_GROUPS = 20_000
BLOCK = 512  # features of one side of a block of the Gram matrix
FAN_IN = 64  # upstream tasks whose sums one task adds first
FLUSH_VALUES = 24 << 20  # sums that a task holds before it sends them on


@dataclass
class Moments:
    """Sums of shifted features and of targets; ``shift`` is subtracted from every row."""

    n: float
    sx: np.ndarray
    sy: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    shift: np.ndarray

    def __add__(self, o: Moments) -> Moments:
        return Moments(self.n + o.n, self.sx + o.sx, self.sy + o.sy, self.xx + o.xx, self.xy + o.xy, self.shift)

    def __sub__(self, o: Moments) -> Moments:
        return Moments(self.n - o.n, self.sx - o.sx, self.sy - o.sy, self.xx - o.xx, self.xy - o.xy, self.shift)

    @property
    def mean(self) -> np.ndarray:
        return self.sx / self.n

    @property
    def scale(self) -> np.ndarray:
        var = np.diag(self.xx) / self.n - self.mean**2
        s = np.sqrt(np.maximum(var, 0.0))
        return np.where(np.isfinite(s) & (s >= SCALE_FLOOR), s, 1.0)

    def standardized(self) -> tuple[np.ndarray, np.ndarray]:
        """Gram matrix and target products of the standardised features."""
        s = self.scale
        zz = (self.xx - self.n * np.outer(self.mean, self.mean)) / np.outer(s, s)
        zy = (self.xy - np.outer(self.mean, self.sy)) / s[:, None]
        return zz, zy

    def raw(self, coef: np.ndarray, scale: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Weights and intercept for unshifted rows from standardised coefficients."""
        w = coef / (self.scale if scale is None else scale)[:, None]
        return w, self.sy / self.n - (self.mean + self.shift) @ w


Model = tuple[np.ndarray, np.ndarray]


def ridge(m: Moments, alpha: float) -> Model:
    """Intercept ridge on standardised features."""
    zz, zy = m.standardized()
    return m.raw(np.linalg.solve(zz + alpha * np.eye(len(zz)), zy))


def plain_ridge(m: Moments, alpha: float) -> Model:
    """Intercept ridge on centred, unscaled features."""
    ones = np.ones(len(m.sx))
    xx = m.xx - m.n * np.outer(m.mean, m.mean)
    xy = m.xy - np.outer(m.mean, m.sy)
    return m.raw(np.linalg.solve(xx + alpha * np.eye(len(xx)), xy), ones)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def _emit(total: dict, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The sums of each key as rows, few long ones or many short ones to a batch."""
    part, values = [], 0
    for key, row in total.items():
        if part and (len(part) == 256 or values + len(row) > 1 << 20):
            yield _sums_batch(part, total, names)
            part, values = [], 0
        part.append(key)
        values += len(row)
    if part:
        yield _sums_batch(part, total, names)


def _sums_batch(keys: list, total: dict, names: Sequence[str]) -> pa.RecordBatch:
    columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(len(names))]
    edges = np.concatenate(([0], np.cumsum([len(total[k]) for k in keys])))
    columns.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate([total[k] for k in keys]))))
    return pa.RecordBatch.from_arrays(columns, names=[*names, "stats"])


def sum_arrays(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Elementwise sum of ``stats`` per key, in two levels.

    The rows that ``FAN_IN`` neighbouring upstream tasks made for a key are
    summed first, then those sums, so no task gets a block from every task
    upstream.  Keys may have arrays of different lengths.
    """
    names = list(keys)

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            stats = batch.column("stats")
            edges, values = stats.offsets.to_numpy(), stats.values.to_numpy(zero_copy_only=False)
            for i, key in enumerate(zip(*[batch.column(k).to_pylist() for k in names])):
                row = values[edges[i] : edges[i + 1]]
                if key in total:
                    total[key] += row
                else:
                    total[key] = row.copy()
        yield from _emit(total, names)

    schema = ", ".join(f"{k} string" for k in names) + ", stats array<double>"
    salted = df.select(*names, "stats", F.expr(f"spark_partition_id() div {FAN_IN}").alias("_salt"))
    return salted.repartition(*names, "_salt").mapInArrow(run, schema).repartition(*names).mapInArrow(run, schema)


def feature_shift(df: DataFrame, x: str = "features") -> np.ndarray:
    """Mean of a few rows, subtracted everywhere to avoid cancellation (any constant is valid).

    They are the rows with the smallest hashes of all, in that order, so the shift does not depend on partitioning.
    """
    rows = [r[0] for r in df.select(x, F.xxhash64(x).alias("_h")).orderBy("_h").limit(200).collect()]
    if not rows:
        raise EvaluationError("no feature rows")
    return np.asarray(rows, float).mean(0)


def moment_sums(df: DataFrame, key: str, y: str, *, x: str = "features", weight: str | None = None, shift: np.ndarray, block: int = BLOCK) -> DataFrame:
    """``(key, part, stats)``: sums of every key, the cross products of features in blocks.

    Part ``s`` holds n, the sums of features and targets, and their products;
    part ``i:j`` (i <= j) the products of feature blocks i and j.  A block's
    sums from all tasks meet in one task, which never sees another's, so no row
    and no adding task grows with the square of the features.
    """
    k = len(shift)
    edges = list(range(0, k, block))

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        held = 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            a, b = _matrix(batch.column("x"), n) - shift, _matrix(batch.column("y"), n)
            w = batch.column("w").to_numpy(zero_copy_only=False)
            labels = np.asarray(batch.column("key").to_pylist(), dtype=object)
            for label in set(labels):
                pick = labels == label
                ax, by, ww = a[pick], b[pick], w[pick]
                aw = ax * ww[:, None]
                rows = {"s": np.concatenate([[ww.sum()], aw.sum(0), ww @ by, (aw.T @ by).ravel()])}
                for i, lo in enumerate(edges):
                    for j, at in enumerate(edges[i:], i):
                        rows[f"{i}:{j}"] = (ax[:, lo : lo + block].T @ aw[:, at : at + block]).ravel()
                for part, row in rows.items():
                    if (label, part) in total:
                        total[label, part] += row
                    else:
                        total[label, part] = row
                        held += len(row)
            if held > FLUSH_VALUES:
                yield from _emit(total, ["key", "part"])
                total, held = {}, 0
        yield from _emit(total, ["key", "part"])

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(x).alias("x"), F.col(y).alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    return sum_arrays(rows.mapInArrow(run, "key string, part string, stats array<double>"), ["key", "part"])


def moments(df: DataFrame, key: str, y: str, *, x: str = "features", weight: str | None = None, shift: np.ndarray | None = None, block: int = BLOCK) -> dict[str, Moments]:
    """Moments per value of the string column ``key``; the number of keys is small.

    The driver puts the blocks together, as it solves for the coefficients.
    """
    shift = feature_shift(df, x) if shift is None else shift
    k = len(shift)
    parts: dict[str, dict[str, np.ndarray]] = {}
    for r in moment_sums(df, key, y, x=x, weight=weight, shift=shift, block=block).toLocalIterator():
        parts.setdefault(r.key, {})[r.part] = np.asarray(r.stats, float)
    out = {}
    for name, found in parts.items():
        sums = found.pop("s")
        t = (len(sums) - 1 - k) // (k + 1)
        n, sx, sy, xy = np.split(sums, np.cumsum([1, k, t]))
        xx = np.empty((k, k))
        for place, flat in found.items():
            i, j = (int(v) * block for v in place.split(":"))
            piece = flat.reshape(min(block, k - i), -1)
            xx[i : i + block, j : j + block] = piece
            xx[j : j + block, i : i + block] = piece.T
        out[name] = Moments(float(n[0]), sx, sy, xx, xy.reshape(k, t), shift)
    return out


def group_sums(df: DataFrame, key: str, group: str, y: str, *, x: str = "features", weight: str | None = None, shift: np.ndarray) -> DataFrame:
    """``(key, group, stats)`` with ``[n, sum y, sum x, sum x y']`` per group, summed in the tasks first."""

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            a, b = _matrix(batch.column("x"), n) - shift, _matrix(batch.column("y"), n)
            row = np.concatenate([np.ones((n, 1)), b, a, (a[:, :, None] * b[:, None, :]).reshape(n, -1)], axis=1)
            row *= batch.column("w").to_numpy(zero_copy_only=False)[:, None]
            pairs = list(zip(batch.column("key").to_pylist(), batch.column("grp").to_pylist()))
            order: dict[tuple, int] = {}
            code = np.fromiter((order.setdefault(p, len(order)) for p in pairs), int, n)
            acc = np.zeros((len(order), row.shape[1]))
            np.add.at(acc, code, row)
            for p, i in order.items():
                total[p] = total[p] + acc[i] if p in total else acc[i]
            if len(total) > FLUSH_GROUPS:
                yield from _emit(total, ["key", "grp"])
                total = {}
        yield from _emit(total, ["key", "grp"])

    w = (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w")
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(group).cast("string").alias("grp"), F.col(x).alias("x"), F.col(y).alias("y"), w)
    return sum_arrays(rows.mapInArrow(run, "key string, grp string, stats array<double>"), ["key", "grp"])


def unpack_group(stats: np.ndarray, k: int, t: int):
    """n (g,), sum y (g, t), sum x (g, k), sum x y' (g, k, t) of stacked group rows."""
    return stats[:, 0], stats[:, 1:1 + t], stats[:, 1 + t:1 + t + k], stats[:, 1 + t + k:].reshape(len(stats), k, t)


def fold_groups(groups: DataFrame, fold: Callable[[str, np.ndarray], np.ndarray]) -> dict[str, np.ndarray]:
    """Sum over groups of ``fold(key, stacked stats)`` per key; the result per key is a small vector."""

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            block = _matrix(batch.column("stats"), batch.num_rows)
            labels = np.asarray(batch.column("key").to_pylist(), dtype=object)
            for label in set(labels):
                row = fold(label, block[labels == label])
                total[(label,)] = total[(label,)] + row if (label,) in total else row
        yield from _emit(total, ["key"])

    rows = sum_arrays(groups.select("key", "stats").mapInArrow(run, "key string, stats array<double>"), ["key"]).collect()
    return {r.key: np.asarray(r.stats, float) for r in rows}


def append_predictions(df: DataFrame, models: dict[str, Model], key: str, *, x: str = "features", out: str = "prediction", keep_x: bool = False) -> DataFrame:
    """``out``: the outputs of the row's model as an array; the feature column is dropped by default."""
    keep = [c for c in df.columns if keep_x or c != x]
    kind = T.ArrayType(T.DoubleType())
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, kind)])

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            a = _matrix(batch.column(x), n)
            labels = np.asarray([str(v) for v in batch.column(key).to_pylist()], dtype=object)
            values: list = [None] * n
            for label in set(labels):
                pick = np.flatnonzero(labels == label)
                w, b = models[label]
                for i, row in zip(pick, a[pick] @ w + b):
                    values[i] = row
            columns = [batch.column(c) for c in keep] + [pa.array(values, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, out])

    return df.mapInArrow(run, schema)


def stack(models: Sequence[Model]) -> Model:
    """Several models of the same features as one wide model."""
    return np.concatenate([w for w, _ in models], axis=1), np.concatenate([b for _, b in models])


def validation_errors(df: DataFrame, models: dict[str, Model], key: str, *, y: str, offset: str, targets: int, x: str = "features", scale: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Mean absolute error per key of each stacked candidate, one scan for all candidates.

    ``offset`` is an array column added to the predictions: empty, one value per
    target, or one value per candidate and target.
    """

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            a, truth, off = (_matrix(batch.column(c), n) for c in ("x", "y", "o"))
            labels = np.asarray(batch.column("key").to_pylist(), dtype=object)
            for label in set(labels):
                pick = labels == label
                w, b = models[label]
                p = (a[pick] @ w + b).reshape(pick.sum(), -1, targets)
                if off.shape[1]:
                    p = p + off[pick].reshape(pick.sum(), -1, targets)
                e = np.abs(p - truth[pick][:, None, :])
                if scale is not None:
                    e = e / scale
                row = np.concatenate([[pick.sum()], e.mean(2).sum(0)])
                total[(label,)] = total[(label,)] + row if (label,) in total else row
        yield from _emit(total, ["key"])

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(offset).alias("o"))
    sums = sum_arrays(rows.mapInArrow(run, "key string, stats array<double>"), ["key"]).collect()
    return {r.key: np.asarray(r.stats[1:], float) / r.stats[0] for r in sums}


# ---- directions and penalties on the moments -------------------------------------------------


def _leading(gram: np.ndarray) -> np.ndarray:
    """Eigenvectors of a Gram matrix by falling eigenvalue, numerically zero ones dropped."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    if not len(values) or values[0] < 1e-24:
        return np.empty((len(gram), 0))
    return vectors[:, values > len(gram) * np.finfo(float).eps * values[0] * 10]


def centroid_gram(groups: DataFrame, m: dict[str, Moments], k: int, t: int) -> dict[str, np.ndarray]:
    """Sum over groups of n_g times the outer product of the standardised group centroid."""
    means = {key: (v.mean, v.scale) for key, v in m.items()}

    def fold(key, stats):
        n, _, sx, _ = unpack_group(stats, k, t)
        mu, s = means[key]
        z = (sx - n[:, None] * mu) / s / np.sqrt(n)[:, None]
        return (z.T @ z).ravel()

    return {key: v.reshape(k, k) for key, v in fold_groups(groups, fold).items()}


def nuisance_gram(groups: DataFrame, m: dict[str, Moments], k: int, t: int) -> dict[str, np.ndarray]:
    """(Z'G)(Z'G)'/n for scaled, centred group indicators G."""
    facts = {key: (v.mean, v.scale, v.n) for key, v in m.items()}

    def fold(key, stats):
        n, _, sx, _ = unpack_group(stats, k, t)
        mu, s, total = facts[key]
        share = n / total
        sd = np.sqrt(share * (1 - share))
        sd[sd < SCALE_FLOOR] = 1.0
        z = (sx - n[:, None] * mu) / s / sd[:, None]
        return (z.T @ z).ravel() / total

    return {key: v.reshape(k, k) for key, v in fold_groups(groups, fold).items()}


def conditional_ridge(m: Moments, alpha: float, penalty: float, nuisance: np.ndarray) -> Model:
    """Ridge with an added penalty on group-linked covariance."""
    zz, zy = m.standardized()
    return m.raw(np.linalg.solve(zz + alpha * np.eye(len(zz)) + penalty * nuisance, zy))


def response_preserving_directions(m: Moments, centroids: np.ndarray) -> np.ndarray:
    """Group-centroid directions orthogonal to the target covariance."""
    _, zy = m.standardized()
    u, s, _ = np.linalg.svd(zy, full_matrices=False)
    keep = u[:, s > max(zy.shape) * np.finfo(float).eps * s[0]] if len(s) and s[0] >= 1e-12 else np.empty((len(zy), 0))
    p = np.eye(len(zy)) - keep @ keep.T
    return _leading(p @ centroids @ p)


def identity_directions(centroids: np.ndarray) -> np.ndarray:
    return _leading(centroids)


def pca_directions(m: Moments) -> np.ndarray:
    values, vectors = np.linalg.eigh(m.standardized()[0])
    return vectors[:, ::-1][:, : int(min(m.n - 1, len(values)))]


def random_directions(k: int, rank: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(k, rank)), mode="reduced")[0]


def projected_ridge(m: Moments, directions: np.ndarray, alpha: float) -> Model:
    """Standardise, remove the directions, standardise again, ridge: all on the Gram matrix."""
    zz, zy = m.standardized()
    p = np.eye(len(zz)) - directions @ directions.T
    gz, gy = p @ zz @ p, p @ zy
    s = np.sqrt(np.maximum(np.diag(gz) / m.n, 0.0))
    s = np.where(s >= SCALE_FLOOR, s, 1.0)
    coef = np.linalg.solve(gz / np.outer(s, s) + alpha * np.eye(len(gz)), gy / s[:, None]) / s[:, None]
    return m.raw(p @ coef)


def project_features(df: DataFrame, m: Moments, directions: np.ndarray, *, x: str = "features") -> DataFrame:
    """Standardised features with the directions removed, row by row."""
    p = (np.eye(len(m.sx)) - directions @ directions.T) / m.scale[:, None]
    model = (p, -(m.mean + m.shift) @ p)
    keyed = df.withColumn("_all", F.lit("all"))
    out = append_predictions(keyed, {"all": model}, "_all", x=x, out="_projected")
    return out.drop("_all").withColumnRenamed("_projected", x)
