"""Principal spaces of vectors: one fit, sliced to every number of axes.

With DENSE columns or fewer the second moments are summed whole. With more, nothing of
the square of the columns is made anywhere: a pass over the vectors sums Xᵀ(XQ) for a
narrow block Q, the blocks span a Krylov space, and its Ritz vectors are the axes; the
space is begun anew from these until their residuals are small. The driver holds
columns times the width of the space.

Vectors are of one length; null ones, and those with null or non-finite components, take
no part. Each axis has its largest component positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixture import usable
from .partials import matrix, summed

DENSE = 1024
#: Blocks of a Krylov space, columns of a block beyond the axes wanted, restarts, residual over the largest eigenvalue.
BLOCKS, BESIDE, RESTARTS, RESIDUAL = 6, 8, 40, 1e-10


@dataclass(frozen=True)
class Space:
    """n rows, their mean, axes (columns, largest variance first), variances of these and of all."""

    n: int
    mean: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    total: float

    def shares(self) -> np.ndarray:
        return self.variances / self.total if self.total > 0 else np.zeros(len(self.variances))


def fitted(df: DataFrame, k: int | None = None, v: str = "v") -> Space | None:
    """The first k axes (all, if none is given); None without vectors. ``df`` should be a table, as it is read some times."""
    x = df.where(usable(F.col(v))).select(v)

    def one(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        m = matrix(b.column(0))
        yield 0, np.concatenate([[len(m)], m.sum(axis=0)])

    first = summed(x, one).get(0)
    if first is None:
        return None
    n, mean = int(first[0]), first[1:] / first[0]
    d = len(mean)
    k = d if k is None else min(k, d)
    if d <= DENSE:

        def two(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            z = matrix(b.column(0)) - mean
            yield 0, (z.T @ z).ravel()

        values, axes = np.linalg.eigh(summed(x, two)[0].reshape(d, d) / n)
        values, axes, total = values[::-1][:k], axes[:, ::-1][:, :k], float(values.sum())
    else:
        values, axes, total = _krylov(x, mean, n, k)
    sign = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return Space(n, mean, axes * np.where(sign == 0, 1, sign), np.maximum(values, 0), total)


def _krylov(x: DataFrame, mean: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    d = len(mean)
    width = min(d, k + BESIDE)

    def applied(q: np.ndarray) -> tuple[np.ndarray, float]:
        """(covariance times q, trace)."""

        def one(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            z = matrix(b.column(0)) - mean
            yield 0, np.concatenate([[(z * z).sum()], (z.T @ (z @ q)).ravel()])

        s = summed(x, one)[0] / n
        return s[1:].reshape(d, q.shape[1]), float(s[0])

    start = np.linalg.qr(np.random.default_rng(1).standard_normal((d, width)))[0]
    for _ in range(RESTARTS):
        basis, image = start, None
        block = start
        for _ in range(BLOCKS):
            y, total = applied(block)
            image = y if image is None else np.concatenate([image, y], axis=1)
            new = y - basis @ (basis.T @ y)
            new -= basis @ (basis.T @ new)
            u, s, _ = np.linalg.svd(new, full_matrices=False)
            block = u[:, s > 1e-12 * max(total, 1e-300)]
            if not block.shape[1] or image.shape[1] < basis.shape[1] or basis.shape[1] + block.shape[1] > d:
                break
            basis = np.concatenate([basis, block], axis=1)
        basis = basis[:, : image.shape[1]]
        t = basis.T @ image
        values, w = np.linalg.eigh((t + t.T) / 2)
        values, w = values[::-1], w[:, ::-1]
        ritz = basis @ w[:, :width]
        off = np.linalg.norm(image @ w[:, :k] - ritz[:, :k] * values[:k], axis=0)
        if (off <= RESIDUAL * max(values[0], 1e-300)).all():
            break
        start = np.linalg.qr(ritz)[0]
    return values[:k], ritz[:, :k], total


def projected(df: DataFrame, space: Space, k: int | None = None, keep: tuple[str, ...] = ("id",), v: str = "v") -> DataFrame:
    """(keep, z): coordinates along the first k axes; null where the vector takes no part."""
    axes, mean = space.axes[:, : k or space.axes.shape[1]], space.mean
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema), "z array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.flatnonzero(b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool))
            z: list = [None] * b.num_rows
            if len(ok):
                for i, row in zip(ok, (matrix(b.column(b.num_columns - 2).take(pa.array(ok))) - mean) @ axes, strict=True):
                    z[i] = row.tolist()
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(len(keep))), pa.array(z, pa.list_(pa.float64()))], [*keep, "z"])

    return df.select(*keep, F.col(v).cast("array<double>").alias("space_v__"), usable(F.col(v)).alias("space_ok__")).mapInArrow(run, schema)


def explained(df: DataFrame, k: int, v: str = "v") -> DataFrame:
    """(component, share) of the variance."""
    s = fitted(df, k, v)
    rows = [] if s is None else [(i + 1, float(x)) for i, x in enumerate(s.shares())]
    return df.sparkSession.createDataFrame(rows, "component int, share double")
