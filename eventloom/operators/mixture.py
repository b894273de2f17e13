"""Gaussian mixtures by expectation and maximisation, many at once: an iteration of all models is one pass over the vectors.

A task computes responsibilities of its rows for every model that still moves (log-sum-exp
over the parts) and adds up what the next parameters need: mass, sums and squares of each
part, and the log likelihood. The driver turns these sums into parameters; it never sees a
row. A model stops when its mean log likelihood rises by less than a tolerance. Covariances
are diagonal or full; a part whose full covariance isn't positive definite gets ten times
the regularisation, and again, up to REGULAR times. Restarts begin at different rows, drawn by
hash, and go through some rounds of k-means; the one with the largest likelihood is kept.

Vectors are of one length; null vectors, and vectors with null or non-finite components,
take no part (their posteriors are null).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import seeded
from .partials import matrix, summed

TOLERANCE, STEPS, REGULAR, LLOYD = 1e-3, 300, 4, 6


@dataclass(frozen=True)
class Mixture:
    """k parts: weights, means (k, d), and variances (k, d) or covariances (k, d, d)."""

    kind: str
    weights: np.ndarray
    means: np.ndarray
    spread: np.ndarray
    regular: float = 1e-6
    log_likelihood: float = -math.inf
    steps: int = 0

    @property
    def parameters(self) -> int:
        k, d = self.means.shape
        return k * d + k * (d if self.kind == "diag" else d * (d + 1) // 2) + k - 1

    def bic(self, n: int) -> float:
        return -2 * self.log_likelihood + self.parameters * math.log(n)

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density of each part."""
        k, d = self.means.shape
        out = np.empty((len(x), k))
        for j in range(k):
            z = x - self.means[j]
            if self.kind == "diag":
                out[:, j] = -0.5 * ((z * z / self.spread[j]).sum(axis=1) + np.log(self.spread[j]).sum())
            else:
                low = np.linalg.cholesky(self.spread[j])
                y = np.linalg.solve(low, z.T)
                out[:, j] = -0.5 * (y * y).sum(axis=0) - np.log(np.diag(low)).sum()
        with np.errstate(divide="ignore"):
            return out + np.log(self.weights) - 0.5 * d * math.log(2 * math.pi)

    def posteriors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(responsibilities, log likelihood of each row)."""
        e = self.log_parts(x)
        top = e.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(e - top).sum(axis=1))
        return np.exp(e - total[:, None]), total

    def sums(self, x: np.ndarray, hard: bool = False) -> np.ndarray:
        """Log likelihood, mass, sums and squares; squares are about the present means, which loses no digits. ``hard``: a row belongs to the nearest mean."""
        if hard:
            far = (self.means * self.means).sum(axis=1) - 2 * x @ self.means.T
            r, total = (far.argmin(axis=1)[:, None] == np.arange(len(self.means))).astype(float), np.zeros(1)
        else:
            r, total = self.posteriors(x)
        squares = []
        for j in range(len(self.weights)):
            z = x - self.means[j]
            squares.append(r[:, j] @ (z * z) if self.kind == "diag" else ((z * r[:, j, None]).T @ z).ravel())
        return np.concatenate([[total.sum()], r.sum(axis=0), (r.T @ x).ravel(), *squares])

    def moved(self, s: np.ndarray) -> Mixture:
        """The next parameters from the sums; the likelihood is that of the present ones."""
        k, d = self.means.shape
        mass = s[1 : 1 + k] + 10 * np.finfo(float).eps
        means = s[1 + k : 1 + k + k * d].reshape(k, d) / mass[:, None]
        gap = means - self.means
        rest = s[1 + k + k * d :]
        if self.kind == "diag":
            spread = np.maximum(rest.reshape(k, d) / mass[:, None] - gap * gap, 0) + self.regular
            regular = self.regular
        else:
            raw = rest.reshape(k, d, d) / mass[:, None, None] - gap[:, :, None] * gap[:, None, :]
            regular = self.regular
            for _ in range(REGULAR):
                spread = raw + regular * np.eye(d)
                if all(np.linalg.eigvalsh(c)[0] > 0 for c in spread):
                    break
                regular *= 10
        return replace(self, weights=mass / mass.sum(), means=means, spread=spread, regular=regular, log_likelihood=float(s[0]), steps=self.steps + 1)


def usable(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def begun(df: DataFrame, sizes: Sequence[int], kind: str, restarts: int, seed: int, v: str) -> tuple[int, dict[tuple[int, int], Mixture]]:
    """(rows, models by size and restart): parts at rows drawn by hash, with the spread of the whole table."""
    def one(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        x = matrix(b.column(0))
        yield 0, np.concatenate([[len(x)], x.sum(axis=0)])

    first = summed(df.select(v), one).get(0)
    if first is None:
        return 0, {}
    n, mean = int(first[0]), first[1:] / first[0]

    def two(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        z = matrix(b.column(0)) - mean
        yield 0, (z * z).sum(axis=0) if kind == "diag" else (z.T @ z).ravel()

    d = len(mean)
    spread = summed(df.select(v), two)[0] / n
    spread = spread + 1e-6 if kind == "diag" else spread.reshape(d, d) + 1e-6 * np.eye(d)
    most = max(sizes)
    out = {}
    for r in range(restarts):
        order = seeded(seed + r, F.concat_ws(",", F.transform(v, lambda x: x.cast("string"))))
        rows = [np.array(x[0]) for x in df.select(v, order.alias("h")).distinct().orderBy("h").limit(most).select(v).collect()]
        for k in sizes:
            at = np.array([rows[j % len(rows)] for j in range(k)])
            out[k, r] = Mixture(kind, np.full(k, 1 / k), at, np.repeat(spread[None], k, axis=0))
    for _ in range(LLOYD):  # means of the nearest rows, as k-means has them
        now = list(enumerate(out.items()))

        def near(b: pa.RecordBatch, now: list = now) -> Iterator[tuple[int, np.ndarray]]:
            x = matrix(b.column(0))
            for j, (_, m) in now:
                yield j, m.sums(x, hard=True)

        for j, s in summed(df.select(v), near).items():
            key, m = now[j][1]
            new, some = m.moved(s), s[1 : 1 + key[0], None] > 0.5  # a part without rows stays where it is
            new = replace(new, log_likelihood=-math.inf, steps=0, regular=m.regular, means=np.where(some, new.means, m.means))
            out[key] = replace(new, spread=np.where(some if kind == "diag" else some[..., None], new.spread, m.spread))
    return n, out


def fitted(df: DataFrame, sizes: Sequence[int], kind: str = "diag", restarts: int = 1, seed: int = 1, v: str = "v", steps: int = STEPS, tolerance: float = TOLERANCE, start: dict | None = None) -> tuple[int, dict[int, Mixture], list[dict]]:
    """(rows, the best model of each size, mean log likelihoods of each iteration). ``df`` is read once an iteration: it should be a table."""
    df = df.where(usable(F.col(v)))
    n, models = begun(df, sizes, kind, restarts, seed, v)
    models = {**models, **(start or {})}
    live, trace = set(models), []
    while live:
        now = [(j, models[key]) for j, key in enumerate(sorted(live))]

        def one(b: pa.RecordBatch, now: list = now) -> Iterator[tuple[int, np.ndarray]]:
            x = matrix(b.column(0))
            for j, m in now:
                yield j, m.sums(x)

        sums = summed(df.select(v), one)
        trace.append({})
        for j, key in enumerate(sorted(live)):
            old, new = models[key], models[key].moved(sums[j])
            trace[-1][key] = new.log_likelihood / n
            if new.log_likelihood - old.log_likelihood < tolerance * n or new.steps >= steps:
                models[key] = replace(old, log_likelihood=new.log_likelihood, steps=new.steps)  # what the likelihood is of
                live.discard(key)
            else:
                models[key] = new
    best = {}
    for (k, _), m in sorted(models.items()):
        if k not in best or m.log_likelihood > best[k].log_likelihood:
            best[k] = m
    return n, best, trace


def criteria(df: DataFrame, sizes: Sequence[int], kind: str = "diag", restarts: int = 3, seed: int = 1, v: str = "v") -> DataFrame:
    """(k, log_likelihood, parameters, bic, regular, best)."""
    n, models, _ = fitted(df, sizes, kind, restarts, seed, v)
    rows = [(k, m.log_likelihood, m.parameters, m.bic(n), m.regular) for k, m in models.items()]
    least = min((r[3] for r in rows), default=None)
    return df.sparkSession.createDataFrame([(*r, r[3] == least) for r in rows], "k int, log_likelihood double, parameters long, bic double, regular double, best boolean")


def posteriors(df: DataFrame, m: Mixture, v: str = "v") -> DataFrame:
    """Adds ``u``, each part's probability, and ``winner``; null where the vector takes no part."""
    kept = [c for c in df.columns if c not in ("u", "winner")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema), "u array<double>, winner int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            u: list = [None] * b.num_rows
            win: list = [None] * b.num_rows
            if ok.any():
                at = np.flatnonzero(ok)
                r, _ = m.posteriors(matrix(b.column(b.num_columns - 2).take(pa.array(at))))
                for i, row in zip(at, r, strict=True):
                    u[i], win[i] = row.tolist(), int(row.argmax())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns - 2)), pa.array(u, pa.list_(pa.float64())), pa.array(win, pa.int32())], [*kept, "u", "winner"])

    return df.select(*kept, F.col(v).alias("mixture_v__"), usable(F.col(v)).alias("mixture_ok__")).mapInArrow(run, schema)
