"""Logistic models, many at once: all fits of a table take one pass over it for each Newton step.

A fit (:class:`Fit`) names its training and test rows, target, columns and penalty; nested
folds, arms, penalties, targets and permuted copies are rows of one list of fits. The
table is packed once: numbers, levels, targets, and one bit for each different set of
rows. What a training set's transforms learn (medians, means, scales, principal axes)
comes from grouped passes over all training sets together. A step's tasks sum, for every
fit that hasn't settled, loss, gradient and Hessian over their rows; the sums are added
fit by fit in Spark, and the driver solves systems of as many unknowns as a fit has
columns. A step that doesn't lower a fit's loss is halved. Nothing of the table's length
leaves the tasks.

The objective is C times the sum of weighted losses plus half the squared coefficients,
intercepts free, as scikit-learn has it; more than two classes are a softmax. Numbers are
imputed by the training median and scaled by the population sd (1 where that is 0), a
column without values in training counts for nothing, levels are one-hot, and a level
that training lacks has a coefficient of 0. ``axes`` turns some numeric columns, imputed
and scaled, into so many principal components of the training rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dropped, written
from . import partials
from .ranks import quantiles

#: Not to be used as inputs.
FORBIDDEN = ("y", "fold", "clip", "call_id", "target")
#: Levels of a category at most: columns of a fit are unknowns that the driver solves for.
LEVELS = 1000
STEPS, HALVINGS, TOLERANCE = 100, 40, 1e-10


@dataclass(frozen=True)
class Fit:
    """One model: ``train`` and ``test`` are boolean columns (null is false), ``y`` a column of whole numbers from 0; rows with a null y don't train."""

    name: str
    train: str
    test: str
    y: str
    numeric: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    c: float = 1.0
    balanced: bool = False
    axes: tuple[tuple[str, ...], int] | None = None
    classes: int = 2

    def __post_init__(self) -> None:
        own = (*self.numeric, *self.categories, *(self.axes[0] if self.axes else ()))
        if bad := [c for c in own if c in FORBIDDEN]:
            raise ValueError(f"not to be used as inputs: {bad}")


@dataclass
class Transform:
    """What one training set taught: of each numeric column, median, mean and scale (None: no value)."""

    median: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    #: Rows of each class, by target.
    counts: dict[str, np.ndarray] = field(default_factory=dict)

    def applied(self, x: np.ndarray, columns: Sequence[int]) -> np.ndarray:
        z = x[:, columns]
        m = self.median[columns]
        z = (np.where(np.isnan(z), m, z) - self.mean[columns]) / self.scale[columns]
        return np.where(np.isnan(m), 0.0, z)


class Packed:
    """The table as arrays, and what the columns of the arrays are."""

    def __init__(self, df: DataFrame, fits: Sequence[Fit], keep: Sequence[str]):
        if len({f.name for f in fits}) < len(fits):
            raise ValueError("fits must have names of their own")
        self.numeric = list(dict.fromkeys(c for f in fits for c in (*f.numeric, *(f.axes[0] if f.axes else ()))))
        self.categories = list(dict.fromkeys(c for f in fits for c in f.categories))
        self.targets = list(dict.fromkeys(f.y for f in fits))
        self.sets = list(dict.fromkeys(s for f in fits for s in (f.train, f.test)))
        self.keep = list(keep)
        levels = {}
        if self.categories:
            each = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("level")) for c in self.categories))).alias("x")
            rows = df.select(each).select("x.*").where("level is not null").distinct().limit(LEVELS * len(self.categories) + 1).collect()
            for c in self.categories:
                levels[c] = sorted(r.level for r in rows if r.name == c)
                if len(levels[c]) > LEVELS:
                    raise ValueError(f"{c} has more than {LEVELS} levels")
        self.levels = levels
        at = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, levels[c])), F.col(c).cast("string")), F.lit(0)).cast("int") if levels[c] else F.lit(0)
        array = lambda cells, kind: (F.array(*cells) if cells else F.array()).cast(f"array<{kind}>")
        packed = df.select(
            array([F.col(c).cast("double") for c in self.numeric], "double").alias("x"),
            array([at(c) for c in self.categories], "int").alias("levels"),
            array([F.coalesce(F.col(c).cast("int"), F.lit(-1)) for c in self.targets], "int").alias("y"),
            array([F.coalesce(F.col(c), F.lit(False)) for c in self.sets], "boolean").alias("sets"),
            *(F.col(c).alias(f"keep{k}") for k, c in enumerate(keep)),
        )
        self.table = written(packed, "newton-rows")


@dataclass
class Block:
    """Rows of a batch as arrays."""

    x: np.ndarray
    levels: np.ndarray
    y: np.ndarray
    sets: np.ndarray

    @staticmethod
    def of(b: pa.RecordBatch) -> Block:
        def cells(k: int, kind: type, null: object = None) -> np.ndarray:
            flat = b.column(k).flatten()
            flat = flat.fill_null(null) if null is not None else flat
            return flat.to_numpy(zero_copy_only=False).astype(kind).reshape(b.num_rows, -1)

        return Block(cells(0, np.float64, float("nan")), cells(1, np.int64), cells(2, np.int64), cells(3, bool))


def _summed(packed: Packed, one: Callable[[Block], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    return partials.summed(packed.table.select("x", "levels", "y", "sets"), lambda b: one(Block.of(b)))


def _transforms(packed: Packed, fits: Sequence[Fit]) -> dict[str, Transform]:
    """Of each training set, in three passes over all of them."""
    trains = list(dict.fromkeys(f.train for f in fits))
    slot = {s: packed.sets.index(s) for s in trains}
    d = len(packed.numeric)
    median = {s: np.full(d, np.nan) for s in trains}
    if d:
        member = F.filter(F.array(*(F.when(F.col("sets")[slot[s]], F.lit(k)) for k, s in enumerate(trains))), lambda k: k.isNotNull())
        long = packed.table.select(F.explode(member).alias("s"), "x").select("s", F.posexplode("x").alias("j", "x")).where("x is not null and not isnan(x)")
        for r in quantiles(long, ["s", "j"], "x", {"m": 0.5}).collect():  # a row a set and column
            median[trains[r.s]][r.j] = r.m
    size = {f.y: max(g.classes for g in fits if g.y == f.y) for f in fits}

    targets = packed.targets

    def moments(b: Block) -> Iterator[tuple[int, np.ndarray]]:
        for k, s in enumerate(trains):
            own = b.sets[:, slot[s]]
            z = np.where(np.isnan(b.x[own]), median[s], b.x[own]) - median[s]
            counts = [np.bincount(y[y >= 0], minlength=size[t])[: size[t]] for t, y in zip(targets, b.y[own].T, strict=True)]
            yield k, np.concatenate([[own.sum()], z.sum(axis=0), (z * z).sum(axis=0), *counts])

    sums = _summed(packed, moments)
    out = {}
    for k, s in enumerate(trains):
        v = sums.get(k, np.zeros(1 + 2 * d + sum(size.values())))
        n = max(v[0], 1)
        shift = v[1 : 1 + d] / n
        sd = np.sqrt(np.maximum(0, v[1 + d : 1 + 2 * d] / n - shift**2))
        out[s] = Transform(median[s], median[s] + shift, np.where(sd > 1e-12 * (1 + np.abs(median[s])), sd, 1.0))
        at = 1 + 2 * d
        for t in packed.targets:
            out[s].counts[t] = v[at : at + size[t]]
            at += size[t]
    return out


class Inputs:
    """The columns of one fit: intercept, scaled numbers, components, levels."""

    def __init__(self, packed: Packed, fit: Fit, transform: Transform):
        self.numbers = [packed.numeric.index(c) for c in fit.numeric]
        self.block = [packed.numeric.index(c) for c in fit.axes[0]] if fit.axes else []
        self.categories = [(packed.categories.index(c), len(packed.levels[c])) for c in fit.categories]
        self.train, self.test, self.y = packed.sets.index(fit.train), packed.sets.index(fit.test), packed.targets.index(fit.y)
        self.transform, self.classes, self.axes = transform, fit.classes, None
        self.counts = transform.counts[fit.y][: fit.classes]
        self.weights = self.counts.sum() / (np.count_nonzero(self.counts) * np.maximum(self.counts, 1)) if fit.balanced else None
        self.names = ["", *fit.numeric, *(f"axis {k + 1}" for k in range(fit.axes[1] if fit.axes else 0))]
        self.names += [f"{c}={x}" for c in fit.categories for x in packed.levels[c]]

    def matrix(self, b: Block, rows: np.ndarray) -> np.ndarray:
        x = b.x[rows]
        parts = [np.ones((len(x), 1)), self.transform.applied(x, self.numbers)]
        if self.axes is not None:
            parts.append(self.transform.applied(x, self.block) @ self.axes)
        for k, n in self.categories:
            parts.append((b.levels[rows, k][:, None] == np.arange(1, n + 1)[None, :]).astype(float))
        return np.concatenate(parts, axis=1)


def probabilities(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of each class; w has a column for each class but, with two classes, for the second alone."""
    e = z @ w
    if e.shape[1] == 1:
        p = 1 / (1 + np.exp(-np.clip(e, -700, 700)))
        return np.concatenate([1 - p, p], axis=1)
    e = np.exp(e - e.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def step_sums(z: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and upper Hessian of the weighted losses, one after another."""
    k = w.shape[1]
    if k == 1:
        e = (z @ w)[:, 0]
        loss = np.logaddexp(0, e) - y * e
        p = 1 / (1 + np.exp(-np.clip(e, -700, 700)))
        g = z.T @ (weight * (p - y))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z
    else:
        e = z @ w
        e -= e.max(axis=1, keepdims=True)
        total = np.log(np.exp(e).sum(axis=1))
        loss = total - e[np.arange(len(y)), y]
        p = np.exp(e - total[:, None])
        hot = (y[:, None] == np.arange(k)[None, :]).astype(float)
        g = (z.T @ (weight[:, None] * (p - hot))).T.ravel()
        d = z.shape[1]
        h = np.zeros((k * d, k * d))
        for a in range(k):
            for b in range(a, k):
                h[a * d : (a + 1) * d, b * d : (b + 1) * d] = (z * (weight * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ z
    return np.concatenate([[(weight * loss).sum()], g, h[np.triu_indices(len(h))]])


class State:
    """Where the solver is with one fit: w has a row a class; the first unknown of each class is its intercept."""

    def __init__(self, d: int, classes: int, c: float):
        self.k, self.d, self.c = (1 if classes == 2 else classes), d, c
        self.w = np.zeros(self.k * d)
        self.free = np.arange(self.k * d) % d == 0
        self.best: tuple[float, np.ndarray, np.ndarray] | None = None
        self.halvings, self.steps, self.done = 0, 0, False

    def columns(self) -> np.ndarray:
        return self.w.reshape(self.k, self.d).T

    def advance(self, sums: np.ndarray) -> None:
        n = self.k * self.d
        penal = np.where(self.free, 0.0, self.w)
        loss = self.c * sums[0] + 0.5 * penal @ penal
        if self.best is not None and loss > self.best[0] + 1e-12 * abs(self.best[0]):
            self.halvings += 1
            self.done = self.halvings > HALVINGS
            self.w = self.best[1] if self.done else self.best[1] + 0.5**self.halvings * self.best[2]
            return
        g = self.c * sums[1 : 1 + n] + penal
        h = np.zeros((n, n))
        h[np.triu_indices(n)] = self.c * sums[1 + n :]
        h = h + np.triu(h, 1).T + np.diag(np.where(self.free, 0.0, 1.0))
        try:
            if self.k > 1:
                raise np.linalg.LinAlgError  # adding one number to all intercepts changes nothing
            step = -np.linalg.solve(h, g)
        except np.linalg.LinAlgError:
            step = -np.linalg.lstsq(h, g, rcond=1e-12)[0]
        self.halvings, self.steps = 0, self.steps + 1
        self.done = bool(np.abs(g).max() <= TOLERANCE * max(1.0, self.c) or -g @ step <= 1e-18 * max(1.0, abs(loss)) or self.steps >= STEPS)
        self.best = (loss, self.w, step)
        self.w = self.w + step if not self.done else self.w


@dataclass
class Fitted:
    """Solved fits, ready to be asked for coefficients and predictions."""

    packed: Packed
    fits: list[Fit]
    inputs: dict[str, Inputs]
    weights: dict[str, np.ndarray]
    passes: int

    def coefficients(self) -> DataFrame:
        """(model, class, name, value) on the scaled columns; an empty name is the intercept."""
        rows = []
        for f in self.fits:
            w = self.weights[f.name]
            for k in range(w.shape[1]):
                rows += [(f.name, k if w.shape[1] > 1 else 1, n, float(x)) for n, x in zip(self.inputs[f.name].names, w[:, k], strict=True)]
        return self.packed.table.sparkSession.createDataFrame(rows, "model string, class int, name string, value double")

    def predictions(self, fits: Sequence[Fit] | None = None) -> DataFrame:
        """(kept columns, model, y, p): each fit's test rows; p has the probability of each class."""
        packed, inputs, weights = self.packed, self.inputs, self.weights
        fits, kept = self.fits if fits is None else list(fits), [f"keep{k}" for k in range(len(packed.keep))]
        kinds = packed.table.select(*kept).schema
        schema = ", ".join([*(f"keep{k} {f.dataType.simpleString()}" for k, f in enumerate(kinds)), "model string, y int, p array<double>"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                block = Block.of(b)
                for f in fits:
                    own = inputs[f.name]
                    rows = np.flatnonzero(block.sets[:, own.test])
                    if len(rows):
                        p = probabilities(own.matrix(block, rows), weights[f.name])
                        at = pa.array(rows)
                        y = block.y[rows, own.y]
                        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))
                        columns = [*(b.column(4 + k).take(at) for k in range(len(kept))), pa.array([f.name] * len(rows)), pa.array(y, pa.int32(), mask=y < 0), flat]
                        yield pa.RecordBatch.from_arrays(columns, [*kept, "model", "y", "p"])

        out = packed.table.mapInArrow(run, schema)
        return out.select(*(F.col(f"keep{k}").alias(c) for k, c in enumerate(packed.keep) if c not in ("model", "y", "p")), "model", "y", "p")

    def held_out(self, arms: dict[str, Sequence[str]]) -> DataFrame:
        """(kept columns, a column for each arm): the probability of class 1 from the one fit of the arm that tests the row, null where none does."""
        packed, inputs, weights, kept = self.packed, self.inputs, self.weights, [f"keep{k}" for k in range(len(self.packed.keep))]
        kinds = packed.table.select(*kept).schema
        schema = ", ".join([*(f"keep{k} {f.dataType.simpleString()}" for k, f in enumerate(kinds)), *(f"arm{k} double" for k in range(len(arms)))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                block, out = Block.of(b), []
                for names in arms.values():
                    p = np.full(b.num_rows, np.nan)
                    for name in names:
                        own = inputs[name]
                        rows = np.flatnonzero(block.sets[:, own.test])
                        p[rows] = probabilities(own.matrix(block, rows), weights[name])[:, 1]
                    out.append(pa.array(p, mask=np.isnan(p)))
                yield pa.RecordBatch.from_arrays([*(b.column(4 + k) for k in range(len(kept))), *out], [*kept, *(f"arm{k}" for k in range(len(arms)))])

        return packed.table.mapInArrow(run, schema).toDF(*packed.keep, *arms)

    def close(self) -> None:
        """Deletes the packed table; predictions must be written by then."""
        dropped(self.packed.table)


def check_classes(fits: Sequence[Fit], transforms: dict[str, Transform]) -> None:
    if lone := [f.name for f in fits if np.count_nonzero(transforms[f.train].counts[f.y][: f.classes]) < 2]:
        raise ValueError(f"one class only in training: {lone[:5]}")


def solve(df: DataFrame, fits: Sequence[Fit], keep: Sequence[str] = (), one_class: str = "raise") -> Fitted:
    """Fits all models. ``keep`` names columns that predictions carry.

    A training set with rows of one class only, or none, has no finite fit: an error,
    or with ``one_class="rate"`` a fit that gives that class to all rows.
    """
    packed = Packed(df, fits, keep)
    transforms = _transforms(packed, fits)
    inputs = {f.name: Inputs(packed, f, transforms[f.train]) for f in fits}
    blocks = {}
    for f in fits:
        if f.axes:
            blocks.setdefault((f.train, f.axes[0]), []).append(f)
    if blocks:
        order = list(blocks)
        first = [inputs[blocks[key][0].name] for key in order]

        def spread(b: Block) -> Iterator[tuple[int, np.ndarray]]:
            for k, own in enumerate(first):
                z = own.transform.applied(b.x[b.sets[:, own.train]], own.block)
                yield k, (z.T @ z).ravel()

        for k, v in _summed(packed, spread).items():
            d = len(first[k].block)
            axes = np.linalg.eigh(v.reshape(d, d))[1][:, ::-1]
            for f in blocks[order[k]]:
                inputs[f.name].axes = axes[:, : f.axes[1]]
    states = {f.name: State(len(inputs[f.name].names), f.classes, f.c) for f in fits}
    lone = [f for f in fits if np.count_nonzero(inputs[f.name].counts) < 2]
    if one_class == "raise":
        check_classes(fits, transforms)
    for f in lone:
        own = states[f.name]
        own.done, n = True, inputs[f.name].counts
        sign = np.where(n > 0, 36.0, -36.0)
        own.w[own.free] = sign if own.k > 1 else sign[1:]
    passes = 0
    while live := [k for k, f in enumerate(fits) if not states[f.name].done]:
        # fits that differ in the penalty or target alone come together and share a matrix
        kind = {k: (f.train, f.numeric, f.categories, f.axes) for k, f in enumerate(fits)}
        now = [(k, kind[k], inputs[fits[k].name], states[fits[k].name].columns()) for k in sorted(live, key=lambda k: repr(kind[k]))]

        def sums(b: Block, now: list = now) -> Iterator[tuple[int, np.ndarray]]:
            last, whole = None, np.zeros((0, 0))
            for k, key, own, w in now:
                if key != last:
                    last, rows = key, np.flatnonzero(b.sets[:, own.train])
                    whole = own.matrix(b, rows)
                y = b.y[rows, own.y]
                z, y = (whole, y) if (y >= 0).all() else (whole[y >= 0], y[y >= 0])
                weight = own.weights[y] if own.weights is not None else np.ones(len(y))
                yield k, step_sums(z, y, weight, w)

        got = _summed(packed, sums)
        passes += 1
        for k in live:
            states[fits[k].name].advance(got[k])
    return Fitted(packed, list(fits), inputs, {f.name: states[f.name].columns() for f in fits}, passes)
