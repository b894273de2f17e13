"""Boosted histogram trees, many fits at once: a level of every fit's tree is one pass over the table.

Numbers (imputed by the training median) fall into bins between approximate quantiles of
the training rows, levels are columns of 0 and 1. A pass sums, for every fit, node of the
level, column and bin, the gradient, Hessian and rows of the log loss; from these sums the
driver takes each node's split of the largest second-order gain, with an L2 penalty and a
least number of rows on either side. Nodes are then grown best first, up to a number of
leaves and a depth, as if one after another: the gains of all nodes that could be split
are known by then. Rows follow the trees where they are: their scores are stored beside
them and brought up to date every EVERY rounds, and between by the trees since.

What goes to the driver is fits x nodes x columns x bins numbers a pass, whatever the
rows. A tie between splits goes to the first column, and there to the lowest bin.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dropped, written
from . import partials
from .newton import Block, Fit, Packed, _transforms, check_classes

BINS, EVERY = 255, 20


@dataclass(frozen=True)
class Settings:
    rounds: int = 200
    rate: float = 0.05
    depth: int = 3
    leaves: int = 7
    least: int = 30
    penalty: float = 1.0
    hessian: float = 1e-3


@dataclass
class Tree:
    """Nodes: column and bin of the split (rows up to the bin go left), children, value; a leaf has column -1."""

    column: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, column: int, at: int, values: tuple[float, float]) -> int:
        """The left child's number; the right one follows it."""
        self.column[node], self.bin[node], self.left[node] = column, at, len(self.column)
        for v in values:
            self.column.append(-1), self.bin.append(0), self.left.append(0), self.value.append(v)
        return self.left[node]

    def nodes(self, b: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row of bins ends in."""
        column, at, left = np.array(self.column), np.array(self.bin), np.array(self.left)
        node = np.zeros(len(b), int)
        for _ in range(depth):
            c = column[node]
            inner = c >= 0
            right = b[np.arange(len(b)), np.maximum(c, 0)] > at[node]
            node = np.where(inner, left[node] + right, node)
        return node

    def scores(self, b: np.ndarray, depth: int) -> np.ndarray:
        return np.array(self.value)[self.nodes(b, depth)]


class Columns:
    """A fit's columns as bins."""

    def __init__(self, packed: Packed, fit: Fit, median: np.ndarray, edges: dict[int, np.ndarray]):
        self.numbers = [packed.numeric.index(c) for c in fit.numeric]
        self.categories = [(packed.categories.index(c), len(packed.levels[c])) for c in fit.categories]
        self.train, self.test, self.y = packed.sets.index(fit.train), packed.sets.index(fit.test), packed.targets.index(fit.y)
        self.median, self.edges = median, [edges.get(k, np.zeros(0)) for k in self.numbers]
        self.count = len(self.numbers) + sum(n for _, n in self.categories)

    def bins(self, b: Block, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), self.count), np.int64)
        for j, k in enumerate(self.numbers):
            x = b.x[rows, k]
            m = self.median[k]
            out[:, j] = 0 if np.isnan(m) else np.searchsorted(self.edges[j], np.where(np.isnan(x), m, x), side="left")
        j = len(self.numbers)
        for k, n in self.categories:
            out[:, j : j + n] = b.levels[rows, k][:, None] == np.arange(1, n + 1)[None, :]
            j += n
        return out


def histogram(bins: np.ndarray, node: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """(nodes, columns, bins, 3): gradient, Hessian and rows."""
    out = np.zeros((nodes, bins.shape[1], width, 3))
    ok = node >= 0
    for j in range(bins.shape[1]):
        at = node[ok] * width + bins[ok, j]
        for k, w in enumerate((g[ok], h[ok], None)):
            out[:, j, :, k] = np.bincount(at, w, nodes * width).reshape(nodes, width)
    return out


def best_split(hist: np.ndarray, s: Settings) -> tuple[float, int, int, float, float] | None:
    """(gain, column, bin, left value, right value) of one node's histogram (columns, bins, 3)."""
    up = hist.cumsum(axis=1)
    whole = up[0, -1]
    left, right = up[:, :-1], whole - up[:, :-1]
    score = lambda x: x[..., 0] ** 2 / (x[..., 1] + s.penalty)
    gain = score(left) + score(right) - score(whole)
    fine = (np.minimum(left[..., 2], right[..., 2]) >= s.least) & (np.minimum(left[..., 1], right[..., 1]) >= s.hessian)
    gain = np.where(fine, gain, -np.inf)
    if not gain.size or not gain.max() > 1e-12:
        return None
    # equal up to rounding counts as a tie
    j, k = (int(i) for i in np.unravel_index(np.flatnonzero(gain.ravel() >= gain.max() * (1 - 1e-12))[0], gain.shape))
    value = lambda x: -s.rate * float(x[0] / (x[1] + s.penalty))
    return float(gain[j, k]), j, k, value(left[j, k]), value(right[j, k])


class Grower:
    """One fit's tree of a round: first all splits level by level, then those that best-first growth reaches."""

    def __init__(self, s: Settings):
        self.s, self.tree, self.gain, self.level = s, Tree(), {}, [0]

    def add(self, hist: np.ndarray) -> None:
        """The level's histograms, in the order of ``level``."""
        below = []
        for node, h in zip(self.level, hist, strict=True):
            if found := best_split(h, self.s):
                self.gain[node] = found[0]
                left = self.tree.split(node, found[1], found[2], found[3:])
                below += [left, left + 1]
        self.level = below

    def grown(self) -> Tree:
        t, leaves, ready = Tree(), 1, [(-self.gain[0], 0, 0)] if 0 in self.gain else []
        while ready and leaves < self.s.leaves:
            ready.sort()
            _, node, mine = ready.pop(0)
            left = self.tree.left[node]
            own = t.split(mine, self.tree.column[node], self.tree.bin[node], (self.tree.value[left], self.tree.value[left + 1]))
            leaves += 1
            ready += [(-self.gain[left + k], left + k, own + k) for k in (0, 1) if left + k in self.gain]
        return t


@dataclass
class Boosted:
    packed: Packed
    fits: list[Fit]
    columns: list[Columns]
    base: list[float]
    trees: list[list[Tree]]
    settings: Settings

    def held_out(self, arms: dict[str, Sequence[str]]) -> DataFrame:
        """(kept columns, a column for each arm): the probability of class 1 from the one fit of the arm that tests the row."""
        keep, fits, columns, base, trees, depth = self.packed.keep, [f.name for f in self.fits], self.columns, self.base, self.trees, self.settings.depth
        kept = [f"keep{k}" for k in range(len(keep))]
        schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in self.packed.table.select(*kept).schema), *(f"arm{k} double" for k in range(len(arms)))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                block, out = Block.of(b), []
                for names in arms.values():
                    p = np.full(b.num_rows, np.nan)
                    for k in map(fits.index, names):
                        rows = np.flatnonzero(block.sets[:, columns[k].test])
                        bins = columns[k].bins(block, rows)
                        p[rows] = 1 / (1 + np.exp(-(base[k] + sum((t.scores(bins, depth) for t in trees[k]), np.zeros(len(rows))))))
                    out.append(pa.array(p, mask=np.isnan(p)))
                yield pa.RecordBatch.from_arrays([*(b.column(4 + k) for k in range(len(keep))), *out], [*kept, *(f"arm{k}" for k in range(len(arms)))])

        return self.packed.table.mapInArrow(run, schema).toDF(*keep, *arms)

    def close(self) -> None:
        dropped(self.packed.table)


def boost(df: DataFrame, fits: Sequence[Fit], keep: Sequence[str] = (), settings: Settings | None = None) -> Boosted:
    """Fits all models with two classes; of a fit, rows, target and columns count."""
    s, fits = settings or Settings(), list(fits)
    packed = Packed(df, fits, keep)
    transforms = _transforms(packed, fits)
    check_classes(fits, transforms)
    edges = _edges(packed, fits, transforms)
    columns = [Columns(packed, f, transforms[f.train].median, edges[f.train]) for f in fits]
    width = max([2, *(len(e) + 1 for c in columns for e in c.edges)])
    rate = [transforms[f.train].counts[f.y] for f in fits]
    base = [float(np.log(n[1] / n[0])) for n in rate]
    trees: list[list[Tree]] = [[] for _ in fits]
    state = written(packed.table.select("x", "levels", "y", "sets", F.array(*(F.lit(b) for b in base)).alias("score")), "trees-scores")
    fresh = 0
    for r in range(s.rounds):
        growers = [Grower(s) for _ in fits]
        since = [t[len(t) - fresh :] for t in trees]
        for _ in range(s.depth):
            now = [(k, columns[k], since[k], growers[k].tree, growers[k].level) for k in range(len(fits)) if growers[k].level]
            if not now:
                break

            def one(b: pa.RecordBatch, now: list = now) -> Iterator[tuple[int, np.ndarray]]:
                block, score = Block.of(b), partials.matrix(b.column(4))
                for k, c, recent, tree, level in now:
                    rows = np.flatnonzero(block.sets[:, c.train] & (block.y[:, c.y] >= 0))
                    bins = c.bins(block, rows)
                    raw = score[rows, k] + sum((t.scores(bins, s.depth) for t in recent), np.zeros(len(rows)))
                    p = 1 / (1 + np.exp(-raw))
                    slot = np.full(len(tree.column), -1)
                    slot[level] = np.arange(len(level))
                    yield k, histogram(bins, slot[tree.nodes(bins, s.depth)], len(level), p - block.y[rows, c.y], p * (1 - p), width).ravel()

            for k, v in partials.summed(state, one).items():
                growers[k].add(v.reshape(len(growers[k].level), columns[k].count, width, 3))
        for k, g in enumerate(growers):
            trees[k].append(g.grown())
        fresh += 1
        if fresh == EVERY and r + 1 < s.rounds:
            old, state = state, written(_scored(state, columns, [t[-fresh:] for t in trees], s.depth), "trees-scores")
            dropped(old)
            fresh = 0
    dropped(state)
    return Boosted(packed, fits, columns, base, trees, s)


def _edges(packed: Packed, fits: Sequence[Fit], transforms: dict) -> dict[str, dict[int, np.ndarray]]:
    """Of each training set, bounds between bins of each number: its different quantiles, the last one aside."""
    trains = list(dict.fromkeys(f.train for f in fits))
    out: dict[str, dict[int, np.ndarray]] = {s: {} for s in trains}
    if not packed.numeric:
        return out
    member = F.filter(F.array(*(F.when(F.col("sets")[packed.sets.index(s)], F.lit(k)) for k, s in enumerate(trains))), lambda k: k.isNotNull())
    long = packed.table.select(F.explode(member).alias("s"), "x").select("s", F.posexplode("x").alias("j", "x"))
    median = F.create_map(*(x for k, s in enumerate(trains) for j, m in enumerate(transforms[s].median) for x in (F.lit(f"{k}|{j}"), F.lit(float(m)))))
    key = F.concat_ws("|", F.col("s").cast("string"), F.col("j").cast("string"))
    filled = long.withColumn("x", F.when(F.col("x").isNull() | F.isnan("x"), F.element_at(median, key)).otherwise(F.col("x"))).where("not isnan(x)")
    cuts = filled.groupBy("s", "j").agg(F.percentile_approx("x", [k / BINS for k in range(1, BINS)], 10_000).alias("cuts"), F.max("x").alias("top"))
    for r in cuts.collect():  # a row a set and column
        e = np.unique(r.cuts)
        out[trains[r.s]][r.j] = e[e < r.top]
    return out


def _scored(state: DataFrame, columns: list[Columns], recent: list[list[Tree]], depth: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                block, score = Block.of(b), partials.matrix(b.column(4)).copy()
                for k, c in enumerate(columns):
                    bins = c.bins(block, np.arange(b.num_rows))
                    for t in recent[k]:
                        score[:, k] += t.scores(bins, depth)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, score.size + 1, score.shape[1]), pa.int32()), pa.array(score.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(4)), flat], ["x", "levels", "y", "sets", "score"])

    return state.mapInArrow(run, "x array<double>, levels array<int>, y array<int>, sets array<boolean>, score array<double>")
