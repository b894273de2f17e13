"""Boosted trees by summed histograms against a grower on the whole matrix."""

from __future__ import annotations

import numpy as np
import pytest
from eventloom.operators import models, trees
from eventloom.operators.newton import Fit


def grow(b: np.ndarray, g: np.ndarray, h: np.ndarray, s: trees.Settings) -> np.ndarray:
    """Each row's value in a tree grown best first, one node after another, splits tried one by one."""
    value = np.zeros(len(b))

    def candidate(rows: np.ndarray, depth: int):
        best = (1e-12, None)
        for j in range(b.shape[1]) if depth < s.depth else ():
            for k in sorted(set(b[rows, j]))[:-1]:
                left, right = rows[b[rows, j] <= k], rows[b[rows, j] > k]
                if min(len(left), len(right)) >= s.least and min(h[left].sum(), h[right].sum()) >= s.hessian:
                    gain = sum(g[x].sum() ** 2 / (h[x].sum() + s.penalty) for x in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + s.penalty)
                    if gain > best[0] * (1 + 1e-11):
                        best = (gain, (left, right))
        return (*best, depth)

    ready, leaves = [candidate(np.arange(len(b)), 0)], 1
    while leaves < s.leaves and (ready := [c for c in ready if c[1] is not None]):
        top = max(range(len(ready)), key=lambda i: ready[i][0])
        _, sides, depth = ready.pop(top)
        for x in sides:
            value[x] = -s.rate * g[x].sum() / (h[x].sum() + s.penalty)
            ready.append(candidate(x, depth + 1))
        leaves += 1
    return value


def test_splits_are_the_growers(spark, monkeypatch):
    monkeypatch.setattr(trees, "EVERY", 3)
    monkeypatch.setattr(trees, "BINS", 16)
    rng = np.random.default_rng(8)
    n = 600
    x = np.c_[rng.standard_normal(n), rng.uniform(size=n), np.round(rng.standard_normal(n))]
    x[rng.random(n) < 0.1, 1] = np.nan
    kind = rng.integers(0, 3, n)
    y = ((np.abs(x[:, 0]) < 0.6) ^ (kind == 1) ^ (rng.random(n) < 0.1)).astype(int)
    rows = [(i, *(None if np.isnan(v) else float(v) for v in x[i]), f"k{kind[i]}", int(y[i]), i % 3 + 1) for i in range(n)]
    df, folds, _ = models.fold_sets(spark.createDataFrame(rows, "id long, a double, b double, c double, kind string, y int, fold int").repartition(3))
    s = trees.Settings(rounds=8, least=10)
    fits = [Fit(f"{f}", f"train{f}", f"test{f}", "y", ("a", "b", "c"), ("kind",)) for f in folds]
    got = trees.boost(df, fits, ["id"], s)
    p = {r.id: r.m for r in got.held_out({"m": [f.name for f in fits]}).collect()}
    for k, f in enumerate(folds):
        c, train, test = got.columns[k], np.flatnonzero(np.arange(n) % 3 + 1 != f), np.flatnonzero(np.arange(n) % 3 + 1 == f)
        filled = np.where(np.isnan(x), np.nanmedian(x[train], axis=0), x)
        b = np.c_[*(np.searchsorted(e, filled[:, j], side="left") for j, e in enumerate(c.edges)), *((kind == j).astype(int) for j in range(3))]
        raw = np.full(n, np.log(y[train].mean() / (1 - y[train].mean())))
        for t in got.trees[k]:
            q = 1 / (1 + np.exp(-raw[train]))
            want = grow(b[train], q - y[train], q * (1 - q), s)
            mine = t.scores(b, s.depth)
            assert np.abs(mine[train] - want).max() < 1e-9 and sum(col < 0 for col in t.column) <= 7
            raw += mine
        assert np.abs(np.array([p[i] for i in test]) - 1 / (1 + np.exp(-raw[test]))).max() < 1e-12
    with pytest.raises(ValueError, match="one class only"):
        trees.boost(df.where("y = 1"), fits[:1])
    got.close()
