"""Core distances and trees by cells of space, against all pairs; how few edges and visits they take."""

from __future__ import annotations

import numpy as np
import pytest
from eventloom.operators import cells


def rows(kind: str) -> np.ndarray:
    r = np.random.default_rng(7)
    if kind == "copies":  # 40 places, one of them with half of the rows
        return np.concatenate([np.zeros((450, 3)), r.normal(0, 1, (40, 3))[r.integers(0, 40, 450)]])
    if kind == "far":  # two clouds without a link, and a few rows between
        return np.concatenate([r.normal(0, 1, (500, 3)), r.normal(60, 0.2, (380, 3)), r.normal(30, 9, (20, 3))])
    return r.normal(0, 1, (900, 3)) * r.exponential(1, (900, 1))


@pytest.mark.parametrize("kind", ["heavy tails", "copies", "far"])
def test_tree_is_that_of_all_pairs(spark, kind):
    x, k = rows(kind), 4
    n = len(x)
    points, boxes = cells.cores(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>"), k, 50)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(np.where(np.eye(n, dtype=bool), np.inf, d), axis=1)[:, k - 1]
    assert np.array_equal([r.core for r in points.orderBy("id").collect()], core)
    assert len(boxes.names) >= 18
    found = cells.edges(points, boxes).toPandas()
    a, b = np.triu_indices(n, 1)
    w = np.maximum(np.maximum(d, core[:, None]), core[None, :])[a, b]
    keep = cells.forest(a, b, w, a, b)
    want = set(zip(a[keep].tolist(), b[keep].tolist(), w[keep].tolist(), strict=True))
    assert len(want) == n - 1 and want <= set(found.itertuples(index=False, name=None))
    assert kind == "copies" or len(found) < 6 * n  # by all pairs of blocks, 18 * 2 a row
