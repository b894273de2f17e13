"""Embedding near-dedup against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from eventloom.llm import cover_tree, queries

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows: list, cosine: float = 0.95) -> list:
    n = len(rows)
    fine = [i is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v in rows]
    link = np.zeros((n, n), bool)
    for size in {len(v) for (_, v), f in zip(rows, fine, strict=True) if f}:
        at = [k for k, (_, v) in enumerate(rows) if fine[k] and len(v) == size]
        x = np.array([rows[k][1] for k in at], float)
        x /= np.abs(x).max(axis=1)[:, None]
        x /= np.linalg.norm(x, axis=1)[:, None]
        link[np.ix_(at, at)] = x @ x.T >= cosine
    np.fill_diagonal(link, False)
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(link), strict=True):
        u, v = top(rows[a][0]), top(rows[b][0])
        root[max(u, v)] = min(u, v) if u != v else root[max(u, v)]
    out = []
    for k, (i, _) in enumerate(rows):
        c = top(i) if fine[k] else i
        out.append((i, int(link[k].sum()), c, i is not None and i == c))
    return sorted(out, key=str)


def got(spark, rows: list, cosine: float = 0.95, schema: str = SCHEMA) -> list:
    return sorted((tuple(r) for r in cover_tree.near_links(spark.createDataFrame(rows, schema), cosine).collect()), key=str)


def clusters(seed: int, n: int, dim: int) -> list:
    """A hot group, loose and tight groups, chains along an arc, copies, and vectors far from all."""
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(dim) + 0 for _ in range(n)]
    hot = rng.standard_normal(dim)
    out += [hot + rng.standard_normal(dim) * 0.05 for _ in range(n)]
    for spread in (0.02, 0.12, 0.2, 0.3):
        for _ in range(3):
            c = rng.standard_normal(dim)
            out += [(c + rng.standard_normal(dim) * spread) * rng.uniform(0.1, 9) for _ in range(n // 12)]
    u, v = rng.standard_normal((2, dim))
    out += [np.cos(t) * u + np.sin(t) * v for t in np.linspace(0, 3, n // 4)]
    out += [out[0]] * 7 + [out[n + 1]] * 9 + [out[3] * 4] * 3
    order = rng.permutation(len(out))
    return [(int(k) * 3, [float(x) for x in out[j]]) for k, j in enumerate(order)]


@pytest.mark.parametrize(("n", "dim"), [(150, 16), (60, 3)])
def test_same_as_all_pairs(spark, monkeypatch, n, dim):
    rows = clusters(n, n, dim)
    want = brute(rows)
    assert got(spark, rows) == want
    monkeypatch.setattr(cover_tree, "BLOCK", 40)  # upper levels, many parts
    monkeypatch.setattr(cover_tree, "SAMPLE", 250)
    assert got(spark, rows) == want


def test_trees_and_walks():
    """Trees cover, nest and halve; walks within one tree and between two find each pair once."""
    rows = clusters(9, 200, 8)
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    w = np.random.default_rng(1).integers(1, 4, len(x))
    for cosine in (0.5, 0.9, 0.95, 0.999):
        finest = np.sqrt(2 - 2 * cosine) / 64
        tree = cover_tree.CoverTree(x, finest)
        for k in range(len(tree.start)):
            own = tree.order[tree.start[k] : tree.end[k]]
            assert tree.centre[k] in own and cover_tree.distances(tree.mid[k : k + 1], x[own]).max() <= tree.radius[k] + 1e-7
            c = np.arange(tree.child[k], tree.child[k] + tree.children[k])
            if len(c):
                assert tree.centre[k] in tree.centre[c] and tree.radius[c].max() <= cover_tree.below(tree.radius[k])
                assert tree.start[c[0]] == tree.start[k] and tree.end[c[-1]] == tree.end[k] and (tree.start[c[1:]] == tree.end[c[:-1]]).all()
        link = x @ x.T >= cosine
        np.fill_diagonal(link, False)
        links, mate = cover_tree.Walk(tree, w, None, None, cosine).found()
        assert (links == link @ w).all()
        assert (cover_tree.merged(len(x), np.arange(len(x)), mate) == cover_tree.merged(len(x), *np.nonzero(link))).all()
        n = len(x) // 3
        links, mate = cover_tree.Walk(cover_tree.CoverTree(x[:n], finest), w[:n], cover_tree.CoverTree(x[n:], finest), w[n:], cosine).found()
        across = link.copy()
        across[:n, :n] = across[n:, n:] = False
        assert (links == across @ w).all()
        assert (cover_tree.merged(len(x), np.arange(len(x)), mate) == cover_tree.merged(len(x), *np.nonzero(across))).all()


def test_tight_groups_are_linked_without_pairs(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal(16) + rng.standard_normal((3000, 16)) * 0.01
    x /= np.linalg.norm(x, axis=1)[:, None]
    monkeypatch.setattr(cover_tree.Walk, "_members", lambda *a: pytest.fail("compared pairs") if len(a[1]) else None)
    links, _ = cover_tree.Walk(cover_tree.CoverTree(x, 0.005), np.ones(3000, int), None, None, 0.95).found()
    assert (links == 2999).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, None]), (8, [inf, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [3.0, 0.0, 0.1]), (None, [1.0, 0.0])]
    rows += [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (12, [0.0, 3.0]), (13, [1e300, 1e299]), (14, [1e-300, 1e-301]), (15, [-1.0, 0.0])]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == [] and got(spark, [(1, None)]) == [(1, 0, 1, True)]
    clash = [(*r, 1, "a") for r in rows]
    assert got(spark, clash, schema=SCHEMA + ", N_Links long, h1 string") == brute(rows)


def test_query_same_as_all_pairs(spark, data):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{data}/sf0.01/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op12_near_dedup(spark, f"{data}/sf0.01").collect()), key=str) == brute(rows)
