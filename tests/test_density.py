"""Density clusters against the definition: all pairs in order, one tree, recursion."""

from __future__ import annotations

import math

import numpy as np
import pytest
from eventloom.operators import density, metrics
from eventloom.plans import density_queries as Q
from pyspark.sql import functions as F

SETTINGS = [(5, "eom", 0.0), (5, "leaf", 0.0), (8, "eom", 0.0), (5, "eom", 0.9), (5, "leaf", 0.9), (3, "leaf", 0.4), (100, "eom", 0.0)]


def plain(x: dict, k: int, size: int, choice: str, epsilon: float) -> tuple[dict, dict]:
    ids = sorted(x)
    d = {(i, j): math.dist(x[i], x[j]) for i in ids for j in ids}
    core = {i: sorted(d[i, j] for j in ids if j != i)[: k][-1] for i in ids}
    pairs = sorted((max(d[i, j], core[i], core[j]), i, j) for i in ids for j in ids if i < j)
    of, members, tree = {i: i for i in ids}, {i: [i] for i in ids}, {i: i for i in ids}
    for w, i, j in pairs:
        a, b = of[i], of[j]
        if a != b:
            tree[a] = (w, tree[a], tree[b], len(members[a]) + len(members[b]))
            members[a] += members[b]
            for m in members.pop(b):
                of[m] = a
    points = lambda t: [t] if not isinstance(t, tuple) else points(t[1]) + points(t[2])
    count = lambda t: t[3] if isinstance(t, tuple) else 1
    nodes = []  # parent, birth, [(lambda, points)], split lambda, children

    def condense(t, parent, birth):
        me = len(nodes)
        nodes.append([parent, birth, [], None, []])
        while True:
            lam = 1 / max(t[0], 1e-12)
            big = [c for c in t[1:3] if count(c) >= size]
            for c in t[1:3]:
                if count(c) < size:
                    nodes[me][2] += [(lam, p) for p in points(c)]
            if len(big) == 2:
                nodes[me][3] = lam
                nodes[me][4] = [condense(c, me, lam) for c in big]
                return me
            if not big:
                return me
            t = big[0]

    top = tree[of[ids[0]]]
    if count(top) < size:
        return dict.fromkeys(ids, (None, 0.0)), {}
    condense(top, None, 0.0)
    under = lambda c: [p for _, p in nodes[c][2]] + [p for e in nodes[c][4] for p in under(e)]
    stability = [sum(l - n[1] for l, _ in n[2]) + sum(len(under(e)) * (n[3] - n[1]) for e in n[4]) for n in nodes]

    def best(c):
        if not nodes[c][4]:
            return stability[c], [c]
        value = sum(best(e)[0] for e in nodes[c][4])
        if c and stability[c] >= value:
            return stability[c], [c]
        return value, [y for e in nodes[c][4] for y in best(e)[1]]

    chosen = [c for c in (best(0)[1] if choice == "eom" else [c for c in range(len(nodes)) if not nodes[c][4]]) if c]
    final = set()
    for c in chosen:
        while 1 / nodes[c][1] < epsilon and nodes[c][0] != 0:
            c = nodes[c][0]
        final.add(c)
    most = max(l for n in nodes for l in [x for x, _ in n[2]] + ([n[3]] if n[3] else []))
    labels, found = dict.fromkeys(ids, (None, 0.0)), {}
    for c in final:
        all_, name = under(c), min(under(c))
        peak = max([l for l, _ in nodes[c][2]] + ([nodes[c][3]] if nodes[c][3] else []))
        leaves = dict((p, l) for e in range(len(nodes)) for l, p in nodes[e][2])
        for p in all_:
            labels[p] = (name, min(leaves[p], peak) / peak)
        found[name] = (len(all_), stability[c], stability[c] / (len(all_) * most))
    return labels, found


def groups() -> dict:
    r = np.random.default_rng(3)
    centres = [(0, 0, 0), (4, 0, 0), (4.8, 1.0, 0), (0, 5, 1), (9, 9, 9)]
    x = [r.normal(c, s, (n, 3)) for c, s, n in zip(centres, (0.3, 0.25, 0.25, 0.8, 2.5), (30, 25, 25, 30, 20), strict=True)]
    return {7 * k - 50: tuple(v) for k, v in enumerate(np.concatenate(x).tolist())}


def grid() -> dict:
    """Whole numbers: most distances are ties, and some rows are equal."""
    r = np.random.default_rng(5)
    return {k: tuple(map(float, v)) for k, v in enumerate(r.integers(0, 6, (110, 2)))}


@pytest.mark.parametrize(("x", "k", "block", "chunk"), [(groups(), 4, 1000, 1 << 18), (groups(), 4, 45, 60), (grid(), 3, 60, 90)])
def test_cuts(spark, x, k, block, chunk):
    df = spark.createDataFrame([(i, list(v)) for i, v in x.items()], "id long, v array<double>")
    labels, found = density.clusters(df, k, SETTINGS, block=block, chunk=chunk)
    labels, found = labels.collect(), found.collect()
    assert len(labels) == len(SETTINGS) * len(x)
    for s in SETTINGS:
        want, clusters = plain(x, k, *s)
        got = {r.id: (r.cluster, r.probability) for r in labels if (r["size"], r.choice, r.epsilon) == s}
        assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}, s
        assert all(abs(got[i][1] - want[i][1]) < 1e-9 for i in x)
        mine = {r.cluster: (r.n, r.stability, r.persistence) for r in found if (r["size"], r.choice, r.epsilon) == s}
        assert set(mine) == set(clusters)
        assert all(np.allclose(mine[c], clusters[c], rtol=1e-9) for c in mine)


def test_small_and_bad(spark):
    schema = "id long, v array<double>"
    for rows in ([], [(1, [0.0, 1.0])], [(1, [0.0]), (2, [1.0])], [(k, [1.0, 2.0]) for k in range(6)]):
        labels, found = density.clusters(spark.createDataFrame(rows, schema), 2, [(2, "leaf", 0.0)])
        assert len(labels.collect()) == len(rows) and all(r.cluster is None for r in labels.collect())
    bad = [(100, None), (101, [float("nan"), 0.0, 0.0]), (102, [0.0, None, 1.0]), (103, [])]
    x = groups()
    labels, _ = density.clusters(spark.createDataFrame([*[(i, list(v)) for i, v in x.items()], *[(900 + i, v) for i, v in bad]], schema), 4, [(5, "eom", 0.0)])
    got = {r.id: r.cluster for r in labels.collect()}
    want, _ = plain(x, 4, 5, "eom", 0.0)
    assert all(got[900 + i] is None for i, _ in bad) and all(got[i] == want[i][0] for i in x)
    with pytest.raises(ValueError):
        density.clusters(spark.createDataFrame([(1, [0.0])], schema), 2, [(1, "eom", 0.0)])


def test_stats(spark):
    x = groups()
    labels, found = density.clusters(spark.createDataFrame([(i, list(v)) for i, v in x.items()], "id long, v array<double>"), 4, [(5, "eom", 0.0), (100, "eom", 0.0)])
    got = {r["size"]: r for r in density.solution_stats(labels, found).collect()}
    want, clusters = plain(x, 4, 5, "eom", 0.0)
    truth = spark.createDataFrame([(i, k // 30) for k, i in enumerate(x)], "id long, label int")
    ari = {r["size"]: r.label_ari for r in density.against(labels, truth).collect()}
    one = labels.where("size = 5").join(truth, "id").select("label", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    assert abs(ari[5] - metrics.agreement(one, "label", "cluster").first().ari) < 1e-12 and ari[5] > 0.2 and ari[100] == 0
    sizes = [n for n, _, _ in clusters.values()]
    assert got[5].n_clusters == len(sizes) and abs(got[5].noise_rate - sum(c is None for c, _ in want.values()) / len(x)) < 1e-12
    assert got[5].median_size == float(np.median(sizes)) and abs(got[5].largest_share - max(sizes) / len(x)) < 1e-12
    assert got[100].n_clusters == 0 and got[100].noise_rate == 1 and got[100].mean_persistence is None


def test_queries(spark, data):
    d = f"{data}/sf0.001"
    x = {r.id: tuple(r.v) for r in Q._space(spark, d).collect()}
    want, clusters = plain(x, Q.NEIGHBOURS, *Q.CUT)
    got = {r.id: r for r in Q.clu1_density(spark, d).collect()}
    assert len(clusters) >= 2 and {i: r.cluster for i, r in got.items()} == {i: c for i, (c, _) in want.items()}
    assert all(abs(got[i].probability - p) < 1e-5 for i, (_, p) in want.items())
    rows = {r.cluster: (r.n, r.persistence) for r in Q.clu1_persistence(spark, d).collect()}
    assert {c: n for c, (n, _) in rows.items()} == {c: n for c, (n, _, _) in clusters.items()}
    assert all(abs(rows[c][1] - clusters[c][2]) < 1e-5 for c in rows)
    p = {r.protocol: r for r in Q.clu14_noise_protocols(spark, d).collect()}
    noise = sum(c is None for c, _ in want.values())
    assert p["include_noise"].n == len(x) and abs(p["include_noise"].noise_rate - noise / len(x)) < 1e-6
    assert p["exclude_noise"].n == len(x) - noise and p["exclude_noise"].n_clusters == p["include_noise"].n_clusters == len(clusters)


def test_grid_query(spark, data):
    d = f"{data}/sf0.001"
    x = {r.id: tuple(r.v) for r in Q._space(spark, d).collect()}
    got = {(r.neighbours, r["size"], r.choice, r.epsilon): r for r in Q.clu2_density_grid(spark, d).collect()}
    assert len(got) == 2 * len(Q.GRID)
    for k in (Q.NEIGHBOURS, 2 * Q.NEIGHBOURS):
        for s in Q.GRID[::3]:
            want, clusters = plain(x, k, *s)
            r = got[(k, *s)]
            assert r.n_clusters == len(clusters) and abs(r.noise_rate - sum(c is None for c, _ in want.values()) / len(x)) < 1e-6
            if clusters:
                assert abs(r.max_persistence - max(c for _, _, c in clusters.values())) < 1e-5
                assert abs(r.largest_share - max(n for n, _, _ in clusters.values()) / len(x)) < 1e-6
