"""Mixtures by sums against a plain EM on the whole matrix."""

from __future__ import annotations

import math

import numpy as np
import pytest
from eventloom.operators import mixture


def table(n: int = 300, d: int = 4) -> np.ndarray:
    rng = np.random.default_rng(3)
    return np.concatenate([rng.standard_normal((n // 3, d)) * s + m for s, m in ((0.5, 0), (1.0, 3), (0.2, -2))])


def plain(x: np.ndarray, m: mixture.Mixture, steps: int) -> list[tuple[float, np.ndarray]]:
    """(log likelihood, means) of each iteration from the same start."""
    w, mu, s = m.weights.copy(), m.means.copy(), m.spread.copy()
    n, d = x.shape
    out = []
    for _ in range(steps):
        p = np.zeros((n, len(w)))
        for j in range(len(w)):
            c = np.diag(s[j]) if m.kind == "diag" else s[j]
            z = x - mu[j]
            p[:, j] = w[j] * np.exp(-0.5 * np.einsum("ni,ij,nj->n", z, np.linalg.inv(c), z)) / math.sqrt((2 * math.pi) ** d * np.linalg.det(c))
        total = p.sum(axis=1)
        out.append((float(np.log(total).sum()), mu.copy()))
        r = p / total[:, None]
        mass = r.sum(axis=0) + 10 * np.finfo(float).eps
        w, mu = mass / mass.sum(), (r.T @ x) / mass[:, None]
        for j in range(len(w)):
            z = x - mu[j]
            s[j] = (r[:, j] @ (z * z)) / mass[j] + 1e-6 if m.kind == "diag" else (z * r[:, j, None]).T @ z / mass[j] + 1e-6 * np.eye(d)
    return out


@pytest.mark.parametrize("kind", ["diag", "full"])
def test_same_as_plain(spark, kind):
    x = table()
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(4).cache()
    n, first = mixture.begun(df, [1, 3], kind, 2, 1, "v")
    assert n == len(x) and set(first) == {(1, 0), (1, 1), (3, 0), (3, 1)}
    _, best, trace = mixture.fitted(df, [1, 3], kind, restarts=2, steps=12, tolerance=-math.inf)
    for key, m in first.items():
        want = plain(x, m, 12)
        got = [t[key] for t in trace]
        assert np.abs(np.array(got) - [a / n for a, _ in want]).max() < 1e-9
        assert (np.diff(got) > -1e-7).all()  # the likelihood doesn't fall, but for the regularisation
    m = best[3]
    assert m.log_likelihood == max(trace[-1][3, r] for r in (0, 1)) * n or abs(m.log_likelihood / n - max(trace[-1][3, r] for r in (0, 1))) < 1e-12
    assert m.parameters == 3 * 4 + (3 * 4 if kind == "diag" else 3 * 10) + 2
    rows = {r.k: r for r in mixture.criteria(df, [1, 2, 3, 4], kind).collect()}
    assert min(rows, key=lambda k: rows[k].bic) == 3 and rows[3].best and not rows[1].best
    u = {r.id: r for r in mixture.posteriors(df, m).collect()}
    want, _ = m.posteriors(x)
    assert np.abs(np.array([u[i].u for i in range(len(x))]) - want).max() < 1e-12 and all(u[i].winner == want[i].argmax() for i in range(len(x)))


def test_odd_rows(spark):
    rows = [(0, None), (1, []), (2, [float("nan"), 1.0]), (3, [None, 1.0]), *((k, [1.0, 2.0]) for k in range(4, 9))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, v array<double>, U string")
    _, best, _ = mixture.fitted(df, [2], "full")
    u = {r.id: r.u for r in mixture.posteriors(df.drop("U"), best[2]).collect()}
    assert [u[k] for k in range(4)] == [None] * 4 and abs(sum(u[5]) - 1) < 1e-12
    assert mixture.fitted(df.where("id < 2"), [2])[1] == {} and mixture.criteria(df.where("id < 2"), [2]).count() == 0
