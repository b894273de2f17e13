"""Principal spaces against a singular value decomposition, and fitted queries against plain solvers on the same tables."""

from __future__ import annotations

import numpy as np
import pytest
from eventloom.operators import spaces
from eventloom.plans import model_queries, registry
from test_newton import plain


def table(n: int, d: int) -> np.ndarray:
    rng = np.random.default_rng(d)
    return rng.standard_normal((n, d)) * 0.9 ** np.arange(d) @ np.linalg.qr(rng.standard_normal((d, d)))[0] + rng.standard_normal(d)


@pytest.mark.parametrize(("n", "d", "dense"), [(200, 64, 1024), (200, 64, 8), (90, 1300, 1024)])
def test_same_as_svd(spark, monkeypatch, n, d, dense):
    monkeypatch.setattr(spaces, "DENSE", dense)
    x = table(n, d)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(3).cache()
    z = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    for k in (3, 10):
        got = spaces.fitted(df, k)
        assert got.n == n and np.abs(got.shares() - (s**2 / (s**2).sum())[:k]).max() < 1e-10
        assert np.abs(np.abs(np.sum(got.axes.T * vt[:k], axis=1)) - 1).max() < 1e-8
    out = {r.id: r.z for r in spaces.projected(df, got, 5).collect()}
    assert np.abs(np.array([out[i] for i in range(n)]) - z @ got.axes[:, :5]).max() < 1e-9


def test_odd_rows(spark):
    df = spark.createDataFrame([(0, None), (1, []), (2, [1.0, None]), (3, [1.0, 2.0]), (4, [1.0, 2.0])], "id long, v array<double>")
    s = spaces.fitted(df, 2)
    assert s.n == 2 and s.shares().tolist() == [0.0, 0.0]
    assert {r.id: r.z for r in spaces.projected(df, s).collect()} == {0: None, 1: None, 2: None, 3: [0.0, 0.0], 4: [0.0, 0.0]}
    assert spaces.fitted(df.where("id < 2")) is None and spaces.explained(df.where("id < 2"), 3).count() == 0


def test_space_queries_on_the_table(spark, data):
    d = f"{data}/sf0.001"
    x = np.array([list(r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()], float)
    z = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    got = {r.component: r.share for r in registry.QUERIES["mlt4_pca"](spark, d).collect()}
    assert np.abs([got[k + 1] - s[k] ** 2 / (s**2).sum() for k in range(10)]).max() < 1e-6
    for r in registry.QUERIES["mlt15_nested_spaces"](spark, d).collect():
        assert abs(r.share - (s[: r.axes] ** 2).sum() / (s**2).sum()) < 2e-6 and abs(r.length - (s[: r.axes] ** 2).sum() / len(x)) < 2e-6


def test_fit1_on_the_table(spark, data):
    """The registered query's losses from single fits of the rows that it reads."""
    from eventloom.operators import cohort

    d = f"{data}/sf0.001"
    x = model_queries._design(spark, d)
    folds = cohort.group_folds(x, "clip", 3).select("clip", "fold").collect()
    fold = {r.clip: r.fold for r in folds}
    rows = [r.asDict() for r in x.collect()]
    labels = sorted({r["label"] for r in rows if r["label"] is not None})
    loss = {}
    for arm, columns in (("m0", ["log_chars"]), ("m1", ["log_chars", "chars", "words"])):
        total = 0.0
        for f in set(fold.values()):
            train, test = [r for r in rows if fold[r["clip"]] != f], [r for r in rows if fold[r["clip"]] == f]
            block = []
            for part in (train, test):
                z = [np.ones(len(part))]
                for c in columns:
                    t = np.array([np.nan if r[c] is None else r[c] for r in train], float)
                    v = np.array([np.nan if r[c] is None else r[c] for r in part], float)
                    m = np.nanmedian(t)
                    t, v = np.where(np.isnan(t), m, t), np.where(np.isnan(v), m, v)
                    z.append((v - t.mean()) / (t.std() or 1.0))
                z += [np.array([float(r["label"] == level) for r in part]) for level in labels]
                block.append(np.array(z).T)
            y = [np.array([r["y"] for r in part]) for part in (train, test)]
            e = (block[1] @ plain(block[0], y[0], 1.0))[:, 0]
            total += (np.logaddexp(0, e) - y[1] * e).sum()
        loss[arm] = total / len(rows)
    got = registry.QUERIES["fit1_paired_grouped_cv"](spark, d).first()
    assert got.n == len(rows) and abs(got.loss0 - loss["m0"]) < 2e-6 and abs(got.loss1 - loss["m1"]) < 2e-6
