"""Many logistic fits at once against a plain solver, one fit at a time."""

from __future__ import annotations

import numpy as np
import pytest
from eventloom.operators import cohort, models, newton, partials
from eventloom.operators.newton import Fit
from pyspark.sql import functions as F


def plain(z: np.ndarray, y: np.ndarray, c: float, classes: int = 2, weight: np.ndarray | None = None) -> np.ndarray:
    """Coefficients (columns by class) by Newton's method on the whole matrix; column 0 is the free intercept."""
    k, d = classes, z.shape[1]
    w = np.zeros((d, k))
    weight = np.ones(len(y)) if weight is None else weight
    penal = np.ones((d, k))
    penal[0] = 0
    two = 2.0 if k == 2 else 1.0  # one vector for two classes is twice each of a softmax's pair
    for _ in range(200):
        e = z @ w
        p = np.exp(e - e.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = c * z.T @ (weight[:, None] * (p - np.eye(k)[y])) + two * penal * w
        h = np.zeros((k * d, k * d))
        for a in range(k):
            for b in range(k):
                h[a * d : (a + 1) * d, b * d : (b + 1) * d] = c * (z * (weight * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ z
        h += np.diag(two * penal.T.ravel())
        step = np.linalg.lstsq(h, g.T.ravel(), rcond=1e-13)[0].reshape(k, d).T
        w = w - step
        if np.abs(step).max() < 1e-13:
            break
    return w[:, 1:] - w[:, :1] if k == 2 else w


def table(seed: int, n: int = 240):
    rng = np.random.default_rng(seed)
    a, b, c = rng.standard_normal((3, n)) * [[1.0], [40.0], [0.01]] + [[0], [300], [5]]
    b[rng.random(n) < 0.15] = np.nan
    kind = rng.integers(0, 4, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(a + (kind == 1) - 0.5)))).astype(int)
    three = np.clip((a + rng.standard_normal(n)).round().astype(int) + 1, 0, 2)
    return [(i, float(a[i]), None if np.isnan(b[i]) else float(b[i]), float(c[i]), 7.0, None, f"k{kind[i]}" if kind[i] else None, int(y[i]), int(three[i]), i // 3 % 4 + 1, f"c{i // 3}") for i in range(n)]


SCHEMA = "call_id long, a double, b double, c double, flat double, none double, kind string, y int, three int, fold int, clip string"


def matrix(rows: list, train: list, columns: list[int], hot: bool) -> np.ndarray:
    """Imputed, scaled and one-hot by what the training rows teach."""
    out = [np.ones(len(rows))]
    for k in columns:
        x = np.array([np.nan if r[k] is None else r[k] for r in rows], float)
        t = np.array([np.nan if r[k] is None else r[k] for r in train], float)
        m = np.nan if np.isnan(t).all() else np.nanmedian(t)
        x, t = np.where(np.isnan(x), m, x), np.where(np.isnan(t), m, t)
        out.append(np.zeros(len(rows)) if np.isnan(m) else (x - t.mean()) / (t.std() if t.std() > 1e-12 else 1.0))
    for level in ("k1", "k2", "k3") if hot else ():
        out.append(np.array([float(r[6] == level) for r in rows]))
    return np.array(out).T


def test_coefficients_and_predictions(spark):
    rows = table(1)
    df, folds, _ = models.fold_sets(spark.createDataFrame(rows, SCHEMA).repartition(5))
    fits = [Fit(f"{f}|{c}", f"train{f}", f"test{f}", "y", ("a", "b", "flat", "none"), ("kind",), c) for f in folds for c in (0.01, 1.0, 100.0)]
    fits += [Fit(f"three|{f}", f"train{f}", f"test{f}", "three", ("a", "c"), balanced=True, classes=3) for f in folds]
    got = newton.solve(df, fits, ["call_id"])
    assert got.passes < 30
    seen = {}
    for r in got.predictions().collect():
        seen[r.model, r.call_id] = np.array(r.p)
    for f in folds:
        train, test = [r for r in rows if r[9] != f], [r for r in rows if r[9] == f]
        z, y = matrix(train, train, [1, 2, 4, 5], True), np.array([r[7] for r in train])
        for c in (0.01, 1.0, 100.0):
            want = plain(z, y, c)
            assert np.abs(got.weights[f"{f}|{c}"] - want).max() < 1e-8
            p = 1 / (1 + np.exp(-matrix(test, train, [1, 2, 4, 5], True) @ want))[:, 0]
            assert np.abs([seen[f"{f}|{c}", r[0]][1] for r in test] - p).max() < 1e-9
        y = np.array([r[8] for r in train])
        n = np.bincount(y)
        want = plain(matrix(train, train, [1, 3], False), y, 1.0, 3, (len(y) / (3 * n))[y])
        mine = got.weights[f"three|{f}"]
        assert np.abs(mine[1:] - want[1:]).max() < 1e-8 and np.abs(np.diff(mine[0] - want[0])).max() < 1e-8
    assert len(seen) == 4 * len(rows)
    names = {r.name for r in got.coefficients().where("model = '1|1.0'").collect()}
    assert names == {"", "a", "b", "flat", "none", "kind=k1", "kind=k2", "kind=k3"}
    got.close()


def test_principal_axes(spark):
    rows = table(2)
    df = spark.createDataFrame(rows, SCHEMA)
    out = models.arms_cv(df, {"m": ["a"]}, [], axes={"m": (("a", "b", "c"), 2)})
    p = {r.call_id: r.m for r in out.collect()}
    for f in range(1, 5):
        train, test = [r for r in rows if r[9] != f], [r for r in rows if r[9] == f]
        block = matrix(train, train, [1, 2, 3], False)[:, 1:]
        axes = np.linalg.svd(block, full_matrices=False)[2][:2].T
        z = np.c_[matrix(train, train, [1], False), block @ axes]
        w = plain(z, np.array([r[7] for r in train]), 1.0)
        t = np.c_[matrix(test, train, [1], False), matrix(test, train, [1, 2, 3], False)[:, 1:] @ axes]
        assert np.abs(1 / (1 + np.exp(-t @ w))[:, 0] - [p[r[0]] for r in test]).max() < 1e-8


def test_nested_choice_is_the_loops(spark):
    rows = table(3, 180)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("z", (F.col("call_id") % 7 == 0).cast("int"))
    arms, cs = {"m0": ["b"], "m1": ["a", "b"]}, (1.0, 0.1, 10.0)
    scores, choices, out = models.nested_cv(df, "clip", arms, ["y", "z"], ["kind"], cs)
    assert scores.count() == 2 * 2 * 4 * 3 * 3
    inner = {(r.outer_fold, r.clip): r.inner_fold for r in cohort.nested_folds(df.select("clip", "fold").distinct(), df, "clip", 3).collect()}
    at = {"m0": [2], "m1": [1, 2]}
    held = {r.call_id: r for r in out.collect()}
    picked = {(r.target, r.arm, r.fold): (r.c, r.loss) for r in choices.collect()}
    for target in ("y", "z"):
        truth = lambda t, target=target: np.array([r[7] if target == "y" else int(r[0] % 7 == 0) for r in t])
        for arm, columns in at.items():
            for f in range(1, 5):
                outside, test = [r for r in rows if r[9] != f], [r for r in rows if r[9] == f]
                loss = {}
                for c in cs:
                    total = 0.0
                    for i in (1, 2, 3):
                        a, b = ([r for r in outside if (inner[f, r[10]] == i) == side] for side in (False, True))
                        w = plain(matrix(a, a, columns, True), truth(a), c)
                        e = (matrix(b, a, columns, True) @ w)[:, 0]
                        total += (np.logaddexp(0, e) - truth(b) * e).sum()
                    loss[c] = total / len(outside)
                best = min(cs, key=lambda c: loss[c])
                assert picked[target, arm, f][0] == best and abs(picked[target, arm, f][1] - loss[best]) < 1e-9
                w = plain(matrix(outside, outside, columns, True), truth(outside), best)
                p = 1 / (1 + np.exp(-(matrix(test, outside, columns, True) @ w)[:, 0]))
                assert np.abs(p - [held[r[0]][f"{target}_{arm}"] for r in test]).max() < 1e-8


def test_populations_and_probe(spark):
    rows = table(4)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("valid", F.when(F.col("call_id") % 5 != 0, F.col("call_id") % 5 != 1))
    out = {r.call_id: r for r in models.populations_cv(df, ["b"], ["a"], ["kind"]).collect()}
    ok = lambda r: r[0] % 5 > 1
    for f in range(1, 5):
        for name, keep in (("full", lambda r: True), ("valid", ok)):
            train, test = [r for r in rows if r[9] != f and keep(r)], [r for r in rows if r[9] == f]
            w = plain(matrix(train, train, [2, 1], True), np.array([r[7] for r in train]), 1.0)
            p = 1 / (1 + np.exp(-(matrix(test, train, [2, 1], True) @ w)[:, 0]))
            for r, x in zip(test, p, strict=True):
                mine = out[r[0]][f"{name}_m1"]
                assert abs(mine - x) < 1e-8 if keep(r) else mine is None
    guess = models.probe_cv(df.withColumnRenamed("y", "two").withColumnRenamed("three", "y"), ["a", "c"], 3).collect()
    assert len(guess) == len(rows) and np.mean([r.guess == r.y for r in guess]) > 0.5


def test_odd_tables(spark):
    df, _, _ = models.fold_sets(spark.createDataFrame([(k, float(k), None, 1.0, 1.0, None, None, 1, 0, k % 2 + 1, "c") for k in range(9)], SCHEMA))
    fit = Fit("m", "train1", "test1", "y", ("a", "b"), ("kind",))
    with pytest.raises(ValueError, match="one class only"):
        newton.solve(df, [fit])
    p = [r.p[1] for r in newton.solve(df, [fit], ["call_id"], one_class="rate").predictions().collect()]
    assert len(p) == 5 and min(p) > 1 - 1e-12
    with pytest.raises(ValueError, match="not to be used"):
        Fit("m", "t", "t", "y", ("fold",))
    with pytest.raises(ValueError, match="names of their own"):
        newton.solve(df, [fit, fit])
    assert models.arms_cv(spark.createDataFrame([], SCHEMA), {"m": ["a"]}, []).count() == 0


def test_sums_of_many_tasks(spark, monkeypatch):
    rows = table(6)
    monkeypatch.setattr(partials, "FAN_IN", 2)
    monkeypatch.setattr(newton, "written", lambda df, name: df.repartition(11, "keep0").cache())
    df = spark.createDataFrame(rows, SCHEMA).withColumn("all", F.lit(True))
    got = newton.solve(df, [Fit("m", "all", "all", "y", ("a",))], ["call_id"])
    want = plain(matrix(rows, rows, [1], False), np.array([r[7] for r in rows]), 1.0)
    assert np.abs(got.weights["m"] - want).max() < 1e-8
