from __future__ import annotations

import math

import pytest
from eventloom.functions import scalars as S
from eventloom.operators import audits, cohort, geometry, metrics, models
from eventloom.sources import tables as T
from pyspark.sql import functions as F


def test_ragged_lines(spark):
    lines = spark.createDataFrame([("f1,t, 1,2,,,5,6",), ("f2,t,1",), ("f3",), ("f4,t,a,2,3,4,9",), (None,)], "value string")
    got = sorted((r.file, r.ordinal, r.start, r.end) for r in T.ragged_pairs(lines, ["file", "treatment"]).collect())
    assert got == [("f1", 1, 1.0, 2.0), ("f1", 3, 5.0, 6.0), ("f4", 2, 3.0, 4.0)]


def test_zipped_pads_with_null(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], ["a"])], "id int, x array<int>, y array<string>")
    assert [(r.position, r.x, r.y) for r in T.zipped(df, ["x", "y"], ["id"]).collect()] == [(0, 1, "a"), (1, 2, None), (2, 3, None)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1 + 0.2, "x"), (2, None, "")], "a int, b double, c string")
    df.coalesce(1).write.option("header", True).csv(str(tmp_path / "t"))
    typed = T.read_csv(spark, str(tmp_path / "t"), "a int, b double, c string")
    assert typed.where("a = 1").first().b == 0.1 + 0.2
    assert {r.b for r in T.read_csv(spark, str(tmp_path / "t"), raw=True).collect()} == {"0.30000000000000004", ""}


def test_roles_and_masks(spark):
    df = spark.createDataFrame([(1, 2.0, "x", 3)], "id int, mfcc_1 double, name string, rms_db int")
    assert T.resolve(["A ", "b"], ["a", "b"]) == "A " and T.resolve(["x"], ["y"], required=False) is None
    with pytest.raises(ValueError):
        T.resolve(["x"], ["x"], override="q")
    assert T.feature_columns(df, drop="^id$") == ["mfcc_1", "rms_db"]
    assert T.feature_columns(df, include="mfcc|rms", exclude="rms") == ["mfcc_1"]


def test_contracts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, call_id string")
    with pytest.raises(ValueError, match="no key"):
        T.joined_one(df, df, ["k"])
    with pytest.raises(ValueError, match="row-level"):
        T.export(df, str(tmp_path / "x"))
    T.export(df.groupBy("k").count(), str(tmp_path / "y"))


def test_scalars(spark):
    df = spark.createDataFrame([("3.0", "Yes", 1.0, 0), (None, None, float("nan"), 1), ("-7", "t", float("inf"), 1), ("a1", "no", 0.5, 0)], "i string, b string, x double, y int")
    rows = df.select(S.clean_id(F.col("i")).alias("i"), S.unsigned_id(F.col("i")).alias("u"), S.truth(F.col("b")).alias("w"), S.truth(F.col("b"), S.TRUE_SHORT).alias("s"), S.number(F.col("x")).alias("x")).collect()
    assert [tuple(r) for r in rows] == [("3", "3", True, False, 1.0), ("", "", False, False, None), ("-7", "7", True, False, None), ("a1", "a1", False, False, 0.5)]
    sizes = [4, 63, 64, 127, 128, 255, 256, 511, 512, 10000]
    shapes = [tuple(r.w) for r in spark.createDataFrame([(n,) for n in sizes], "n int").select(S.window_shape(F.col("n")).alias("w")).collect()]
    assert [s[0] for s in shapes] == [64, 64, 64, 64, 128, 128, 256, 256, 512, 512]
    assert [s[1] for s in shapes] == [s[0] // 4 for s in shapes] and [s[2] for s in shapes] == [16] * 4 + [32] * 6
    pair = spark.range(1).select(*(S.same_pair(*map(F.lit, p)) for p in (("a", "b", "b", "a"), ("a", "b", "a", "c"), ("", "b", "", "b")))).first()
    assert tuple(pair) == (True, False, False)
    assert [r[0] for r in spark.createDataFrame([(0.0,), (0.3,), (1.0,), (1.1,), (None,)], "x double").select(S.binned(F.col("x"), (0, 0.3, 1))).collect()] == [0, 1, 1, None, None]


def test_quotas_and_folds(spark):
    pool = spark.createDataFrame([(f"c{k}", "sn" if k < 10 else "cc") for k in range(15)], "call_id string, label string")
    got = cohort.quota_sample(pool, pool.where("call_id in ('c0','c1','c10','c11','c12')"), ["label"], "call_id")
    assert {r.label: r["count"] for r in got.groupBy("label").count().collect()} == {"sn": 2, "cc": 3}
    again = cohort.quota_sample(pool.repartition(7), pool.where("call_id in ('c0','c1','c10','c11','c12')"), ["label"], "call_id")
    assert sorted(r.call_id for r in got.collect()) == sorted(r.call_id for r in again.collect())
    with pytest.raises(ValueError, match="too small"):
        cohort.quota_sample(pool.where("label = 'cc'"), pool, ["label"], "call_id")
    rows = spark.range(1000).select((F.col("id") % 37 + F.col("id") % 5 * 100).alias("clip"))
    folds = cohort.group_folds(rows, "clip", 5)
    sizes = [r.n for r in folds.groupBy("fold").agg(F.sum("size").alias("n")).collect()]
    assert sum(sizes) == 1000 and max(sizes) - min(sizes) <= 20
    with pytest.raises(ValueError, match="both sides"):
        cohort.assert_disjoint(rows, rows.limit(1), "clip")
    inner = cohort.nested_folds(folds.select("clip", "fold"), rows, "clip")
    assert inner.join(folds, "clip").where("outer_fold = fold").count() == 0


def oof(spark):
    rows = [("post", str(k), "a" if k < 2 else "b", "x", 1, k % 2, 0.5, 0.3 if k % 2 == 0 else 0.7, k < 3) for k in range(4)]
    return spark.createDataFrame(rows, "target string, call_id string, clip string, label string, fold int, y int, m0 double, m1 double, valid boolean")


def test_metrics_by_hand(spark):
    t = oof(spark)
    r = metrics.losses(t, ["target"]).first()
    assert math.isclose(r.delta, math.log(2) + math.log(0.7)) and math.isclose(r.loss0, math.log(2))
    c = metrics.calibration(t, ["target"], "m0").first()
    assert math.isclose(c.brier, 0.25) and math.isclose(c.ece, 0) and c.wrong_n == 0
    assert tuple(metrics.ranking(t, ["target"], "m1").first())[1:] == (1.0, 1.0)
    assert tuple(metrics.ranking(t, ["target"], "m0").first())[1:] == (0.5, 0.5)
    assert metrics.ranking(t.where("y = 1"), ["target"], "m1").first().auc is None
    b = metrics.bootstrap(t, ["target"], draws=20).first()
    assert math.isclose(b.low, b.gain) and math.isclose(b.high, b.gain)  # every row gains the same
    totals = spark.createDataFrame([("t", "a", 1, 1.0), ("t", "b", 1, -1.0)], "target string, clip string, n long, gain_sum double")
    k = metrics.concentration(totals, [0.5]).first()
    assert k.top_share == 0.5 and k.delta_without == -1.0
    zero = totals.withColumn("gain_sum", F.lit(0.0))
    assert metrics.concentration(zero, [0.5]).first().top_share is None


def test_chosen_candidate_ties(spark):
    s = spark.createDataFrame([("t", c, n, x * n) for c, xs in ((1.0, (0.5, 0.1, 0.1)), (0.1, (0.4, 0.9, 0.9)), (10.0, (0.4, 0.9, 0.9))) for n, x in zip((100, 1, 1), xs, strict=True)], "target string, c double, n int, loss_sum double")
    assert metrics.chosen(s, ["target"], (1.0, 0.1, 10.0)).first().c == 0.1
    assert metrics.chosen(s.withColumn("loss_sum", F.lit(1.0)).withColumn("n", F.lit(1)), ["target"], (1.0, 0.1, 10.0)).first().c == 1.0


def test_poisson_weights_law(spark):
    w = metrics.poisson_weights(spark.range(100).select(F.col("id").alias("clip")), 100).agg(F.avg("w"), F.var_pop("w"), F.max("w")).first()
    assert abs(w[0] - 1) < 0.05 and abs(w[1] - 1) < 0.08 and w[2] < 12


def test_group_normalised_modes(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", 5.0)], "g string, x double")
    assert sorted(repr(r.x) for r in audits.group_normalised(df, "g", ["x"], True).collect()) == sorted(["-1.0", "1.0", "0.0", "0.0"])
    assert sorted(repr(r.x) for r in audits.group_normalised(df, "g", ["x"], False).collect()) == sorted(["-1.0", "1.0", "None", "0.0"])


def test_compared(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 5.0)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 1.5, 1.0), (3, 2.0, 5.0)], "k int, x double, y double")
    got = {r.name: (r.most, r.null_differs, r.lost) for r in audits.compared(a, b, ["k"], ["x", "y"]).collect()}
    assert got == {"x": (0.5, 2, 2), "y": (None, 3, 2)}


def test_models(spark):
    rows = [(k, f"c{k // 4}", "u" if k % 3 else "v", k % 3 + 1, int(k % 5 < 2), float(k % 5), None if k % 7 == 0 else float(k)) for k in range(120)]
    df = spark.createDataFrame(rows, "call_id int, clip string, label string, fold int, y int, a double, b double")
    r = models.pooled(models.paired_cv(df, ["b"], ["a"], ["label"])).first()
    assert r.n == 120 and r.delta > 0.2
    with pytest.raises(ValueError, match="not to be used"):
        models.Design(df, ["y"], [])


def test_vectors(spark):
    df = spark.createDataFrame([(1, "a", [0.0, 0.0]), (2, "a", [2.0, None]), (3, "b", [4.0, 4.0])], "id long, label string, v array<double>")
    z = {r.id: r.v for r in geometry.standardised(df).collect()}
    assert math.isclose(sum(v[0] for v in z.values()), 0, abs_tol=1e-12) and math.isclose(sum(v[1] ** 2 for v in z.values()), 3)
    whole = df.where("id <> 2")
    assert geometry.nearest(whole, whole, 1).count() == 2


def test_nearest_by_blocks(spark, monkeypatch):
    n = 20_500  # one line, more queries than one block
    df = spark.range(n).selectExpr("id", "array(CAST(id AS DOUBLE), 0D) AS v")
    got = {r.query_id: sorted(r.ids) for r in geometry.nearest(df, df, 2).groupBy("query_id").agg(F.collect_list("id").alias("ids")).collect()}
    assert got == {k: [1, 2] if k == 0 else [n - 3, n - 2] if k == n - 1 else [k - 1, k + 1] for k in range(n)}
    monkeypatch.setattr(geometry, "BLOCK", 50)
    rows = [(k, [float(k * 7 % 11), float(k * 5 % 13)]) for k in range(200)]  # many at equal distances
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = sorted((r.query_id, r["rank"], r.id) for r in geometry.nearest(df.where("id % 2 = 0"), df, 7).collect())
    want = [(q, k + 1, i) for q, v in rows if q % 2 == 0 for k, (_, i) in enumerate(sorted((round(math.dist(v, w), 9), i) for i, w in rows if i != q)[:7])]
    assert got == want
