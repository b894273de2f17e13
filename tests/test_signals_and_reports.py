"""Signal expressions, report tables and fuzzy c-means on small tables with known results."""

from __future__ import annotations

import numpy as np
import pytest
from eventloom.functions import signals
from eventloom.operators import fuzzy, reports
from pyspark.sql import functions as F


def test_levels_of_null_empty_and_silent_arrays(spark):
    df = spark.createDataFrame([(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, -1.0]), (4, [3.0, 4.0, 0.0, 0.0])], "id long, v array<double>")
    got = {r["id"]: r["l"] for r in df.select("id", signals.levels(F.col("v")).alias("l")).collect()}
    assert got[0]["rms"] is None and got[1]["rms"] is None and got[1]["clipped"] is None
    assert got[2]["rms"] == 0 and got[2]["crest"] is None
    assert got[3]["clipped"] == 1 and got[3]["crest"] == 1
    assert got[4]["rms"] == 2.5 and got[4]["peak"] == 4


def test_stats_leave_out_what_is_not_finite(spark):
    df = spark.createDataFrame([([1.0, None, float("nan"), float("inf"), 3.0],), ([None],)], "v array<double>")
    got = [tuple(r["s"]) for r in df.select(signals.stats(F.col("v")).alias("s")).collect()]
    assert got == [(2.0, 1.0, 1.0, 3.0), (None, None, None, None)]


def test_levelled_is_limited_by_the_peak_and_leaves_silence(spark):
    df = spark.createDataFrame([(0, [0.5, -0.5]), (1, [1.0] + [0.0] * 99), (2, [0.0])], "id long, v array<double>")
    got = {r["id"]: r["l"] for r in df.select("id", signals.levelled(F.col("v"), -25.0).alias("l")).collect()}
    assert np.isclose(np.sqrt(np.mean(np.square(got[0]["samples"]))), 10 ** (-25 / 20)) and not got[0]["limited"]
    assert not got[1]["limited"] and max(got[1]["samples"]) <= 0.99
    assert got[2]["samples"] == [0.0] and got[2]["gain_db"] == 0
    loud = df.where("id = 1").select(signals.levelled(F.col("v"), -5.0).alias("l")).collect()[0]["l"]
    assert loud["limited"] and np.isclose(max(loud["samples"]), 0.99)


def test_support_plan_reads_nothing_after_the_call_and_cuts_none(spark):
    df = spark.createDataFrame([(0, 0.1, 0.2), (1, 2.0, 3.0), (2, 9.9, 10.2), (3, 1.0, 1.0)], "id long, a double, b double")
    got = {r["id"]: r["p"] for r in df.select("id", signals.support_plan(F.col("a"), F.col("b"), F.lit(100.0), F.lit(1000)).alias("p")).collect()}
    assert got[0].asDict() == {"window_start": -30, "window_end": 20, "source_start": 0, "source_end": 20, "left_pad": 30, "n_samples": 50, "focal_start": 40, "focal_end": 50}
    assert got[1]["window_start"] == 200 and got[1]["left_pad"] == 0
    assert got[2] is None and got[3] is None


@pytest.mark.parametrize("mode", signals.MODES)
def test_masked_standard_against_numpy(spark, mode):
    x = [float(k * k % 7) for k in range(30)]
    df = spark.createDataFrame([(x,)], "v array<double>").withColumn("p", signals.support_plan(F.lit(4.0), F.lit(10.0), F.lit(1.0), F.lit(30), 16_000.0))
    df = df.withColumn("w", signals.read_window(F.col("v"), F.col("p")))
    r = df.select("w", signals.masked_standard(F.col("w"), F.col("p"), mode).alias("s")).collect()[0]
    w = np.r_[np.zeros(6), x[:10]]
    assert r["w"] == w.tolist()
    ok = np.zeros(16, bool)
    ok[{"call_only": slice(10, 16), "past_context": slice(6, 16), "context_only": slice(6, 10)}[mode]] = True
    want = np.zeros(16)
    want[ok] = (w[ok] - w[ok].mean()) / w[ok].std()
    assert np.allclose(r["s"]["samples"], want) and np.isclose(r["s"]["masked"], 1 - ok.mean()) and r["s"]["informative"]


def test_pooled_frames(spark):
    df = spark.createDataFrame([([[1.0, 5.0], [3.0, 1.0], [8.0, 0.0]],)], "f array<array<double>>")
    span = signals.focal_frames(F.lit(0), F.lit(6), F.lit(9.0), F.lit(3))
    r = df.select(span.alias("s"), "f").select("s", signals.pooled(F.col("f"), F.col("s")).alias("a"), signals.pooled(F.col("f"), F.col("s"), "max").alias("m")).collect()[0]
    assert tuple(r["s"]) == (0, 2) and r["a"] == [2.0, 3.0] and r["m"] == [3.0, 5.0]


def test_fuzzy_fit_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 1, (40, 3)), rng.normal(4, 1, (40, 3))]
    start = [[0.0, 0.5, 0.0], [3.0, 3.0, 3.0]]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(99, None)], "id long, v array<double>")
    got, trace = fuzzy.fit(df, start, rounds=6, tolerance=0.0)
    c, objectives = np.array(start), []
    for _ in range(6):
        d = np.maximum(np.linalg.norm(x[:, None] - c[None], axis=2), 1e-12)
        u = d**-2.0 / (d**-2.0).sum(1, keepdims=True)
        objectives.append(float((u**2 * d**2).sum()))
        c = (u**2).T @ x / (u**2).sum(0)[:, None]
    assert np.allclose(got, c) and np.allclose([t["objective"] for t in trace], objectives)
    assert fuzzy.fit(df.where("false"), start)[0] == start


def test_oof_faults_are_found(spark):
    rows = [("a", "x", 1, "post", 1, 0.5, 0.5), ("a", "x", 1, "post", 1, 0.5, 0.5), ("a", "x", 2, "pre", 3, 1.5, 0.5), ("b", "y", 1, "pre", None, 0.1, None)]
    df = spark.createDataFrame(rows, "call_id string, clip string, fold int, target string, y int, m0 double, m1 double")
    assert {r["fault"]: r["n"] for r in reports.oof_faults(df).collect()} == {"repeated_keys": 1, "target_values": 2, "probabilities": 2, "clips_in_folds": 1, "one_sided_calls": 1}


def test_identifiers_by_path_and_median_of_columns_without_values(spark):
    got = reports.identified(spark.createDataFrame([("C:\\a\\k1.wav",), ("k1",), (None,), ("q",)], "value string"), spark.createDataFrame([("k1",)], "clip string"), spark.createDataFrame([("q", "k1")], "call_id string, clip string"))
    assert sorted((r["value"], r["how"]) for r in got.collect()) == [("C:\\a\\k1.wav", "path"), ("k1", "clip"), ("q", "call")]
    filled = reports.median_filled(spark.createDataFrame([(1.0, None), (None, None), (float("nan"), None), (4.0, None)], "a double, b double"), ["a", "b"])
    assert filled.columns == ["a"] and sorted(r["a"] for r in filled.collect()) == [1.0, 2.5, 2.5, 4.0]
