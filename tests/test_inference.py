from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from eventloom.operators import cohort, inference, models, ranks
from eventloom.sources import tables as T
from pyspark.sql import functions as F


def test_quantiles_of_any_group(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(x)) for x in rng.integers(0, 50, 500)] + [("b", float(x)) for x in rng.standard_normal(997)] + [("c", 2.5), (None, 1.0), (None, 4.0), ("d", None), ("b", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    points = {"low": 0.05, "mid": 0.5, "high": 0.95, "end": 1.0, "start": 0.0}
    got = {r.g: r for r in ranks.quantiles(df, ["g"], "x", points).collect()}
    by = {g: [x for k, x in rows if k == g and x is not None] for g in ("a", "b", "c", None)}
    assert set(got) == set(by)
    for g, own in by.items():
        for name, p in points.items():
            assert math.isclose(got[g][name], float(np.quantile(own, p)), rel_tol=1e-12, abs_tol=1e-12)
    whole = ranks.quantiles(df, [], "x", {"mid": 0.5}).first()
    assert math.isclose(whole.mid, float(np.median([x for _, x in rows if x is not None])))
    empty = ranks.quantiles(df.limit(0), [], "x", {"mid": 0.5}).collect()
    assert [r.mid for r in empty] in ([], [None])
    back = ranks.with_quantiles(df.groupBy("g").agg(F.count("*").alias("n")), df, ["g"], "x", {"mid": 0.5})
    assert {r.g: r.mid for r in back.collect()}["d"] is None and back.count() == 5


def test_ranks_in_parts_are_those_of_one_window(spark):
    from eventloom.functions.scalars import seeded
    from pyspark.sql import Window

    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"))
    one = F.row_number().over(Window.partitionBy("g").orderBy(seeded(4, F.col("id")), "id"))
    want = {r.id: (r.rank, r.n) for r in df.select("id", one.alias("rank"), F.count("*").over(Window.partitionBy("g")).alias("n")).collect()}
    got = {r.id: (r.rank__, r.size__) for r in ranks.ranked(df, ["g"], "id", 4).collect()}
    assert got == want
    run = ranks.running(df.withColumn("one", F.lit(2)), ["g"], "id", "one", descending=True).where("g = 'hot'").orderBy("id").collect()
    assert [(r.from__, r.upto__, r.all__) for r in run[-2:]] == [(2, 4, 2000), (0, 2, 2000)]


def test_assignment_against_all_permutations():
    rng = np.random.default_rng(2)
    for _ in range(150):
        n, m = rng.integers(1, 6, 2)
        gain = rng.integers(0, 12, (n, m))
        pairs = inference.assignment(gain)
        assert len(pairs) == min(n, m) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
        small, large = (gain, m) if n <= m else (gain.T, n)
        best = max(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(int(large)), int(min(n, m))))
        assert sum(gain[i, j] for i, j in pairs) == best
    assert inference.assignment([]) == []


def test_weights_of_a_draw_add_up(spark):
    df = spark.range(200).select((F.col("id") % 37).cast("string").alias("clip"))
    w = inference.clip_weights(df, 300, seed=3)
    sums = w.groupBy("draw").agg(F.sum("w").alias("s"), F.count("*").alias("n")).collect()
    assert len(sums) == 300 and all(r.s == 37 for r in sums)
    assert abs(np.mean([r.n for r in sums]) / 37 - (1 - (1 - 1 / 37) ** 37)) < 0.01
    assert sorted(map(tuple, w.collect())) == sorted(map(tuple, inference.clip_weights(df, 300, seed=3).collect()))
    one = {r.clip: r.w for r in w.where("draw = 5").collect()}
    many = [r.w for r in w.collect()]
    assert set(one) <= {str(k) for k in range(37)} and abs(np.var([*many, *[0] * (300 * 37 - len(many))]) - (1 - 1 / 37)) < 0.08


def test_intercept_and_generated_rates(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), f"c{k % 40}", float(a), float(b)) for k, (a, b) in enumerate(rng.standard_normal((2000, 2)))]
    df = spark.createDataFrame(rows, "call_id long, clip string, a double, b double")
    at = inference.intercept(df, "a", 0.2)
    a = np.array([r[2] for r in rows])
    assert abs((1 / (1 + np.exp(-(a + at)))).mean() - 0.2) < 1e-6
    g = inference.generated(df, "a", "b", {"post": 0.3}, seed=2).toPandas()
    for name, part in g.groupby("scenario"):
        assert len(part) == 2000 and abs(part.p.mean() - 0.3) < 1e-6 and abs(part.y.mean() - 0.3) < 0.04
        linear = inference.SCENARIOS[name][0]
        corr = np.corrcoef(part.a, np.log(part.p / (1 - part.p)))[0, 1]
        assert corr > 0.5 if name == "linear" else abs(corr) < 0.25 or linear > 0
    state = g[g.scenario == "null"].assign(s=lambda t: np.log(t.p / (1 - t.p)).round(9)).groupby("clip").s.nunique()
    assert (state == 1).all()  # a clip's rows share their state
    again = inference.generated(df.repartition(7), "a", "b", {"post": 0.3}, seed=2)
    assert sorted(map(tuple, again.select("call_id", "scenario", "y").collect())) == sorted(zip(g.call_id, g.scenario, g.y, strict=True))
    pair = {r.target: r.c for r in inference.one_sided(df, "a", "b", 0.25).groupBy("target").agg(F.corr("a", "p").alias("c")).collect()}
    assert abs(pair["post"]) < 0.2 and pair["pre"] > 0.6


def test_one_hot_has_no_limit_of_levels(spark):
    df = spark.range(1500).select(F.concat(F.lit("k"), (F.col("id") % 700).cast("string")).alias("kind"), (F.col("id") % 2).alias("y"), F.when(F.col("id") % 5 != 0, F.col("id").cast("double")).alias("x"), F.lit(None).cast("double").alias("none"))
    d = models.Design(df, ["x", "none"], ["kind"])
    assert len(d.state()["levels"]["kind"]) == 700 and list(d.state()["median"]) == ["x"]
    unseen = df.limit(1).withColumn("kind", F.lit("new")).unionByName(df.limit(1).withColumn("kind", F.lit(None).cast("string")))
    got = [r.features for r in d.applied(unseen).collect()]
    assert all(v.size == 701 and all(v[k] == 0 for k in range(1, 701)) for v in got)
    row = d.applied(df.where("kind = 'k123'").limit(1)).first().features
    assert sum(row[k] for k in range(1, 701)) == 1
    with pytest.raises(ValueError, match="not to be used"):
        models.Design(df, ["y"], [])


def test_boosted_trees_learn(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(x), int((x > -0.5 and x < 0.5) ^ (rng.random() < 0.05)), k % 2 + 1) for k, x in enumerate(rng.uniform(-1, 1, 600))]
    df = spark.createDataFrame(rows, "call_id long, x double, y int, fold int")
    trees = models.pooled(models.paired_cv(df.withColumn("flat", F.lit(1.0)), ["flat"], ["x"], [], trees=20)).first()
    assert trees.n == 600 and trees.loss1 < 0.45 < trees.loss0  # a band that no line finds


def test_splines_against_a_reference(spark):
    """The basis sums to one, is local, and repeats the end value beyond the ends."""
    df = spark.createDataFrame([(float(x),) for x in (-5, 0, 1, 24.9, 25, 50, 77.7, 100, 120)], "x double")
    rows = [list(r) for r in df.select("x", *(c.alias(f"s{k}") for k, c in enumerate(models.spline_columns(F.col("x"), 0.0, 100.0)))).collect()]
    for r in rows:
        assert len(r) == 8 and math.isclose(sum(r[1:]), 1.0) and sum(v > 1e-12 for v in r[1:]) <= 4
    by = {r[0]: r[1:] for r in rows}
    assert by[-5] == by[0] and by[120] == by[100]
    assert np.allclose(by[0][:3], [1 / 6, 4 / 6, 1 / 6]) and np.allclose(by[25][1:4], [1 / 6, 4 / 6, 1 / 6])


def test_nested_folds(spark):
    df = spark.range(900).select((F.col("id") * F.col("id") % 61).alias("user_id"))
    outer = cohort.group_folds(df, "user_id", 4)
    rows = cohort.nested_folds(outer, df, "user_id", 3).collect()
    fold = {r.user_id: r.fold for r in outer.collect()}
    for f in range(1, 5):
        inside = {r.user_id: r.inner_fold for r in rows if r.outer_fold == f}
        assert set(inside) == {u for u, k in fold.items() if k != f} and set(inside.values()) == {1, 2, 3}


def test_files_are_moved_into_place(spark, tmp_path):
    df = spark.range(5)
    T.moved_into_place(df, f"file://{tmp_path}/t")
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 5
    with pytest.raises(FileExistsError):
        T.moved_into_place(df, f"file://{tmp_path}/t")


def test_markdown_of_odd_numbers(spark):
    df = spark.createDataFrame([(1, 1234567.0, "a|b"), (2, 0.000123456789, None), (3, None, "x"), (4, 0.0, "y"), (5, float("nan"), "z")], "k int, x double, s string")
    text = [r.text for r in T.markdown(df, ["k"]).orderBy("line").collect()]
    assert text[0] == "| k | x | s |" and text[2].startswith("| 1 | 1234570.0 | a\\|b") and "1.23457E-4" in text[3] and text[4] == "| 3 |  | x |" and "| 0.0 |" in text[5] and text[6] == "| 5 |  | z |"


def test_ragged_cells_keep_their_digits(spark):
    df = spark.createDataFrame([("f,1,46.0, 2 ,5.0",), ("g",), ("h,1",), ("i,,3,4,5",)], "value string")
    assert [tuple(r) for r in T.ragged_pairs(df, ["file"]).orderBy("file", "ordinal").collect()] == [("f", 1, 1.0, 46.0), ("f", 2, 2.0, 5.0), ("i", 2, 4.0, 5.0)]
