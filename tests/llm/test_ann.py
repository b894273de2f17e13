from __future__ import annotations

import numpy as np
import pytest
from eventloom.llm import ann
from eventloom.llm.queries import op7_nearest_neighbours
from pyspark.sql import functions as F


def brute(rows, k=20):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], np.float64)
    out = {}
    for i in sorted({i for i in ids if i % 20 == 0}):
        q = x[ids.index(i)]
        ranked = sorted((-float(q @ v), j) for j, v in zip(ids, x, strict=True) if j != i)
        out[i] = [(j, -s) for s, j in ranked[:k]]
    return out


def recall(got, want):
    hit = total = 0
    for q, own in want.items():
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(own) + 1))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        last = own[-1][1]
        hit += sum(r.score >= last - 1e-12 for r in mine)
        total += len(own)
    return hit / total


def test_query_recall(spark, data):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{data}/sf0.1/embeddings.parquet").collect()]
    got = op7_nearest_neighbours(spark, f"{data}/sf0.1").collect()
    want = brute(rows)
    assert len(got) == sum(map(len, want.values()))
    assert recall(got, want) >= 0.9
    by = {i: np.array(v, np.float64) for i, v in rows}
    assert all(abs(r.score - float(by[r.query_id] @ by[r.vec_id])) < 1e-12 for r in got)


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.standard_normal(8).tolist(), "x") for k in range(1, 70)]
    rows += [(0, [1.0] * 8, "x"), (20, [1.0] * 8, "x"), (100, None, "x"), (120, [0.0] * 8, "x"), (140, [float("nan")] + [1.0] * 7, "x"), (160, [None] + [1.0] * 7, "x"), (180, [float("inf")] * 8, "x"), (200, [1.0] * 5, "x"), (220, [], "x"), (71, [1.0] * 8, "x"), (72, [1.0] * 8, "x")]
    rows = [r for r in rows if r[0] != 20 or r[1] == [1.0] * 8]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list string")
    got = ann.search(df, F.col("vec_id") % 20 == 0).collect()
    fine = [(i, v) for i, v, _ in rows if v and len(v) == 8 and all(y is not None and np.isfinite(y) for y in v) and any(v)]
    want = brute(fine)
    assert {r.query_id for r in got} == set(want) == {0, 20, 40, 60}
    assert recall(got, want) == 1.0
    tied = [r.vec_id for r in sorted((r for r in got if r.query_id == 0), key=lambda r: r["rank"]) if r.score == 8.0]
    assert tied == sorted(tied) and {20, 71, 72} <= set(tied)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    assert ann.search(df.limit(1), F.lit(True)).count() == 0


def test_blocks_of_hot_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(4)
    x = np.r_[np.tile(rng.standard_normal(16), (300, 1)) + 0.01 * rng.standard_normal((300, 16)), rng.standard_normal((300, 16))]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert recall(got, brute(rows)) >= 0.9


@pytest.mark.parametrize("rows", [20_000, 80_000])
def test_recall_without_clusters(spark, rows):
    x = np.random.default_rng(5).standard_normal((rows, 64))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    asked = np.arange(0, rows, rows // 100)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").repartition(8)
    got = ann.search(df, F.col("vec_id") % (rows // 100) == 0).toPandas().sort_values(["query_id", "rank"])
    assert got.groupby("query_id").size().eq(20).all() and got["query_id"].nunique() == len(asked)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    want = np.sort(score, axis=1)[:, -20]
    hit = got["score"].to_numpy().reshape(-1, 20) >= want[:, None] - 1e-12
    assert hit.mean() >= 0.97


@pytest.mark.parametrize("long", [1e9, 1e30, 1e200, 1e307])
def test_recall_beside_one_long_vector(spark, long):
    x = np.random.default_rng(6).standard_normal((3000, 32))
    x[7] = 0
    x[7, 0] = long
    rows = list(enumerate(x.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 20 == 0).collect()
    assert recall(got, brute(rows)) >= 0.97


def test_norms_of_all_sizes(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((4000, 16)) * 10.0 ** rng.uniform(-12, 12, (4000, 1))
    x[:50] *= 1e-290
    rows = list(enumerate(x.tolist()))
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert recall(got, brute(rows)) >= 0.97


def test_scores_beyond_doubles(spark):
    rows = [(k, [1e200 * (k + 1), 1.0]) for k in range(30)] + [(40, [-1e200, 2.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 21)) and all(r.score == np.inf for r in got)


def test_few_lists_are_opened_where_clusters_are(spark):
    rng = np.random.default_rng(8)
    middle = rng.standard_normal((200, 32))
    x = middle[rng.integers(0, 200, 20_000)] + 0.1 * rng.standard_normal((20_000, 32))
    assert ann.Index(x, 70, 20).probed < 30
