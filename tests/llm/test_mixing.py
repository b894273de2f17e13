from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
from eventloom.llm import mixing as M
from eventloom.llm.queries import op5_mixing


def shares(sizes: dict, weights=(5, 2, 1), share=1.5, most=2.0) -> dict:
    """Sharing again and again what is above a cap."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not full:
            return out | {s: left * w[s] / total for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def best_sum(lengths, counts, budget):
    """The largest sum of documents up to a budget, by trying one document after another."""
    reach = 1
    for n, c in zip(lengths, counts, strict=True):
        for _ in range(int(c)):
            reach |= reach << int(n)
    return (reach & (1 << int(budget) + 1) - 1).bit_length() - 1


def check(rows, texts):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in texts]
    sums = defaultdict(int)
    for (_, s, _), n in zip(texts, size, strict=True):
        sums[s] += n
    goal = shares(dict(sums))
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter((i, s, n) for (i, s, _), n in zip(texts, size, strict=True))
    took, each = defaultdict(int), defaultdict(Counter)
    for (_, s, _), n in zip(texts, size, strict=True):
        each[s][n] += 1
    for r in rows:
        assert r.source_size == sums[r.source] and abs(r.target - goal[r.source]) < 1e-6 * max(1, goal[r.source])
        assert r.taken == r.copies * r.size <= 2 * r.size
        took[r.source] += r.taken
    for s in sums:
        passes = int(goal[s] // sums[s]) if sums[s] else 0
        assert took[s] == passes * sums[s] + best_sum(each[s].keys(), each[s].values(), round(goal[s] - passes * sums[s])), (s, took[s], goal[s])


def test_query(spark, data):
    docs = [(d.doc_id, d.source, d.text) for d in spark.read.parquet(f"{data}/sf0.01/documents.parquet").collect()]
    rows = op5_mixing(spark, f"{data}/sf0.01").collect()
    check(rows, docs)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op5_mixing(spark, f"{data}/sf0.01").collect()))


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(k, s, "w " * int(rng.integers(1, 30))) for k in range(400) for s in ("a", "b", None, "", "=")]
    rows += [(7, "a", None), (8, "empty", ""), (8, "empty", None), (None, "a", "x y"), (9, "a", "z " * 50_000), (7, "a", "w"), (7, "a", "w")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "'x' AS size", "3 AS mix_key", "4 AS target")
    out = M.mix(df)
    assert "mix_key" in out.columns
    check(out.collect(), rows)  # one document is longer than what its source lacks
    assert M.mix(df.limit(0)).count() == 0
    kept = M.repeated(out, df.columns[:3])
    assert kept.count() == sum(r.copies for r in out.collect())


def test_budget_is_met_as_well_as_any_choice():
    rng = np.random.default_rng(2)
    for k in range(700):
        if k % 2:
            lengths, most = rng.choice(np.arange(1, 40), rng.integers(1, 7), replace=False), 5
        else:
            lengths, most = rng.choice(np.arange(int(rng.choice([1, 5000, 20_000])), int(rng.choice([20_050, 100_000]))), rng.integers(1, 6), replace=False), 8
        if k % 5 == 0:
            lengths = lengths * 6
        counts = rng.integers(1, most, len(lengths))
        budget = int(rng.integers(0, int((lengths * counts).sum()) + 5))
        take = M.fit(lengths, counts, budget)
        assert ((take >= 0) & (take <= counts)).all()
        assert int((take * lengths).sum()) == best_sum(lengths, counts, budget), (lengths, counts, budget)
    assert (M.fit(np.array([21_828, 84_060]), np.array([1, 2]), 86_404) == [0, 1]).all()


def test_large_budgets():
    rng = np.random.default_rng(3)
    lengths = np.arange(0, 3000)
    counts = rng.integers(0, 200_000, len(lengths))
    total = int((lengths * counts).sum())
    for budget in (total // 3, total - 1, total // 2 + 1):
        take = M.fit(lengths, counts, budget)
        assert int((take * lengths).sum()) == budget and (take <= counts).all()
        share = take[1000:] / np.maximum(counts[1000:], 1)  # the mix keeps the source's lengths
        assert np.median(np.abs(share - budget / total)) < 0.01
    two = M.fit(np.array([10_007, 10_009]), np.array([10**6, 10**6]), 10**9 + 1)
    assert int((two * [10_007, 10_009]).sum()) == 10**9 + 1  # only a wide window meets it
    even = M.fit(np.array([20_000, 40_002]), np.array([50, 50]), 777_777)
    assert int((even * [20_000, 40_002]).sum()) == best_sum([20_000, 40_002], [50, 50], 777_777)


def test_null_ids_and_repeats_take_part(spark):
    rows = [(None, "a", "x y " * (k % 7 + 1)) for k in range(300)] + [(1, "a", "same text")] * 40
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = M.mix(df).collect()
    check(out, rows)
    assert len(out) == len(rows)


def test_equal_ratios(spark):
    sizes = dict(zip("abcdef", (10, 100, 200, 10, 100, 200), strict=True))
    got = {r.source: r.target for r in M.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert all(abs(got[s] - t) < 1e-9 for s, t in {"a": 20, "b": 200, "c": 245, "d": 20, "e": 200, "f": 245}.items()), got
    rows = [(k, s, "w") for s, n in sizes.items() for k in range(n)]
    check(M.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect(), rows)
    whole = {"a": 50, "b": 20, "c": 10}  # sizes in the ratio of the weights
    got = {r.source: r.target for r in M.targets(spark.createDataFrame(list(whole.items()), "source string, source_size long")).collect()}
    assert all(abs(got[s] - 1.5 * n) < 1e-9 for s, n in whole.items()), got
