"""Greedy folds against a plain filling, group by group."""

from __future__ import annotations

import hashlib
import random

import pytest
from eventloom.operators import cohort


def plain(sizes: dict, k: int, seed: int) -> dict:
    load, out = [0] * k, {}
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], hashlib.sha256(f"{seed}|{x[0]}".encode()).hexdigest(), x[0])):
        f = load.index(min(load))
        out[g], load[f] = f + 1, load[f] + n
    return out


@pytest.mark.parametrize(("groups", "most", "k"), [(10_000, 40, 5), (60, 3000, 4), (3, 9, 5), (500, 1, 7)])
def test_same_as_plain(spark, groups, most, k):
    rng = random.Random(groups)
    sizes = {g: max(1, int(most * rng.random() ** 3)) for g in range(groups)}
    df = spark.createDataFrame(list(sizes.items()), "g long, n long").selectExpr("g", "explode(sequence(1, n)) as x")
    got = {r.g: (r.size, r.fold) for r in cohort.group_folds(df, "g", k, 3).collect()}
    want = plain(sizes, k, 3)
    assert {g: f for g, (_, f) in got.items()} == want and {g: n for g, (n, _) in got.items()} == sizes


def test_null_group_and_empty_table(spark):
    df = spark.createDataFrame([(None,)] * 3 + [("a",)] * 2 + [("b",)], "g string")
    assert {r.g: r.fold for r in cohort.group_folds(df, "g", 2).collect()} == {None: 1, "a": 2, "b": 2}
    assert cohort.group_folds(df.limit(0), "g", 2).count() == 0
