"""Shares, ragged lines and files whose bounds come from the data."""

from __future__ import annotations

import math

import pytest
from eventloom.operators import cohort, reports
from eventloom.sources import tables as T


def test_top_share_counts(spark):
    rows = [(k, None if k % 11 == 0 else float(k % 7)) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, x double")
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for f in (0.0, 5e-7, 1 / 3, 0.1, 0.5, 0.97, 1.0):
        got = {r.k for r in cohort.top_share(df, f, "x", "k").collect()}
        assert got == {k for k, _ in order[: math.ceil(f * 200)]}, f
    assert cohort.top_share(spark.range(3_000_000).selectExpr("id as k", "id % 10 as x"), 1 / 3, "x", "k").count() == 1_000_000


def test_ragged_lines_keep_all_cells(spark):
    lines = spark.createDataFrame([("f,1,2,3,4",), ("g",), ("h,5",)], "value string")
    t = T.ragged_wide(lines, ["file"])
    assert t.columns == ["file", "cell_1", "cell_2", "cell_3", "cell_4"]
    assert sorted(tuple(r) for r in t.collect()) == [("f", "1", "2", "3", "4"), ("g", None, None, None, None), ("h", "5", None, None, None)]
    with pytest.raises(ValueError, match="4 cells"):
        T.ragged_wide(lines, ["file"], 3)
    assert T.ragged_wide(lines.limit(0), ["file"]).columns == ["file"]


def test_nothing_is_left_beside_a_taken_place(spark, tmp_path):
    (tmp_path / "t").mkdir()
    with pytest.raises(FileExistsError):
        T.moved_into_place(spark.range(3), f"file://{tmp_path}/t")
    assert not (tmp_path / "t.tmp").exists()


def test_medians_of_many_columns(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, float("inf")), (5.0, None, 4.0)], "a double, b double, c double")
    assert sorted(tuple(r) for r in reports.median_filled(df, ["a", "b", "c"]).collect()) == [(1.0, 3.0), (3.0, 3.5), (5.0, 4.0)]
