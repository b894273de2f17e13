"""History and overlap by running sums, against pairs."""

from __future__ import annotations

import random
import time

from eventloom.operators import intervals
from pyspark.sql import functions as F

SCHEMA = "clip string, call_id long, label string, start_s double, end_s double, focal boolean"


def some(seed: int, n: int = 260) -> list:
    """Whole times, so that many bounds are equal; points, copies, null labels and clips."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        a = float(rng.randint(0, 60))
        out.append((rng.choice(["a", "a", "b", None]), k, rng.choice(["x", "y", "z", None]), a, a + rng.choice([0, 0, 1, 2, 5, 30]), rng.random() < 0.5))
    return [*out, ("c", n, "x", 5.0, 1.0, True), ("c", n + 1, "x", None, 2.0, True), ("d", n + 2, "x", 1.0, 2.0, True)]


def test_history_is_that_of_pairs(spark):
    rows = some(1)
    df = spark.createDataFrame(rows, SCHEMA).where("start_s <= end_s or clip = 'c'")
    for bucket in (None, 7.0):
        got = {(r.call_id, r.tau, r.side): tuple(r)[3:] for r in intervals.history(df.where("focal"), df, (1.0, 4.0, 100.0), bucket).collect()}
        for c, i, label, a, b, focal in rows:
            for tau in (1.0, 4.0, 100.0) if focal and a is not None and a <= b else ():
                for side in ("pre", "post"):
                    near = [r for r in rows if c is not None and r[0] == c and r[3] is not None and r[3] <= r[4] and 0 <= (a - r[4] if side == "pre" else r[3] - b) <= tau]
                    want = (len(near), sum(r[5] for r in near), sum(not r[5] for r in near), sum(label is not None and r[2] == label for r in near), len({r[2] for r in near} - {None}))
                    assert got[i, tau, side] == want, (i, tau, side)
    assert intervals.history(df.where("focal"), df.limit(0), (1.0,)).agg(F.sum("all_n")).first()[0] == 0


def union(spans: list, a: float, b: float) -> float:
    total, at = 0.0, a
    for x, y in sorted(spans):
        x, y = max(x, at), min(y, b)
        if y > x:
            total, at = total + y - x, y
    return total


def test_overlap_is_that_of_pairs(spark):
    rows = some(2)
    df = spark.createDataFrame(rows, SCHEMA)
    for every, bucket in ((rows, None), (rows, 7.0), ([r for r in rows if r[1] % 3], 9.0)):
        got = {r.call_id: tuple(r)[1:] for r in intervals.overlap_shares(df, spark.createDataFrame(every, SCHEMA), bucket).collect()}
        assert len(got) == len(rows)
        for c, i, _, a, b, _ in rows:
            fine = c is not None and a is not None and a <= b
            hits = [r for r in every if fine and r[0] == c and r[1] != i and r[3] is not None and r[3] <= r[4] and r[3] < b and r[4] > a]
            length = (b - a) if fine else 0
            share = lambda h: union([(r[3], r[4]) for r in h], a, b) / length if length else 0.0
            assert got[i][0] == len(hits), i
            assert abs(got[i][1] - share(hits)) < 1e-9 and abs(got[i][2] - share([r for r in hits if not r[5]])) < 1e-9, i


def test_a_dense_clip_takes_linear_work(spark):
    """All pairs of one clip with 300,000 rows would be 9 * 10^10."""
    df = spark.range(300_000).select(F.lit("a").alias("clip"), F.col("id").alias("call_id"), F.concat(F.lit("l"), (F.col("id") % 3).cast("string")).alias("label"), (F.col("id") / 10).alias("start_s"), (F.col("id") / 10 + 5000).alias("end_s"), (F.col("id") % 2 == 0).alias("focal"))
    began = time.time()
    r = intervals.history(df.where("focal"), df, (20_000.0,)).where("side = 'post' and call_id = 1000").first()
    assert r.all_n == 200_001 and r.labels_n == 3
    o = intervals.overlap_shares(df.where("focal"), df).where("call_id = 100000").first()
    assert o.n_overlaps == 99_998 and abs(o.overlap_fraction - 1) < 1e-9
    assert time.time() - began < 240
