from __future__ import annotations

import random

import pytest
from eventloom.operators import intervals as I
from pyspark.sql import functions as F

EVENTS = "clip string, call_id long, label string, start_s double, end_s double, focal boolean"


def table(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def random_rows(seed, n=300):
    r = random.Random(seed)
    out = []
    for k in range(n):
        a = r.randrange(0, 60) * 0.5
        out.append((r.choice(["hot", "hot", "hot", "b", "c"]), k, r.choice("xyz"), a, a + r.choice([0, 0, 0.5, 1.0, 4.0]), r.random() < 0.5))
    return out


@pytest.mark.parametrize("bucket", [0.7, 3.0, 1e6])
def test_neighbours_against_brute_force(spark, bucket):
    rows = random_rows(1)
    got = {r.call_id: (r.next_start, r.prev_end) for r in I.neighbours(table(spark, rows), bucket).collect()}
    for c, k, _, a, b, focal in rows:
        if focal:
            other = [(x, y) for d, _, _, x, y, f in rows if d == c and not f]
            assert got[k] == (min((x for x, _ in other if x >= b), default=None), max((y for _, y in other if y <= a), default=None))


@pytest.mark.parametrize("bucket", [0.7, 5.0, 1e6])
def test_edges_against_brute_force(spark, bucket):
    rows = random_rows(2)
    got = {(r.call_i, r.call_j) for r in I.edges(table(spark, rows), ["label"], bucket).collect()}
    want = set()
    for clip in {r[0] for r in rows}:
        own = sorted((r[3], r[4], r[1]) for r in rows if r[0] == clip)
        want |= {(x[2], y[2]) for x, y in zip(own, own[1:], strict=False)}
    assert got == want


@pytest.mark.parametrize("bucket", [0.7, 5.0, 1e6])
def test_history_against_brute_force(spark, bucket):
    rows = random_rows(3, 120)
    t = table(spark, rows)
    got = {(r.call_id, r.tau, r.side): (r.all_n, r.focal_n, r.nonfocal_n, r.same_label_n, r.labels_n) for r in I.history(t.where("focal"), t, (1.0, 3.0), bucket).collect()}
    for c, k, label, a, b, focal in rows:
        for tau in (1.0, 3.0) if focal else ():
            for side, inside in (("pre", lambda x, y: a - tau <= y <= a), ("post", lambda x, y: b <= x <= b + tau)):
                own = [(lab, f) for d, _, lab, x, y, f in rows if d == c and inside(x, y)]
                assert got[k, tau, side] == (len(own), sum(f for _, f in own), sum(not f for _, f in own), sum(lab == label for lab, _ in own), len({lab for lab, _ in own}))


@pytest.mark.parametrize("bucket", [0.7, 1e6])
def test_union_length(spark, bucket):
    t = table(spark, [("a", 1, "x", 1.0, 2.0, True), ("a", 2, "x", 1.5, 2.5, True), ("a", 3, "x", 3.0, 4.0, True), ("b", 4, "x", 5.0, 5.0, True)])
    assert {r.clip: round(r.covered, 9) for r in I.union_length(t, bucket=bucket).collect()} == {"a": 2.5, "b": 0.0}


def test_overlap_shares(spark):
    t = table(spark, [("c", 1, "cc", 1.0, 2.0, True), ("c", 2, "sn", 1.5, 9.0, False), ("c", 3, "sn", 2.0, 3.0, True), ("d", 4, "cc", 1.0, 2.0, True)])
    got = {r.call_id: (r.n_overlaps, r.overlap_fraction, r.nonfocal_fraction) for r in I.overlap_shares(t.where("focal"), t).collect()}
    assert got == {1: (1, 0.5, 0.5), 3: (1, 1.0, 1.0), 4: (0, 0.0, 0.0)}


def test_mapping_rules(spark):
    notes = table(spark, [("c", 10, "n", 0.0, 4.0, True), ("c", 11, "n", 3.0, 10.0, True), ("c", 12, "n", 20.0, 21.0, True), ("e", 13, "n", 0.0, 1.0, True)])
    segments = table(spark, [("c", 1, "s", 1.0, 2.0, True), ("c", 2, "s", 3.0, 4.0, True), ("c", 3, "s", 12.0, 13.0, True), ("c", 4, "s", 15.0, 25.0, True), ("c", 5, "s", 9.0, 12.0, True), ("z", 6, "s", 0.0, 1.0, True)])
    got = {r.call_id: (r.n_hits, r.status, r.best_id, round(r.best_overlap, 9)) for r in I.mapped(segments, notes).collect()}
    # 4: by its centre alone; 5: below one half and without centre; 2: a tie goes to the smaller id
    assert got == {1: (1, "unique", 10, 1.0), 2: (2, "multiple", 10, 1.0), 3: (0, "zero", None, 0.0), 4: (1, "unique", 12, 0.1), 5: (0, "zero", None, 0.0)}


def test_censoring_and_ties(spark):
    t = table(spark, [("c", 1, "x", 2.0, 3.0, True), ("c", 2, "y", 3.0, 3.5, False), ("c", 3, "y", 0.5, 2.0, False), ("c", 4, "x", 9.5, 9.9, True)])
    o = {(r.call_id, r.tau): (r.post_censored, r.pre_censored, r.nf_post, r.nf_pre) for r in I.outcomes(I.neighbours(t), [0.4, 2.0], 10.0).collect()}
    assert o[1, 0.4] == (False, False, True, True)  # equal times count
    assert o[4, 0.4] == (True, False, False, False)
    assert o[1, 2.0] == (False, False, True, True)
    assert o[4, 2.0][0] and not o[4, 2.0][2]
    rates = {(r.label, r.tau): r for r in I.rates(I.outcomes(I.neighbours(t), [0.4], 10.0)).collect()}
    assert rates["x", 0.4].post_rate == 1.0 and rates["x", 0.4].pre_rate == 0.5


def test_nulls_and_empty(spark):
    t = table(spark, [(None, 1, "x", 1.0, 2.0, True), (None, 2, "x", 3.0, 4.0, False), ("c", 3, "x", None, None, True), ("c", 4, "x", 1.0, 2.0, False)])
    assert {r.call_id: (r.next_start, r.prev_end) for r in I.neighbours(t).collect()} == {1: (None, None), 3: (None, None)}
    none = t.limit(0)
    for out in (I.neighbours(none), I.edges(none, []), I.union_length(none), I.history(none, none, [1.0]), I.overlap_shares(none, none), I.mapped(none, none)):
        assert out.count() == 0


def test_duplicate_ids_do_not_cross_clips(spark):
    t = table(spark, [("a", 1, "x", 0.0, 1.0, True), ("b", 2, "y", 1.0, 2.0, False)])
    assert [r.next_start for r in I.neighbours(t).collect()] == [None]
    assert t.select(F.count("*")).first()[0] == 2
