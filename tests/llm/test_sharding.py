from __future__ import annotations

import zlib
from collections import Counter

from eventloom.llm import sharding as S
from eventloom.llm.queries import op3_sharding
from pyspark.sql import functions as F


def placed(rows, n, shards=24):
    by = Counter(r.shard for r in rows)
    assert all(by.get(s, 0) - n // shards in (0, 1) for s in range(shards))
    assert sum(by.get(s, 0) == n // shards + 1 for s in range(shards)) == (n % shards if n // shards or n % shards else 0)
    for s, k in by.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(k))


def test_query(spark, data):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{data}/sf0.001/documents.parquet").collect()}
    rows = op3_sharding(spark, f"{data}/sf0.001").collect()
    placed(rows, len(docs))
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, op3_sharding(spark, f"{data}/sf0.001").collect()), key=repr)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a", 9), (1, "a", 9), (None, None, 9), (2, "", 9), (3, "é" * 70_000, 9)] * 11, "doc_id long, text string, shard int")
    out = S.shuffle(df).collect()
    placed(out, 55)
    assert Counter((r.doc_id, r.size) for r in out) == Counter({(1, 9): 22, (None, 8): 11, (2, 8): 11, (3, 140_008): 11})
    assert S.shuffle(df.limit(0)).count() == 0
    placed(S.shuffle(df.limit(1)).collect(), 1)


def test_many_blocks_and_cells(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    rows = S.shuffle(df, rows_per_cell=20).collect()
    placed(rows, 5000)
    assert len({r.doc_id for r in rows}) == 5000


def test_draws_have_the_hypergeometric_law(spark):
    import math

    good, bad, n, trials = 7, 12, 9, 20_000
    got = spark.range(trials).select(S.hypergeometric(F.lit(good), F.lit(bad), F.lit(n), S._uniform("id", F.lit(3))).alias("k")).groupBy("k").count().collect()
    chi = 0.0
    seen = {r.k: r["count"] for r in got}
    for k in range(0, 8):
        p = math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n)
        chi += (seen.get(k, 0) - trials * p) ** 2 / (trials * p)
    assert set(seen) <= set(range(8)) and chi < 30


def test_large_draws_stay_within_their_support(spark):
    row = spark.range(50).select(S.hypergeometric(F.lit(3_000_000), F.lit(1_000_000), F.lit(400_000), S._uniform("id")).alias("k")).agg(F.min("k"), F.max("k"), F.avg("k")).first()
    assert 297_000 < row[0] <= row[2] <= row[1] < 303_000
    edges = spark.range(1).select(S.hypergeometric(F.lit(0), F.lit(5), F.lit(3), F.lit(0.5)), S.hypergeometric(F.lit(5), F.lit(0), F.lit(3), F.lit(0.5)), S.hypergeometric(F.lit(5), F.lit(4), F.lit(9), F.lit(0.5)), S.hypergeometric(F.lit(5), F.lit(4), F.lit(0), F.lit(0.5))).first()
    assert tuple(edges) == (0, 3, 5, 0)


def test_every_shard_is_as_likely(spark):
    df = spark.range(240).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    seen = Counter()
    for seed in range(4):
        for r in S.shuffle(df, seed=seed * 10).collect():
            seen[r.doc_id // 80, r.shard // 8] += 1
    assert all(60 < seen[a, b] < 150 for a in range(3) for b in range(3))


def test_clashing_names(spark):
    names = ["inner", "outer", "block", "rank", "cell", "place", "id", "own0", "own1", "counts", "node", "n", "size", "SLOT"]
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), *(F.lit(k).alias(f"x{k}") for k in range(len(names)))).toDF("doc_id", "text", *names)
    out = S.shuffle(df)
    assert out.columns == ["doc_id", "text", *names[:-2], "size", "text_crc32", "shard", "slot"]
    rows = out.toDF(*[f"c{k}" for k in range(len(out.columns))]).collect()
    assert len(rows) == 50 and all(r.c2 == 0 and r.c3 == 1 for r in rows)
    assert len({(r[-2], r[-1]) for r in rows}) == 50


def test_equal_rows_are_shuffled_too(spark):
    n, shards = 10_000, 24
    df = spark.range(2 * n).select(F.when(F.col("id") % 2 == 0, F.lit(-7)).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    rows = S.shuffle(df).collect()
    placed(rows, 2 * n)
    equal = [r for r in rows if r.doc_id == -7]
    assert len(equal) == n
    by_shard, by_slot = Counter(r.shard for r in equal), Counter(r.slot * 20 // 834 for r in equal)
    chi = sum((by_shard[s] - n / shards) ** 2 / (n / shards) for s in range(shards))
    assert chi < 50  # 23 degrees of freedom
    assert sum((by_slot[k] - n / 20) ** 2 / (n / 20) for k in range(20)) < 45
    slots = {(r.shard, r.slot) for r in equal}
    beside = sum((s, k + 1) in slots for s, k in slots)
    assert abs(beside - n / 2) < 300  # every other row is one of them, and so are half of their neighbours


def test_matrix_has_the_law_of_a_permutation(spark):
    """Counts of a block's rows in a cell against those of permutations drawn one by one."""
    import numpy as np

    blocks, caps = [30, 50, 0, 40], [25, 35, 60]
    counts = spark.createDataFrame(list(enumerate(blocks)), "block int, n long")
    cells = F.array(*(F.lit(c).cast("long") for c in caps))
    mine = []
    for seed in range(16):
        got = {r.block: r.counts for r in S.matrix(counts, cells, 2, seed).collect()}
        table = np.array([got[b] for b in range(4)])
        assert (table.sum(axis=1) == blocks).all() and (table.sum(axis=0) == caps).all()
        mine.append(table)
    rng, label = np.random.default_rng(0), np.repeat(np.arange(4), blocks)
    other = []
    for _ in range(4000):
        cut = np.split(rng.permutation(label), np.cumsum(caps)[:-1])
        other.append(np.array([np.bincount(c, minlength=4) for c in cut]).T)
    mean, sd = np.mean(other, axis=0), np.std(other, axis=0)
    assert (np.abs(np.mean(mine, axis=0) - mean) <= 4.5 * sd / 16**0.5 + 1e-9).all()
    ratio = np.std(mine, axis=0)[sd > 0] / sd[sd > 0]
    assert (ratio > 0.4).all() and (ratio < 1.8).all()


def test_tables_that_are_no_plain_scan_are_written_first(spark, data):
    docs = spark.read.parquet(f"{data}/sf0.001/documents.parquet")
    assert S.scanned(docs) and S.scanned(docs.select("text", "doc_id"))
    assert not S.scanned(docs.repartition(3)) and not S.scanned(docs.where("doc_id > 3")) and not S.scanned(spark.range(4))
    out = S.shuffle(docs.repartition(5, "source")).select("shard", "slot").collect()
    assert len({tuple(r) for r in out}) == docs.count()
