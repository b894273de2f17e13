"""Queries on small tables of the kind that larger inputs hold: events of no length, texts so long that a probability is 1."""

from __future__ import annotations

import os

import duckdb
from eventloom.plans import registry, table_queries
from oracle import assert_same


def _tables(data: str, folder, **sql: str) -> str:
    """A copy of sf0.001 in which SQL makes some tables."""
    con = duckdb.connect()
    for f in os.listdir(f"{data}/sf0.001"):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{data}/sf0.001/{f}'")
        con.execute(f"COPY ({sql.get(f[:-8], f'SELECT * FROM {f[:-8]}')}) TO '{folder}/{f}' (FORMAT parquet)")
    return str(folder)


def test_range_counts_leave_the_event_out(spark, data, tmp_path):
    d = _tables(data, tmp_path, events="SELECT * REPLACE (CASE event_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN -100.0 ELSE value END AS value) FROM events")
    assert_same(registry.QUERIES["jon8_range_counts"](spark, d), registry.ORACLES["jon8_range_counts"], d)


def test_loss_again_at_the_bounds(spark, data, tmp_path, monkeypatch):
    d = _tables(data, tmp_path, documents="SELECT * REPLACE (CASE WHEN doc_id % 2 = 0 THEN n_chars * 1000 ELSE n_chars END AS n_chars) FROM documents")
    assert_same(registry.QUERIES["met22_loss_again"](spark, d), registry.ORACLES["met22_loss_again"], d)
    loss = table_queries.S.log_loss
    monkeypatch.setattr(table_queries.S, "log_loss", lambda y, p: loss(y, p) * 1.000001)
    assert not any(r.same for r in registry.QUERIES["met22_loss_again"](spark, d).collect())


def test_nested_folds_read_the_rows_once(spark, tmp_path):
    """Outer folds and sizes of groups are made once, not again for each inner fold."""
    from eventloom.operators import cohort
    from pyspark.sql import functions as F

    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 30).alias("g"))
    inner = cohort.nested_folds(cohort.group_folds(rows, "g", 4).select("g", "fold"), rows.mapInArrow(seen, rows.schema), "g", 3).collect()
    assert len({(r.outer_fold, r.g) for r in inner}) == len(inner) == 90 and made.value == 300


def test_oracle_parent_reads_texts_once(spark, data, monkeypatch):
    from eventloom.plans import fit_queries

    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    x = fit_queries.texts(spark, f"{data}/sf0.001")
    monkeypatch.setattr(fit_queries, "texts", lambda *_: x.mapInArrow(seen, x.schema))
    assert registry.QUERIES["fit10_oracle_parent"](spark, f"{data}/sf0.001").count() == 8
    assert made.value == x.count()


def test_silhouettes_shuffle_few_copies():
    from eventloom.operators import inference

    copies = lambda n: -(-n // inference.block_rows(n))
    assert copies(120_000) <= 16 and copies(720_000) <= 22  # by 4,096 rows: 30 and 176
    assert inference.block_rows(10**9) == inference.LARGEST


def test_rows_of_ranks_are_never_broadcast(spark, tmp_path):
    """Spark takes exploded rows for as many as there were before, and so for a smaller table than what approximate quantiles are made of."""
    from eventloom.operators import ranks
    from pyspark.sql import functions as F

    spark.range(2000).select(F.col("id").alias("call_id"), (F.col("id") % 4).cast("string").alias("label"), F.rand(1).alias("m")).write.parquet(f"{tmp_path}/t")
    each = spark.read.parquet(f"{tmp_path}/t").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(19))))
    each = each.select(F.concat_ws("|", "label", "draw").alias("within"), (F.col("call_id") * 32 + F.col("draw")).alias("key"), "m")
    runs = ranks.running(each.withColumn("one", F.lit(1)), ["within"], "key", "one")
    for t in (runs, ranks.ranked(each, ["within"], "key", 1)):
        assert len(t.collect()) == 38_000
        assert "BuildLeft" not in t._jdf.queryExecution().executedPlan().toString()
    assert runs.where("upto__ = all__").count() == 76


def test_group_normalised_sorts_no_rows(spark):
    from eventloom.operators import audits
    from pyspark.sql import functions as F

    df = spark.range(4000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for groups too many to broadcast
    try:
        out = audits.group_normalised(df, "g", ["x"], False)
        assert len(out.collect()) == 4000
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
        assert out.groupBy("g").agg(F.abs(F.sum("x")).alias("s")).where("s > 1e-6").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_silhouettes_of_many_blocks(spark):
    """Each pair of blocks is met once, and counts for the rows of both."""
    import numpy as np
    from eventloom.operators import inference

    r = np.random.default_rng(3)
    v, g = r.normal(size=(230, 3)).round(6), r.integers(-1, 4, 230)
    g[17] = 9  # the only row of its group
    df = spark.createDataFrame([(i, int(g[i]), v[i].tolist()) for i in range(230)], "id long, g int, v array<double>")
    for noise in (None, -1):
        own = np.flatnonzero(g != noise) if noise is not None else np.arange(230)
        far = np.sqrt(((v[own][:, None] - v[own][None]) ** 2).sum(axis=2))
        want = {}
        for k, i in enumerate(own):
            means = {c: far[k][g[own] == c].sum() / max(1, (g[own] == c).sum() - (c == g[i])) for c in set(g[own])}
            a, b = means.pop(g[i]), min(means.values())
            want[int(i)] = 0.0 if (g[own] == g[i]).sum() == 1 else (b - a) / max(a, b)
        got = {x.id: x.s for x in inference.silhouettes(df, "g", noise=noise, block=50).collect()}
        assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-9
