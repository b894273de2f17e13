"""Uniform shuffling into shards of exact sizes by a hypergeometric communication matrix.

A uniformly random permutation of all rows, cut into shards, is drawn in three
steps that each need only local work. Rows lie in BLOCKS source blocks and the
target is a line of cells (each shard is ``cells`` of them, of sizes fixed in
advance). First the matrix is drawn: how many rows of each block go to each
cell. It has the law that the cut permutation would have, a multivariate
hypergeometric one, and is drawn by halving: the blocks of a half get, cell by
cell, a hypergeometric part of what the whole gets. Then each block is permuted
by itself and its rows dealt to cells as the matrix says (the exchange), and
each cell is permuted again. Shard sizes are exact: they differ by one at most.

Everything is DataFrame expressions. A draw inverts the distribution function
with a running sum over the values within REACH standard deviations of the mode.

Scale. Blocks and cells bound what one task sorts; both grow with the root of the
rows (``rows_per_cell``), and so the matrix, of blocks * cells numbers, with the rows
(some 10^9 numbers for 10^11 rows); the upper half of its
tree is drawn in one task, the subtrees below it (as many as the upper half has
leaves) in a task each. It is joined to the rows by block, in which they are
dealt already.

Rows are told apart by id, text and their place in the table (partition and row),
so that repeated rows are shuffled like any others and none of them make a block
hot. A table read from storage gives each row the same place when a lost task
runs again; any other table is written first (``settle`` decides otherwise).

Values: a null text counts as no bytes (size 8, CRC 0); rows that repeat are
separate rows, each with its own slot; null ids are allowed; an empty table
gives an empty one. Other columns go through, whatever their names; added columns
replace columns of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

SHARDS = 24
BLOCK_BITS, CELLS = 6, 4
#: Rows that a block or a cell holds at most, about, before there are more of them.
ROWS_PER_CELL = 250_000
#: Standard deviations around the mode within which a draw is looked for; what lies beyond is below 1e-20.
REACH = 10


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def hypergeometric(good: Column, bad: Column, n: Column, u: Column) -> Column:
    """A draw: how many of ``n`` taken without replacement out of good + bad are good; ``u`` is uniform in [0, 1)."""
    g, b, d, one = good.cast("double"), bad.cast("double"), n.cast("double"), F.lit(1.0)
    all_ = g + b
    sd = F.sqrt(d * g / all_ * b / all_ * (all_ - d) / F.greatest(all_ - one, one))
    mode = F.floor((d + one) * (g + one) / (all_ + 2))
    reach = F.ceil(sd * REACH) + 10
    given = F.struct(
        g.alias("g"), b.alias("b"), d.alias("n"), u.alias("u"),
        F.greatest(F.lit(0), n - bad, mode - reach).cast("long").alias("low"),
        F.least(good, n, mode + reach).cast("long").alias("high"),
    )

    def drawn(x: Column) -> Column:
        ratio = lambda k: (x["g"] - k + 1) * (x["n"] - k + 1) / (k * (x["b"] - x["n"] + k))  # noqa: E731  weight of k by that of k - 1
        steps = F.when(x["high"] > x["low"], F.sequence(x["low"] + 1, x["high"])).otherwise(F.array().cast("array<bigint>"))
        start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"))
        total = F.aggregate(steps, start, lambda a, k: let(a["w"] * ratio(k), lambda w: F.struct(w.alias("w"), (a["sum"] + w).alias("sum"))), lambda a: a["sum"])

        def found(goal: Column) -> Column:
            begin = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), x["low"].alias("k"))
            step = lambda a, k: let(a["w"] * ratio(k), lambda w: F.struct(w.alias("w"), (a["sum"] + w).alias("sum"), F.when(a["sum"] <= goal, k).otherwise(a["k"]).alias("k")))
            return F.aggregate(steps, begin, step, lambda a: a["k"])

        return let(x["u"] * total, found)

    return F.when((good == 0) | (n == 0), F.lit(0)).when(bad == 0, n).when(n == good + bad, good).otherwise(let(given, drawn)).cast("long")


def _uniform(*on: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*on), 11).cast("double") / F.lit(float(1 << 53))


def _halved(node: Column, caps: Column, left_n: Column, seed: int) -> Column:
    """The left half's share of every cell: a multivariate hypergeometric draw."""
    state = F.struct(F.aggregate(caps, F.lit(0).cast("long"), lambda a, c: a + c).alias("rest"), left_n.cast("long").alias("need"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, good: Column) -> Column:
        draw = hypergeometric(good, a["rest"] - good, a["need"], _uniform(node, F.size(a["out"]), F.lit(seed)))
        return let(draw, lambda x: F.struct((a["rest"] - good).alias("rest"), (a["need"] - x).alias("need"), F.concat(a["out"], F.array(x)).alias("out")))

    return F.aggregate(caps, state, step, lambda a: a["out"])


def matrix(block_counts: DataFrame, cells: Column, bits: int, seed: int) -> DataFrame:
    """(block, counts): how many rows of each block each cell gets. block_counts has (block, n)."""
    blocks = block_counts.sparkSession.range(1 << bits).select(F.col("id").cast("int").alias("block"))
    every = blocks.join(block_counts, "block", "left").select(F.struct("block", F.coalesce("n", F.lit(0)).cast("long").alias("n")).alias("x"))
    one = every.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["n"]).alias("ns"))
    level = one.select(F.lit(1).alias("node"), cells.alias("caps"), "ns")
    for depth in range(bits):  # a node is a run of blocks; its halves are its children
        if depth == (bits + 1) // 2:
            level = level.repartition(1 << depth, "node")
        half = (F.size("ns") / 2).cast("int")
        left_ns = F.slice("ns", F.lit(1), half)
        left = _halved(F.col("node"), F.col("caps"), F.aggregate(left_ns, F.lit(0).cast("long"), lambda a, c: a + c), seed)
        level = level.withColumn("left", left)
        children = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("caps"), left_ns.alias("ns")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("caps", "left", lambda c, x: c - x).alias("caps"), F.slice("ns", half + 1, half).alias("ns")),
        )
        level = level.select(F.explode(children).alias("x")).select("x.*")
    return level.select((F.col("node") - (1 << bits)).cast("int").alias("block"), F.col("caps").alias("counts"))


def _share(total: Column, parts: int, k: Column) -> Column:
    """The size of part k when ``total`` is cut into parts that differ by one at most."""
    return F.floor(total / parts) + F.when(k < total % parts, 1).otherwise(0)


def scanned(df: DataFrame) -> bool:
    """True for columns of files as they are read, whose rows have places that stay."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project":
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def shuffle(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shards: int = SHARDS, seed: int = 1, rows_per_cell: int | None = None, settle: bool | None = None) -> DataFrame:
    """Adds size, text_crc32, shard and slot (the row's place in its shard, gapless from 0)."""
    own = [f"own{k}" for k in range(len(df.columns))]  # no name in here clashes with the table's
    kept = [(name, c) for name, c in zip(own, df.columns, strict=True) if c.lower() not in ("size", "text_crc32", "shard", "slot")]
    raw = F.coalesce(F.col(own[df.columns.index(text)]), F.lit(""))
    df = written(df, "shuffle-input") if (not scanned(df) if settle is None else settle) else df
    n = df.count()
    rows_per_cell = max(ROWS_PER_CELL, 10 * math.isqrt(n)) if rows_per_cell is None else rows_per_cell
    bits, cells = BLOCK_BITS, CELLS
    while n > rows_per_cell << bits:
        bits += 1
    while n > rows_per_cell * shards * cells:
        cells += 1
    base = df.toDF(*own).withColumn("place", F.monotonically_increasing_id())
    base = base.select(*(name for name, _ in kept), F.col(own[df.columns.index(doc_id)]).alias("id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), "place")
    identity = [F.col("id"), F.col("text_crc32"), F.col("size"), F.col("place")]
    base = base.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), *identity), F.lit(1 << bits)).cast("int"))
    block_counts = base.groupBy("block").agg(F.count("*").alias("n"))
    # cell c of shard s comes at s * cells + c
    shard_of = lambda i: (i / cells).cast("int")
    sizes = F.transform(F.sequence(F.lit(0), F.lit(shards * cells - 1)), lambda i: _share(_share(F.lit(n), shards, shard_of(i)), cells, i % cells).cast("long"))
    m = matrix(block_counts, sizes, bits, seed)
    # running sums in two levels, so that a row looks through shards + cells numbers: ends of shards, and of cells in each
    plus = lambda a: F.aggregate(a, F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    groups = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: plus(F.slice("counts", s * cells + 1, cells)))
    m = m.withColumn("inner", groups).withColumn("outer", plus(F.transform("inner", lambda x: F.element_at(x, -1)))).drop("counts")
    first = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), *identity), "place")
    dealt = base.withColumn("rank", F.row_number().over(first) - 1).join(m, "block")
    below = lambda ends, r: F.size(F.filter(ends, lambda e: e <= r)) - 1
    dealt = dealt.withColumn("shard", below(F.col("outer"), F.col("rank")))
    within = F.col("rank") - F.element_at("outer", F.col("shard") + 1)
    dealt = dealt.withColumn("cell", below(F.element_at("inner", F.col("shard") + 1), within)).drop("inner", "outer", "rank", "block")
    second = Window.partitionBy("shard", "cell").orderBy(F.xxhash64(F.lit(seed + 2), *identity), "place")
    of_shard = _share(F.lit(n), shards, F.col("shard"))
    start = F.col("cell") * F.floor(of_shard / cells) + F.least(F.col("cell"), of_shard % cells)
    placed = dealt.withColumn("slot", (start + F.row_number().over(second) - 1).cast("long"))
    return placed.select(*(F.col(name).alias(c) for name, c in kept), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")
