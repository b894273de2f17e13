"""Samples, folds, bins and edge summaries. Orders come from a seeded hash, so any run and engine draws the same rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio, seeded
from ..sources.shared import written
from .ranks import ranked, running


def sampled_per_group(df: DataFrame, by: Sequence[str], n: Column | int, key: str, seed: int = 1) -> DataFrame:
    """At most ``n`` rows of each group; ``n`` may be a column of the group's quota."""
    n = F.lit(n) if isinstance(n, int) else n
    return ranked(df, by, key, seed).where(F.col("rank__") <= n).drop("rank__", "size__")


def quota_sample(pool: DataFrame, wanted: DataFrame, by: Sequence[str], key: str, seed: int = 1) -> DataFrame:
    """As many rows of each group of ``pool`` as ``wanted`` has; raises if a group holds too few."""
    need = wanted.groupBy(*by).agg(F.count("*").alias("need__"))
    have = pool.groupBy(*by).agg(F.count("*").alias("have__"))
    if (short := need.join(have, list(by), "left").where("coalesce(have__, 0) < need__").limit(1).collect()):
        raise ValueError(f"the pool is too small: {short[0].asDict()}")
    return sampled_per_group(pool.join(need, list(by)), by, F.col("need__"), key, seed).drop("need__")


def fraction_sample(df: DataFrame, by: Sequence[str], fraction: float, key: str, seed: int = 1) -> DataFrame:
    """max(2, round(fraction * n)) rows of each group, halves to even."""
    return ranked(df, by, key, seed).where(F.col("rank__") <= F.greatest(F.lit(2), F.rint(F.col("size__") * fraction))).drop("rank__", "size__")


def _least_reaching(load: Sequence[int], size: int, m: int) -> int:
    """The m-th smallest of the numbers load[f] + j * size, j from 0."""
    low, high = min(load), min(load) + (m - 1) * size
    while low < high:
        middle = (low + high) // 2
        if sum((middle - x) // size + 1 for x in load if x <= middle) >= m:
            high = middle
        else:
            low = middle + 1
    return low


def _filled(load: Sequence[int], size: int, m: int) -> list[int]:
    """The folds' loads after m groups of one size went, one by one, to the fold with the least (the first of equals)."""
    top = _least_reaching(load, size, m)
    count = [max(0, (top - 1 - x) // size + 1) for x in load]
    left = m - sum(count)
    for f, x in enumerate(load):
        if left and x <= top and (top - x) % size == 0:
            count[f], left = count[f] + 1, left - 1
    return [x + n * size for x, n in zip(load, count, strict=True)]


def group_folds(df: DataFrame, group: str, k: int = 5, seed: int = 1) -> DataFrame:
    """(group, size, fold): folds from 1 that keep groups whole, filled greedily.

    Groups in falling size, equal ones by a seeded hash, each go to the fold with the fewest
    rows so far, the first of equals. The driver goes through the different sizes alone, and
    keeps what the folds hold before each; where the n-th group of a size goes follows from
    these loads: the folds take groups in the order of load + j * size, and the n-th
    smallest of these numbers is found by halving. Ranks within a size are made in parts.
    """
    return _folded(written(df.groupBy(group).agg(F.count("*").alias("size")), "fold-sizes"), group, k, seed)


def _folded(sizes: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """:func:`group_folds` of (group, size)."""
    load, runs = [0] * k, []
    for r in sizes.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("size")).toLocalIterator():  # a row a size
        runs.append((r["size"], load))
        load = _filled(load, r["size"], r["n"])
    table = sizes.sparkSession.createDataFrame(runs, "size long, load array<long>")
    placed = ranked(sizes, ["size"], group, seed, "nth__", "all__").drop("all__").join(table, "size")
    s, nth = F.col("size"), F.col("nth__")
    upto = lambda v: F.aggregate("load", F.lit(0).cast("long"), lambda a, x: a + F.when(x <= v, F.floor((v - x) / s) + 1).otherwise(0))
    least = F.array_min("load")
    bounds = F.struct(least.alias("low"), (least + (nth - 1) * s).alias("high"))

    def halved(b: Column, _: Column) -> Column:
        middle = F.floor((b["low"] + b["high"]) / 2)
        return F.when(b["low"] >= b["high"], b).when(upto(middle) >= nth, F.struct(b["low"].alias("low"), middle.alias("high"))).otherwise(F.struct((middle + 1).alias("low"), b["high"].alias("high")))

    steps = F.ceil(F.log2((nth * s).cast("double"))) + 1  # the bounds are (nth - 1) * s apart
    value = F.aggregate(F.sequence(F.lit(1).cast("long"), steps), bounds, halved)["low"]
    placed = placed.withColumn("at__", value)
    exact = F.filter(F.sequence(F.lit(1), F.lit(k)), lambda f: (F.element_at("load", f) <= F.col("at__")) & ((F.col("at__") - F.element_at("load", f)) % s == 0))
    return placed.select(group, "size", F.element_at(exact, (nth - upto(F.col("at__") - 1)).cast("int")).cast("int").alias("fold"))


def nested_folds(folds: DataFrame, df: DataFrame, group: str, k: int = 3, seed: int = 1) -> DataFrame:
    """(outer_fold, group, inner_fold): for each outer fold, folds of the groups outside it."""
    folds = written(folds.select(group, "fold").distinct(), "outer-folds")
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    known = written(sizes.join(folds, group), "nested-sizes")  # a row a group
    outer = [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]  # a few numbers
    out = None
    for f in outer:
        inside = _folded(known.where(F.col("fold") != f).select(group, "size").distinct(), group, k, seed + f)
        part = inside.select(F.lit(f).alias("outer_fold"), group, F.col("fold").alias("inner_fold"))
        out = part if out is None else out.union(part)
    return out


def assert_disjoint(a: DataFrame, b: DataFrame, group: str) -> None:
    """Raises if two tables share a group."""
    if (both := a.select(group).join(b.select(group), group, "left_semi").limit(1).collect()):
        raise ValueError(f"{group} {both[0][0]} is on both sides")


def supported(df: DataFrame, cell: Sequence[str], valid: Column, least: int) -> DataFrame:
    """Rows of cells with at least ``least`` valid rows."""
    good = df.groupBy(*cell).agg(F.count_if(valid).alias("v__")).where(F.col("v__") >= least).drop("v__")
    return df.join(good, list(cell), "left_semi")


def first_keys(df: DataFrame, key: str, row: str, n: int) -> DataFrame:
    """All rows of the ``n`` keys that come first by row number."""
    first = df.groupBy(key).agg(F.min(row).alias("at__")).orderBy("at__", key).limit(n)
    return df.join(first.select(key), key, "left_semi")


def top_share(df: DataFrame, fraction: float, x: str, key: str) -> DataFrame:
    """The ceil(fraction * n) rows with the largest ``x``, of equals those with the smallest key (numbers, unique); a null x comes last.

    The value at the bound comes from running counts in parts, so that no task sorts the share.
    """
    n = df.count()
    wanted = math.ceil(fraction * n)
    counts = running(df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count("*").alias("n__")), [], x, "n__", descending=True)
    last = counts.where((F.col("from__") < wanted) & (F.col("upto__") >= wanted)).select(x, "from__").first() if wanted else None
    if last is not None:
        above, ties, left = df.where(F.col(x) > F.lit(last[0])), df.where(F.col(x) == F.lit(last[0])), wanted - last[1]
    else:
        above, ties = (df.where(F.col(x).isNotNull()), df.where(F.col(x).isNull())) if wanted else (df.limit(0), df.limit(0))
        left = wanted - above.count()
    first = running(ties.withColumn("one__", F.lit(1)), [], key, "one__").where(F.col("upto__") <= left).select(*df.columns)
    return above.unionByName(first)


# -- what edges say


def frequency(df: DataFrame, category: str, within: Sequence[str] = ()) -> DataFrame:
    """n and share of each category (null is one) within each group."""
    g = df.groupBy(*within, category).agg(F.count("*").alias("n"))
    return g.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def up_to(df: DataFrame, gap: str, windows: Sequence[float]) -> DataFrame:
    """Rows once for each window that holds their gap; negative gaps are in all."""
    return df.withColumn("tau", F.explode(F.filter(F.array(*(F.lit(float(w)) for w in windows)), lambda t: t >= F.col(gap))))


def reliability(edges: DataFrame, windows: Sequence[float], context: str = "context_i", gap: str = "delta_s", known: Column | None = None, same: Column | None = None) -> DataFrame:
    """By context of the first event, and over ``ALL``: precision, coverage and recall of "the next event within tau"."""
    known = F.col("known") if known is None else known
    same = F.col("same") if same is None else same
    t = edges.withColumn("tau", F.explode(F.array(*(F.lit(float(w)) for w in windows))))
    t = t.select(F.explode(F.array(F.col(context).cast("string"), F.lit("ALL"))).alias("context"), "tau", known.alias("k"), same.alias("s"), (F.col(gap) <= F.col("tau")).alias("in"))
    g = t.groupBy("context", "tau").agg(F.count_if("k").alias("known_n"), F.count_if(F.col("k") & F.col("in")).alias("candidate_n"), F.count_if(F.col("k") & F.col("s")).alias("same_n"), F.count_if(F.col("k") & F.col("s") & F.col("in")).alias("same_candidate_n"))
    g = g.withColumn("precision", ratio(F.col("same_candidate_n"), F.col("candidate_n"))).withColumn("false_link", 1 - F.col("precision"))
    return g.withColumn("coverage", ratio(F.col("candidate_n"), F.col("known_n"))).withColumn("recall", ratio(F.col("same_candidate_n"), F.col("same_n")))


def relation(context_i: Column, context_j: Column, emitter_i: Column, emitter_j: Column, dyad_same: Column) -> Column:
    """What two neighbouring events have in common, the closest first."""
    return F.when(dyad_same, "same_pair").when((context_i == context_j) & (emitter_i == emitter_j), "same_context_and_emitter").when(context_i == context_j, "same_context").when(emitter_i == emitter_j, "same_emitter").otherwise("different")
