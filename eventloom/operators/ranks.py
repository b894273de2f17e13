"""Ranks and quantiles of groups of any size: no group is sorted or held in one task.

A group is cut into parts that come one after another; a row's rank is its rank
in its part plus what the parts before it hold, which a table with one row a part
tells. Parts are cut by leading digits of a hash where the order is one by hash,
and between approximate quantiles elsewhere: those only decide how even the parts
are, and never what comes out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import seeded

#: Hexadecimal digits of a hash that name its part; parts that a group's values are cut into.
DIGITS, PARTS = 2, 64


def _offsets(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, part__, before__, all__) from (by, part__, m__): a row a part, so the window holds few."""
    w = Window.partitionBy(*by)
    upto = w.orderBy("part__").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return parts.withColumn("before__", F.sum("m__").over(upto) - F.col("m__")).withColumn("all__", F.sum("m__").over(w)).drop("m__")


def _joined(df: DataFrame, offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with their part's offsets. A left join, though each row has its part: so Spark can't broadcast the rows, whose size it misjudges after an explode."""
    on = [*by, "part__"]
    right = offsets.withColumnsRenamed({c: f"{c}_o" for c in on})
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"{c}_o"))
    return df.join(right, cond, "left").drop(*(f"{c}_o" for c in on))


def ranked(df: DataFrame, by: Sequence[str], key: str, seed: int, rank: str = "rank__", size: str = "size__") -> DataFrame:
    """Adds each row's rank from 1 in its group, in the order of the seeded hash of its key, and the group's size."""
    t = df.withColumn("hash__", seeded(seed, F.col(key))).withColumn("part__", F.substring("hash__", 1, DIGITS))
    offsets = _offsets(t.groupBy(*by, "part__").agg(F.count("*").alias("m__")), by)
    own = F.row_number().over(Window.partitionBy(*by, "part__").orderBy("hash__", key))
    out = _joined(t.withColumn("own__", own), offsets, by)
    return out.withColumns({rank: F.col("before__") + F.col("own__"), size: F.col("all__")}).drop("hash__", "part__", "own__", "before__", "all__")


def running(df: DataFrame, by: Sequence[str], x: str, n: str, descending: bool = False) -> DataFrame:
    """Adds from__ and upto__ (how much of ``n`` comes before and up to a row, in the order of ``x``) and all__, to rows with one ``x`` a group."""
    value = -F.col(x) if descending else F.col(x)
    cuts = df.groupBy(*by).agg(F.percentile_approx(value.cast("double"), [k / PARTS for k in range(1, PARTS)], 1000).alias("cuts__"))
    right = cuts.withColumnsRenamed({c: f"{c}_c" for c in by})
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"{c}_c"))
    t = df.join(right, cond, "left").drop(*(f"{c}_c" for c in by)) if by else df.join(F.broadcast(cuts))  # one row
    t = t.withColumn("part__", F.size(F.filter("cuts__", lambda c: c < value.cast("double")))).drop("cuts__")
    offsets = _offsets(t.groupBy(*by, "part__").agg(F.sum(n).alias("m__")), by)
    own = F.sum(n).over(Window.partitionBy(*by, "part__").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = _joined(t.withColumn("own__", own), offsets, by)
    return out.withColumn("upto__", F.col("before__") + F.col("own__")).withColumn("from__", F.col("upto__") - F.col(n)).drop("own__", "before__", "part__")


def quantiles(df: DataFrame, by: Sequence[str], x: str, points: dict[str, float]) -> DataFrame:
    """(by, a column for each point): exact quantiles of the values that are not null, linear between neighbours."""
    t = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("n__"))
    t = running(t, by, x, "n__")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("from__") <= rank) & (rank < F.col("upto__")), F.col(x).cast("double")))

    found = {}
    for name, p in points.items():
        place = F.lit(float(p)) * (F.col("all__") - 1)
        found |= {f"{name}_l": at(F.floor(place)), f"{name}_h": at(F.ceil(place)), f"{name}_p": F.max(place - F.floor(place))}
    g = t.groupBy(*by).agg(*(c.alias(k) for k, c in found.items()))
    return g.select(*by, *((F.col(f"{k}_l") * (1 - F.col(f"{k}_p")) + F.col(f"{k}_h") * F.col(f"{k}_p")).alias(k) for k in points))


def with_quantiles(grouped: DataFrame, df: DataFrame, by: Sequence[str], x: str, points: dict[str, float]) -> DataFrame:
    """A table of groups with the quantiles of ``x`` added; null for groups without a value."""
    return joined_back(grouped, quantiles(df, by, x, points), by)


def joined_back(df: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the columns of their group's row; a null name is a group like any other."""
    if not by:
        return df.join(F.broadcast(groups))  # one row
    right = groups.withColumnsRenamed({c: f"{c}_q" for c in by})
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"{c}_q"))
    return df.join(right, cond, "left").drop(*(f"{c}_q" for c in by))
