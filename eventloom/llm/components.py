"""Connected components of an edge table, by alternating large and small stars.

Each round joins an edge table with its own per-node minimum, so that rounds
grow with the logarithm of the longest path and no task needs all neighbours of
a node; the minima of large stars are a table of their own before they are joined,
so that Spark can split the join at a large star's centre. Edges never leave Spark;
two numbers a round tell the driver whether anything changed. Tables of rounds that
are over are deleted.

Values: ids are whole numbers; an edge with a null end or equal ends, and repeated
edges, add nothing; no edges give an empty table. Of other columns nothing is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, written

MOST_ROUNDS = 60


def _least(edges: DataFrame, side: str, to: str) -> DataFrame:
    return edges.groupBy(F.col(side).alias("own")).agg(F.min(to).alias("least"))


def _hooked(edges: DataFrame, side: str, m: DataFrame) -> DataFrame:
    """Every edge with ``m``, the smallest of its node and the node's neighbours."""
    return edges.join(m, F.col(side) == F.col("own")).withColumn("m", F.least("own", "least"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge: root is the smallest node that edges lead to."""
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = written(e, "edges")
    seen = None
    for _ in range(MOST_ROUNDS):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        centre = written(_least(both, "u", "v"), "edges")
        large = _hooked(both, "u", centre).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = _hooked(large, "u", _least(large, "u", "v"))  # few edges a node now
        small = down.select("v", "m").where("v <> m").union(down.select("u", "m").where("u <> m")).toDF("u", "v").distinct()
        new = written(small, "edges")
        now = tuple(new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        dropped(e)
        dropped(centre)
        e = new
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        seen = now
    raise RuntimeError("components did not settle")
