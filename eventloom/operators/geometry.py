"""Vector spaces: scaling, centroids, neighbours, memberships, transition axes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import entropy, ratio
from .ranks import with_quantiles


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def standardised(df: DataFrame, v: str = "v") -> DataFrame:
    """Each dimension less its mean, over its population sd (1 where that is 0); missing values take the median first."""
    long = df.select(F.posexplode(v).alias("d", "x"))
    stats = long.groupBy("d").agg(F.count("x").alias("k"), F.count("*").alias("n"), F.avg("x").alias("m"), F.avg(F.col("x") * F.col("x")).alias("q"))
    stats = with_quantiles(stats, long, ["d"], "x", {"median": 0.5})
    fill = (F.col("n") - F.col("k")) / F.col("n")
    mean = F.col("m") * F.col("k") / F.col("n") + fill * F.col("median")
    square = F.col("q") * F.col("k") / F.col("n") + fill * F.col("median") * F.col("median")
    sd = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
    one = stats.select(F.struct("d", F.col("median"), mean.alias("mean"), F.when(sd > 1e-12, sd).otherwise(1.0).alias("sd")).alias("s")).agg(F.array_sort(F.collect_list("s")).alias("s"))  # a row for each dimension
    scaled = F.zip_with(v, "s", lambda x, s: (F.coalesce(x, s["median"]) - s["mean"]) / s["sd"])
    return df.join(F.broadcast(one)).withColumn(v, scaled).drop("s")


def centroids(df: DataFrame, by: str, v: str = "v") -> DataFrame:
    """(by, n, centre)."""
    long = df.select(by, F.posexplode(v).alias("d", "x")).groupBy(by, "d").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return long.groupBy(by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("centre"))


def centroid_distances(df: DataFrame, by: str, v: str = "v") -> DataFrame:
    """(a, b, distance) of all pairs of centroids; their number is that of the groups."""
    c = centroids(df, by, v)
    a, b = c.select(F.col(by).alias("a"), F.col("centre").alias("ca"), F.lit(1).alias("one")), c.select(F.col(by).alias("b"), F.col("centre").alias("cb"), F.lit(1).alias("one"))
    return a.join(b, "one").where("a < b").select("a", "b", distance(F.col("ca"), F.col("cb")).alias("distance"))


def neighbour_purity(near: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, n, purity) from found neighbours (query_id, id): how many have the label of the row that asks."""
    a, b = labels.select(F.col("id").alias("query_id"), F.col("label").alias("own")), labels.select("id", F.col("label").alias("other"))
    j = near.join(a, "query_id").join(b, "id")
    return j.groupBy(F.col("own").alias("label")).agg(F.count("*").alias("n"), F.avg((F.col("own") == F.col("other")).cast("double")).alias("purity"))


#: Rows of a block of :func:`nearest`, about; query rows whose distances are held at once.
BLOCK, AT_ONCE = 20_000, 128


def nearest(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(query_id, id, distance, rank): exact k nearest, for tables of any size.

    Both sides are cut into blocks by a hash of the id, and each pair of blocks is
    a group that keeps k rows a query; equal distances go by smaller id. The work is
    queries times rows, and a row is shuffled once for each block of the other side.
    """
    import numpy as np
    import pandas as pd

    n_q, n_c = (max(1, -(-df.count() // BLOCK)) for df in (queries, corpus))

    def one(a, b):
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "distance": np.zeros(0)})]
        if len(a) and len(b):
            ids, own, y = a["q_id"].to_numpy(), b["c_id"].to_numpy(), np.stack(b["c_v"]).astype(np.float64)
            y2 = (y * y).sum(axis=1)
            for at in range(0, len(a), AT_ONCE):
                i, x = ids[at : at + AT_ONCE], np.stack(a["q_v"].iloc[at : at + AT_ONCE]).astype(np.float64)
                x2 = (x * x).sum(axis=1)
                d = np.maximum(0, x2[:, None] + y2[None, :] - 2 * x @ y.T)
                d[i[:, None] == own[None, :]] = np.inf
                kth = np.partition(d, min(k, len(own)) - 1, axis=1)[:, min(k, len(own)) - 1]
                slack = 4e-9 * (1 + np.sqrt(kth)) + 1e-12 * (x2 + y2.max())  # what rounds to the k-th distance counts too
                row, col = np.nonzero((d <= (kth + slack)[:, None]) & (d < np.inf))
                exact = np.concatenate([np.zeros(0), *(np.sqrt(((x[row[j : j + 50_000]] - y[col[j : j + 50_000]]) ** 2).sum(axis=1)) for j in range(0, len(row), 50_000))])
                order = np.lexsort((own[col], np.round(exact, 9), row))
                row, col, exact = row[order], col[order], exact[order]
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
                top = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) < k
                out.append(pd.DataFrame({"query_id": i[row[top]], "id": own[col[top]], "distance": exact[top]}))
        return pd.concat(out)

    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.col("id").alias("q_id"), F.col("v").alias("q_v"), block(n_q).alias("q_block"), every(n_c).alias("block"))
    right = corpus.select(F.col("id").alias("c_id"), F.col("v").alias("c_v"), every(n_q).alias("q_block"), block(n_c).alias("block"))
    on = ["q_block", "block"]
    found = left.groupBy(on).cogroup(right.groupBy(on)).applyInPandas(one, "query_id long, id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def memberships(df: DataFrame, centres: DataFrame, m: float = 2.0) -> DataFrame:
    """(id, u): fuzzy c-means memberships to a few centres, in order of the centres' names."""
    c = centres.agg(F.transform(F.array_sort(F.collect_list(F.struct(*centres.columns))), lambda s: s["centre"]).alias("cs"))
    d = F.transform("cs", lambda x: F.greatest(distance(F.col("v"), x), F.lit(1e-12)))
    inv = F.transform(d, lambda x: F.pow(x, F.lit(-2.0 / (m - 1))))
    t = df.join(F.broadcast(c)).withColumn("inv__", inv).withColumn("sum__", F.aggregate("inv__", F.lit(0.0), lambda s, x: s + x))
    return t.select("id", F.transform("inv__", lambda x: x / F.col("sum__")).alias("u"))


def membership_summary(u: DataFrame) -> DataFrame:
    """One row: mean and median of the largest membership, mean entropy, partition coefficient, whether all are even."""
    top = F.array_max("u")
    g = u.agg(F.count("*").alias("n"), F.avg(top).alias("mean_top"), F.avg(entropy(F.col("u"))).alias("entropy"), F.avg(dot(F.col("u"), F.col("u"))).alias("coefficient"), F.max(top - 1.0 / F.size("u")).alias("over"))
    g = with_quantiles(g, u.select(top.alias("top")), [], "top", {"median_top": 0.5})
    return g.withColumn("even", F.col("over") < 1e-3).drop("over")


def transition_axis(df: DataFrame, first: int, last: int, bins: int = 10) -> DataFrame:
    """(id, label, t, bin): rows of two labels along the line from one centroid (t = 0) to the other (t = 1)."""
    two = df.where(F.col("label").isin(first, last))
    c = centroids(two, "label").select("label", "centre")
    ends = c.agg(F.max(F.when(F.col("label") == first, F.col("centre"))).alias("a"), F.max(F.when(F.col("label") == last, F.col("centre"))).alias("b"))
    axis = F.zip_with("b", "a", lambda x, y: x - y)
    t = two.join(F.broadcast(ends)).withColumn("ax", axis)
    along = ratio(dot(F.zip_with("v", "a", lambda x, y: x - y), F.col("ax")), dot(F.col("ax"), F.col("ax")))
    t = t.withColumn("t", along)
    return t.select("id", "label", "t", F.least(F.greatest(F.floor(F.col("t") * bins), F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"))
