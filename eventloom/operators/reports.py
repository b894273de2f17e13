"""Tables that reports are made of: pairs of models, inclusion in clusters, purity, stability, curves, identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import log_loss, ratio
from .metrics import contingency
from .ranks import quantiles, ranked


def model_pairs(df: DataFrame, pairs: Sequence[tuple[str, str, str]], keep: Sequence[str]) -> DataFrame:
    """One row a comparison (name, left column, right column): ``comparison``, ``left_p``, ``right_p``."""
    each = F.array(*(F.struct(F.lit(n).alias("comparison"), F.col(a).alias("left_p"), F.col(b).alias("right_p")) for n, a, b in pairs))
    return df.select(*keep, F.explode(each).alias("x")).select(*keep, "x.*")


def contrasts(df: DataFrame, by: Sequence[str], base: str, family: str = "family") -> DataFrame:
    """By family: how much its two models' losses fall below the base family's on the same calls, and the change of the gain."""
    t = df.withColumn("l0", log_loss(F.col("y"), F.col("m0"))).withColumn("l1", log_loss(F.col("y"), F.col("m1")))
    b = t.where(F.col(family) == base).select("call_id", *by, F.col("l0").alias("b0"), F.col("l1").alias("b1"))
    j = t.where(F.col(family) != base).join(b, ["call_id", *by])
    g = j.groupBy(*by, family).agg(F.count("*").alias("n"), F.avg(F.col("b0") - F.col("l0")).alias("m0_improvement"), F.avg(F.col("b1") - F.col("l1")).alias("m1_improvement"))
    return g.withColumn("delta_change", F.col("m1_improvement") - F.col("m0_improvement"))


def stability(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Over folds or seeds: how many, mean, sample sd, least and most."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("least"), F.max(x).alias("most"))


def middle(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Median and the distance of the quartiles."""
    q = quantiles(df, by, x, {"low": 0.25, "median": 0.5, "high": 0.75})
    return q.select(*by, "median", (F.col("high") - F.col("low")).alias("iqr"))


def lorenz(df: DataFrame, by: Sequence[str], x: str, key: str) -> DataFrame:
    """Rows in falling ``x``: the share of rows so far, and of the sum. The window's partitions are the groups' rows, one group a task."""
    w = Window.partitionBy(*by)
    run = w.orderBy(F.desc(x), key)
    return df.select(
        *by, key,
        (F.row_number().over(run) / F.count("*").over(w)).alias("rows_share"),
        ratio(F.sum(x).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.sum(x).over(w)).alias("share"),
    )


def binned_means(df: DataFrame, axis: str, bins: int, columns: Sequence[str]) -> DataFrame:
    """By equal bins of an axis in [0, 1], each open at its lower end but the first: n, the axis's mean, the columns' means."""
    at = F.least(F.greatest(F.ceil(F.least(F.greatest(F.col(axis), F.lit(0.0)), F.lit(1.0)) * bins) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(axis).alias("axis_mean"), *(F.avg(c).alias(f"{c}_mean") for c in columns))


def inclusion(df: DataFrame, label: str, cluster: str, noise: int = -1) -> DataFrame:
    """By label: rows, rows in clusters, how many clusters, the largest (smallest name of equals) and its share of the label."""
    c = df.groupBy(label, cluster).agg(F.count("*").alias("n"))
    real = F.col(cluster) != noise
    g = c.groupBy(label).agg(
        F.sum("n").alias("total"), F.sum(F.when(real, F.col("n")).otherwise(0)).alias("clustered"), F.count_if(real).alias("clusters"),
        F.max_by(F.when(real, F.col(cluster)), F.when(real, F.struct(F.col("n"), (-F.col(cluster)).alias("c")))).alias("largest"), F.max(F.when(real, F.col("n"))).alias("largest_n"),
    )
    return g.select(
        label, "total", "clustered", "clusters", F.coalesce("largest", F.lit(noise)).cast("long").alias("largest"), F.coalesce("largest_n", F.lit(0)).alias("largest_n"),
        ratio(F.col("clustered"), F.col("total")).alias("inclusion"), ratio(F.coalesce("largest_n", F.lit(0)), F.col("total")).alias("largest_share"),
    )


def correspondence(df: DataFrame, label: str, component: str) -> DataFrame:
    """One row: mean and weighted purity of components, mean share of a label in its best component, weighted label entropy in bits."""
    c = contingency(df, component, label)
    p = F.col("n") / F.sum("n").over(Window.partitionBy("a"))
    of = c.withColumn("p", p).groupBy("a").agg(F.sum("n").alias("n"), F.max("n").alias("top"), (-F.sum(F.col("p") * F.log2(F.col("p") + 1e-12))).alias("h"))
    one = of.agg(F.avg(F.col("top") / F.col("n")).alias("mean_purity"), (F.sum("top") / F.sum("n")).alias("weighted_purity"), (F.sum(F.col("h") * F.col("n")) / F.sum("n")).alias("label_entropy"))
    two = c.groupBy("b").agg(F.sum("n").alias("n"), F.max("n").alias("top")).agg(F.avg(F.col("top") / F.col("n")).alias("mean_best_share"))
    return one.join(F.broadcast(two))  # one row each


def mixing(near: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, other, n, fraction): which labels the neighbours (query_id, id) of each label's rows have."""
    a, b = labels.select(F.col("id").alias("query_id"), "label"), labels.select("id", F.col("label").alias("other"))
    c = near.select("query_id", "id").join(a, "query_id").join(b, "id").groupBy("label", "other").agg(F.count("*").alias("n"))
    return c.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy("label")))


def relabelled(df: DataFrame, cluster: str, noise: int = -1) -> DataFrame:
    """Clusters numbered from 0 in order of their names, noise kept: the numbering is done on the distinct names."""
    names = df.select(cluster).where(F.col(cluster) != noise).distinct()
    names = names.withColumn("new__", F.row_number().over(Window.orderBy(cluster)) - 1)
    return df.join(names, cluster, "left").withColumn(cluster, F.coalesce("new__", F.lit(noise)).cast("long")).drop("new__")


def solution_pairs(df: DataFrame, setting: str = "setting", item: str = "id", cluster: str = "cluster") -> DataFrame:
    """(a, b, n, ari): adjusted Rand index of each pair of solutions over the items that both hold.

    Items meet by id, so a pair of settings costs its items once; pairs of
    settings are as many as the grid makes them.
    """
    t = df.select(F.col(setting).alias("s"), F.col(item).alias("i"), F.col(cluster).alias("c"))
    x, y = t.alias("x"), t.alias("y")
    j = x.join(y, (F.col("x.i") == F.col("y.i")) & (F.col("x.s") < F.col("y.s")))
    n = j.groupBy(F.col("x.s").alias("a"), F.col("y.s").alias("b"), F.col("x.c").alias("ca"), F.col("y.c").alias("cb")).agg(F.count("*").alias("n"))
    two = lambda v: v * (v - 1) / 2.0
    side = lambda c, out: n.groupBy("a", "b", c).agg(F.sum("n").alias("m")).groupBy("a", "b").agg(F.sum(two(F.col("m"))).alias(out))
    both = n.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum(two(F.col("n"))).alias("both"))
    g = both.join(side("ca", "pa"), ["a", "b"]).join(side("cb", "pb"), ["a", "b"])
    chance = F.col("pa") * F.col("pb") / two(F.col("n"))
    return g.select("a", "b", "n", ratio(F.col("both") - chance, (F.col("pa") + F.col("pb")) / 2 - chance).alias("ari"))


def influence(df: DataFrame, by: Sequence[str], x: str, tops: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """By group of clips: their number, those above zero, the sum, the sum above zero, and what the largest hold of that."""
    plus = F.greatest(F.col(x), F.lit(0.0))
    t = df.withColumn("r__", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(plus), "clip")))
    mass = F.sum(plus)
    share = [ratio(F.sum(F.when(F.col("r__") <= k, plus).otherwise(0.0)), F.when(mass > 0, mass)).alias(f"top{k}_share") for k in tops]
    return t.groupBy(*by).agg(F.count("*").alias("clips"), F.count_if(F.col(x) > 0).alias("positive_clips"), F.sum(x).alias("net"), mass.alias("positive_mass"), *share)


def categories(df: DataFrame, group: Column, column: str) -> DataFrame:
    """Two groups of rows: how many values a column has in each, the top one (smallest of equals), its share, the top five as text."""
    c = df.groupBy(group.alias("side"), F.col(column).cast("string").alias("v")).agg(F.count("*").alias("n"))
    o = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "v")))
    g = c.groupBy("side").agg(F.sum("n").alias("size"), F.count("v").alias("values"), o.alias("o"))
    top5 = F.array_join(F.transform(F.slice("o", 1, 5), lambda x: F.concat(x["v"], F.lit(":"), (-x["m"]).cast("string"))), ";")
    return g.select("side", "size", "values", F.col("o")[0]["v"].alias("top"), (-F.col("o")[0]["m"] / F.col("size")).alias("top_share"), top5.alias("top5"))


def exact_sample(df: DataFrame, by: Sequence[str], n: int, key: str, seed: int = 1) -> DataFrame:
    """Exactly n rows of each group (all, if fewer), drawn without replacement by a hash of the key."""
    return ranked(df, by, key, seed).where(F.col("rank__") <= n).drop("rank__", "size__")


def stratified_folds(df: DataFrame, label: str, key: str, k: int, seed: int = 1) -> DataFrame:
    """(key, label, fold): rows of each label dealt to folds 1 to k in an order by hash."""
    return ranked(df, [label], key, seed).select(key, label, ((F.col("rank__") - 1) % k + 1).cast("int").alias("fold"))


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys on one side only, and on both."""
    f = a.select(key).distinct().withColumn("a__", F.lit(1)).join(b.select(key).distinct().withColumn("b__", F.lit(1)), key, "full")
    return f.agg(F.count_if(F.col("b__").isNull()).alias("left_only"), F.count_if(F.col("a__").isNull()).alias("right_only"), F.count_if(F.col("a__") + F.col("b__") == 2).alias("both"))


def identified(values: DataFrame, clips: DataFrame, calls: DataFrame) -> DataFrame:
    """(value, clip, how) for each way by which a value names a clip: as its id, by a call's id, by the stem of a path.

    ``values``: (value); ``clips``: (clip), ``calls``: (call_id, clip), all strings.
    """
    v = values.select("value").where("value is not null").distinct()
    stem = F.regexp_replace(F.regexp_extract(F.regexp_replace("value", r"\\", "/"), r"([^/]*)$", 1), r"\.[^.]*$", "")
    c = clips.select("clip").distinct()
    ways = (
        v.join(c, v["value"] == c["clip"]).withColumn("how", F.lit("clip")),
        v.join(calls.select("call_id", "clip").distinct(), F.col("value") == F.col("call_id")).drop("call_id").withColumn("how", F.lit("call")),
        v.withColumn("stem__", stem).where("stem__ <> value").join(c, F.col("stem__") == F.col("clip")).drop("stem__").withColumn("how", F.lit("path")),
    )
    return ways[0].unionByName(ways[1]).unionByName(ways[2])


def median_filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing, NaN and infinite values become their column's exact median; columns without any value go."""
    from ..functions.scalars import number

    clean = df.withColumns({c: number(F.col(c)) for c in columns})
    long = clean.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("x")) for c in columns))).alias("u")).select("u.*")
    row = dict.fromkeys(columns) | {r["name"]: r["m"] for r in quantiles(long, ["name"], "x", {"m": 0.5}).collect()}  # one number a column
    return clean.withColumns({c: F.coalesce(F.col(c), F.lit(row[c])) for c in columns if row[c] is not None}).drop(*(c for c in columns if row[c] is None))


def oof_faults(df: DataFrame) -> DataFrame:
    """(fault, n) of a table of held-out predictions: repeated keys, targets that are not 0 or 1, probabilities outside
    [0, 1], clips in several folds, and calls that only one of the targets has. A sound table gives zeros."""
    repeated = df.groupBy("call_id", "target").count().agg(F.count_if(F.col("count") > 1))
    rows = df.agg(
        F.count_if(~F.coalesce(F.col("y").isin(0, 1), F.lit(False))).alias("target_values"),
        F.count_if(~F.coalesce(F.col("m0").between(0, 1) & F.col("m1").between(0, 1), F.lit(False))).alias("probabilities"),
    )
    clips = df.groupBy("clip").agg(F.countDistinct("fold").alias("k")).agg(F.count_if(F.col("k") > 1))
    sides = df.groupBy("call_id").agg(F.countDistinct("target").alias("k")).agg(F.count_if(F.col("k") < 2))
    one = lambda t, name: t.select(F.lit(name).alias("fault"), F.col(t.columns[0]).alias("n"))
    return one(repeated, "repeated_keys").unionByName(one(rows.select("target_values"), "target_values")).unionByName(one(rows.select("probabilities"), "probabilities")).unionByName(one(clips, "clips_in_folds")).unionByName(one(sides, "one_sided_calls"))
