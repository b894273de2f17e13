"""Summaries: distributions, crosstabs, dominance, spread, nuisance audits, recompute audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio, window_shape
from .ranks import quantiles, with_quantiles


def described(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """n, mean, population sd, min, quartiles and max."""
    g = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.min(x).alias("least"), F.max(x).alias("most"))
    return with_quantiles(g, df, by, x, {"p25": 0.25, "median": 0.5, "p75": 0.75}).select(*by, "n", "mean", "sd", "least", "p25", "median", "p75", "most")


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts by row and column value, with the row's total, and its top value (first of equals) and share."""
    counts = df.groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values), F.count("*").alias("total"))
    every = F.array(*(F.col(f"n_{v}") for v in values))
    at = F.array_position(every, F.array_max(every)).cast("int")
    return counts.withColumn("top", F.element_at(F.array(*map(F.lit, values)), at)).withColumn("top_fraction", ratio(F.array_max(every), F.col("total")))


def dominance(df: DataFrame, component: str, value: str) -> DataFrame:
    """Each component's most frequent value (the smallest of equals), its share, and the number of values."""
    counts = df.groupBy(component, value).agg(F.count("*").alias("n"))
    top = F.max_by(F.col(value), F.struct("n", F.expr(f"-rank__"))).alias("top")
    ranked = counts.withColumn("rank__", F.row_number().over(Window.partitionBy(component).orderBy(value)))
    return ranked.groupBy(component).agg(top, F.sum("n").alias("size"), F.max("n").alias("top_n"), F.count(value).alias("values")).withColumn("top_fraction", ratio(F.col("top_n"), F.col("size")))


def composition(df: DataFrame, component: str, value: str) -> DataFrame:
    """Each component's values as one text ``value:count;...`` in falling count."""
    counts = df.groupBy(component, value).agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))))
    text = F.array_join(F.transform(ordered, lambda x: F.concat(x["v"].cast("string"), F.lit(":"), (-x["m"]).cast("string"))), ";")
    return counts.groupBy(component).agg(F.sum("n").alias("size"), text.alias("composition"))


def spread(df: DataFrame, label: str, component: str) -> DataFrame:
    """How a label spreads over components: how many, the largest (smallest of equals), its share, entropy in nats."""
    counts = df.groupBy(label, component).agg(F.count("*").alias("n"))
    counts = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(label)))
    return counts.groupBy(label).agg(F.count("*").alias("components"), F.max("n").alias("top_n"), F.max("p").alias("top_fraction"), (-F.sum(F.col("p") * F.log("p"))).alias("entropy"))


def shared_mass(df: DataFrame, label: str, component: str) -> DataFrame:
    """For each pair of labels, the sum over components of the smaller share."""
    counts = df.groupBy(label, component).agg(F.count("*").alias("n"))
    p = counts.select(F.col(label).alias("l"), F.col(component).alias("c"), (F.col("n") / F.sum("n").over(Window.partitionBy(label))).alias("p"))
    a, b = p.alias("a"), p.alias("b")
    j = a.join(b, (F.col("a.c") == F.col("b.c")) & (F.col("a.l") < F.col("b.l")))
    return j.groupBy(F.col("a.l").alias("label_a"), F.col("b.l").alias("label_b")).agg(F.sum(F.least("a.p", "b.p")).alias("shared"))


def unpivoted(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, name, x): one row for each column's value."""
    return df.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns))).alias("u")).select(*keys, "u.*")


def nuisance(df: DataFrame, component: str, columns: Sequence[str]) -> DataFrame:
    """How far the components' means and medians of each column lie apart, in standard deviations of all rows."""
    long = unpivoted(df, [component], columns)
    whole = long.groupBy("name").agg(F.stddev_pop("x").alias("sd"))
    by = with_quantiles(long.groupBy("name", component).agg(F.avg("x").alias("mean")), long, ["name", component], "x", {"median": 0.5})
    g = by.groupBy("name").agg(F.min("mean").alias("mean_least"), F.max("mean").alias("mean_most"), F.min("median").alias("median_least"), F.max("median").alias("median_most"))
    return g.join(whole, "name").withColumn("range_sd", ratio(F.col("mean_most") - F.col("mean_least"), F.when(F.col("sd") > 0, F.col("sd"))))


def two_groups(df: DataFrame, group: Column, columns: Sequence[str]) -> DataFrame:
    """Means, medians, 5 and 95 % points and missing shares of two groups, and their standardised difference (pooled population sd)."""
    long = unpivoted(df.withColumn("g__", group), ["g__"], columns)
    part = lambda g: F.when(F.col("g__") == F.lit(g), F.col("x"))
    out = []
    for g, side in ((True, "a"), (False, "b")):
        x = part(g)
        out += [F.avg(x).alias(f"mean_{side}"), F.var_pop(x).alias(f"v_{side}"), ratio(F.count_if((F.col("g__") == F.lit(g)) & F.col("x").isNull()), F.count_if(F.col("g__") == F.lit(g))).alias(f"missing_{side}")]
    pooled = F.sqrt((F.col("v_a") + F.col("v_b")) / 2)
    of = quantiles(long.where("g__ is not null"), ["name", "g__"], "x", {"median": 0.5, "p05": 0.05, "p95": 0.95})
    side = lambda g, c: F.max(F.when(F.col("g__") == F.lit(g), F.col(c)))
    of = of.groupBy(F.col("name").alias("name_q")).agg(*(side(g, c).alias(f"{c}_{s}") for g, s in ((True, "a"), (False, "b")) for c in ("median", "p05", "p95")))
    found = long.groupBy("name").agg(*out).join(of, F.col("name") == F.col("name_q"), "left").drop("name_q")
    return found.withColumn("smd", ratio(F.col("mean_a") - F.col("mean_b"), F.when(pooled > 0, pooled))).drop("v_a", "v_b")


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    """Smallest, median, mean and largest group, and the share of single rows."""
    g = df.groupBy(group).agg(F.count("*").alias("n"))
    return with_quantiles(g.agg(F.count("*").alias("groups"), F.min("n").alias("least"), F.avg("n").alias("mean"), F.max("n").alias("most"), F.avg((F.col("n") == 1).cast("double")).alias("singletons")), g, [], "n", {"median": 0.5})


def support(df: DataFrame, cell: Sequence[str], group: str, x: str, positive: Column) -> DataFrame:
    """By cell: rows, groups, min, median and max of x, positives and their rate."""
    g = df.groupBy(*cell).agg(F.count("*").alias("n"), F.countDistinct(group).alias("groups"), F.min(x).alias("least"), F.max(x).alias("most"), F.count_if(positive).alias("positives"))
    return with_quantiles(g, df, cell, x, {"median": 0.5}).withColumn("rate", ratio(F.col("positives"), F.col("n")))


def column_support(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """By column: missing rows, and whether all are missing or all the same."""
    g = unpivoted(df, [], columns).groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull()).alias("missing"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    return g.select("name", "n", "missing", (F.col("missing") == F.col("n")).alias("all_missing"), F.coalesce(F.col("lo") == F.col("hi"), F.lit(False)).alias("constant"))


def varying(df: DataFrame, key: Sequence[str], x: str) -> DataFrame:
    """Keys with more than one value of x."""
    return df.groupBy(*key).agg(F.countDistinct(x).alias("values")).where("values > 1")


def group_normalised(df: DataFrame, group: str, columns: Sequence[str], scale: bool) -> DataFrame:
    """Columns less their group's mean; with ``scale`` also over its population sd (0 where that is tiny, and for missing values).

    Rows stream past their group's means, hashed part by part: they are not sorted, so that a task holds a few rows a group at most.
    """
    means = df.groupBy(group).agg(*(f(F.col(c)).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))

    def one(c: str) -> Column:
        away = F.col(c) - F.col(f"m_{c}")
        return F.coalesce(F.when(F.col(f"s_{c}") > 1e-12, away / F.col(f"s_{c}")), F.lit(0.0)) if scale else away

    return df.join(means.hint("shuffle_hash"), group).withColumns({c: one(c) for c in columns}).select(*df.columns)


def compared(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """By column: the largest difference, rows null on one side only, and keys that one table lacks."""
    a, b = old.select(*keys, *(F.col(c).alias(f"a_{c}") for c in columns), F.lit(1).alias("a__")), new.select(*keys, *(F.col(c).alias(f"b_{c}") for c in columns), F.lit(1).alias("b__"))
    j = a.join(b, list(keys), "full")
    lost = F.count_if(F.col("a__").isNull() | F.col("b__").isNull())
    each = F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"a_{c}").cast("double").alias("x"), F.col(f"b_{c}").cast("double").alias("y")) for c in columns))
    g = j.select("a__", "b__", F.explode(each).alias("u")).groupBy("u.name")
    return g.agg(F.max(F.abs(F.col("u.x") - F.col("u.y"))).alias("most"), F.count_if(F.col("u.x").isNull() != F.col("u.y").isNull()).alias("null_differs"), lost.alias("lost"))


def formula_audit(t: DataFrame, rate: float, silent: float = 1e-10) -> DataFrame:
    """Cached (n_fft, hop, n_mels, duration) of calls against what their sample count n and level rms ask for, and n against the call's rounded bounds (one sample apart is a match)."""
    early = (F.col("n") < 4) | (F.col("rms") <= silent)
    want = window_shape(F.col("n"))
    wanted = {f"expected_{c}": F.when(~early, want[c]) for c in ("n_fft", "hop", "n_mels")}
    bound = (F.rint(F.col("end_s") * rate) - F.rint(F.col("start_s") * rate)).cast("long")
    same = F.col("n_fft").eqNullSafe(wanted["expected_n_fft"]) & F.col("hop").eqNullSafe(wanted["expected_hop"]) & F.col("n_mels").eqNullSafe(wanted["expected_n_mels"])
    return t.select(
        "call_id", early.alias("early"), *(c.alias(k) for k, c in wanted.items()), same.alias("formula_match"), (F.col("n") - bound).alias("boundary_difference"),
        (F.abs(F.col("n") - bound) <= 1).alias("boundary_match"), (F.abs(F.col("duration") - F.col("n") / rate) <= 1e-12).alias("duration_match"),
    )
