"""Probabilistic metrics, contrasts and resampling on tables of predictions (call_id, clip, label, fold, target, y, m0, m1, valid)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import binned, brier, log_loss, ratio
from .ranks import joined_back, ranked, running, with_quantiles

EDGES = (0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 1.0)


def rolled(df: DataFrame, label: str = "label") -> DataFrame:
    """Every row under ``overall`` and under its label, as ``part``."""
    return df.withColumn("part", F.explode(F.array(F.lit("overall"), F.col(label))))


def views(df: DataFrame) -> DataFrame:
    """Every row under ``all``, and valid rows also under ``valid``, as ``view``."""
    return df.withColumn("view", F.explode(F.when(F.col("valid"), F.array(F.lit("all"), F.lit("valid"))).otherwise(F.array(F.lit("all")))))


def losses(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean log loss of both models, the gain of the second, Brier scores."""
    y = F.col("y")
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("positives"), F.avg(log_loss(y, F.col("m0"))).alias("loss0"), F.avg(log_loss(y, F.col("m1"))).alias("loss1"), F.avg(brier(y, F.col("m0"))).alias("brier0"), F.avg(brier(y, F.col("m1"))).alias("brier1"))
    return g.withColumn("delta", F.col("loss0") - F.col("loss1"))


def by_score(df: DataFrame, by: Sequence[str], p: str) -> DataFrame:
    """Positives and negatives at each score, with the numbers above it: the table that AUC and AP come from."""
    g = df.where(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("p")).agg(F.sum("y").cast("double").alias("pos"), F.sum(1 - F.col("y")).cast("double").alias("neg"))
    t = running(g.withColumn("n", F.col("pos") + F.col("neg")), by, "p", "pos", descending=True).withColumnRenamed("upto__", "pos_to").drop("from__", "all__")
    return running(t, by, "p", "neg", descending=True).withColumnRenamed("upto__", "neg_to").drop("from__", "all__", "n")


def ranking(df: DataFrame, by: Sequence[str], p: str) -> DataFrame:
    """AUC (ties count half; null with one class only) and average precision (a step for each score)."""
    t = by_score(df, by, p)
    below = F.col("pos") * (F.lit(0.5) * F.col("neg")) - F.col("pos") * F.col("neg_to")
    g = t.groupBy(*by).agg(F.sum("pos").alias("np"), F.sum("neg").alias("nn"), F.sum(below).alias("u"), F.sum(F.col("pos") * F.col("pos_to") / (F.col("pos_to") + F.col("neg_to"))).alias("ap"))
    return g.select(*by, ratio(F.col("np") * F.col("nn") + F.col("u"), F.col("np") * F.col("nn")).alias("auc"), ratio(F.col("ap"), F.col("np")).alias("ap"))


def calibration_bins(df: DataFrame, by: Sequence[str], p: str, edges: Sequence[float] = EDGES) -> DataFrame:
    """By probability bin: n, mean prediction, observed rate."""
    t = df.withColumn("bin", binned(F.col(p), edges))
    return t.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(F.col("y").cast("double")).alias("observed"))


def calibration(df: DataFrame, by: Sequence[str], p: str, edges: Sequence[float] = EDGES) -> DataFrame:
    """Brier score, bias, expected calibration error, and what confident errors (wrong by 0.9) add to the loss."""
    y, q = F.col("y"), F.col(p)
    loss, wrong = log_loss(y, q), F.abs(q - y) >= 0.9
    g = df.groupBy(*by).agg(F.avg(brier(y, q)).alias("brier"), F.avg(q - y).alias("bias"), F.count_if(wrong).alias("wrong_n"), F.sum(F.when(wrong, loss).otherwise(0.0)).alias("wl"), F.sum(loss).alias("tl"))
    ece = calibration_bins(df, by, p, edges).groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("predicted") - F.col("observed"))) / F.sum("n")).alias("ece"))
    return g.join(ece, list(by)).withColumn("wrong_share", ratio(F.col("wl"), F.col("tl"))).drop("wl", "tl")


def gains(df: DataFrame) -> DataFrame:
    """Each row's loss under both models, and the gain."""
    t = df.withColumn("l0", log_loss(F.col("y"), F.col("m0"))).withColumn("l1", log_loss(F.col("y"), F.col("m1")))
    return t.withColumn("gain", F.col("l0") - F.col("l1"))


def clip_totals(df: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """By clip: rows, sum of gains, the mean gain without the clip, and its share of absolute sums."""
    g = gains(df).groupBy(*by, "clip").agg(F.count("*").alias("n"), F.sum("gain").alias("gain_sum"))
    whole = g.groupBy(*by).agg(F.sum("gain_sum").alias("sum__"), F.sum("n").alias("n__"), F.sum(F.abs("gain_sum")).alias("abs__"))  # a row an arm
    out = joined_back(g, whole, by)
    out = out.withColumn("without", ratio(F.col("sum__") - F.col("gain_sum"), F.col("n__") - F.col("n")))
    return out.withColumn("share", ratio(F.abs("gain_sum"), F.col("abs__"))).drop("sum__", "n__", "abs__")


def concentration(totals: DataFrame, fractions: Sequence[float], by: Sequence[str] = ("target",)) -> DataFrame:
    """What the top clips by absolute gain hold, and the mean gain without them."""
    w = Window.partitionBy(*by)
    t = totals.withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.abs("gain_sum")), "clip"))).withColumn("clips", F.count("*").over(w))
    t = t.withColumn("fraction", F.explode(F.array(*(F.lit(float(f)) for f in fractions)))).withColumn("in", F.col("rank") <= F.ceil(F.col("fraction") * F.col("clips")))
    a = F.abs("gain_sum")
    g = t.groupBy(*by, "fraction").agg(F.count_if("in").alias("top_n"), F.sum(F.when(F.col("in"), a).otherwise(0.0)).alias("top"), F.sum(a).alias("total"), F.sum(F.when(~F.col("in"), F.col("gain_sum"))).alias("rest"), F.sum(F.when(~F.col("in"), F.col("n"))).alias("rest_n"))
    return g.select(*by, "fraction", "top_n", ratio(F.col("top"), F.col("total")).alias("top_share"), ratio(F.col("rest"), F.col("rest_n")).alias("delta_without"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index, normalised mutual information, purity of b's groups, and pair agreement of two groupings."""
    c = contingency(df, a, b).withColumn("na", F.sum("n").over(Window.partitionBy("a"))).withColumn("nb", F.sum("n").over(Window.partitionBy("b")))
    pairs = lambda x: x * (x - 1) / 2.0
    total = df.agg(F.count("*").alias("total"))
    c = c.join(F.broadcast(total))  # one row
    p, pa, pb = F.col("n") / F.col("total"), F.col("na") / F.col("total"), F.col("nb") / F.col("total")
    by_b = c.groupBy("b").agg(F.max("n").alias("top")).agg(F.sum("top").alias("tops"))
    g = c.groupBy("total").agg(
        F.sum(pairs(F.col("n"))).alias("both"),
        F.sum(pairs(F.col("na")) * F.col("n") / F.col("na")).alias("pa"), F.sum(pairs(F.col("nb")) * F.col("n") / F.col("nb")).alias("pb"),
        F.sum(p * F.log(p / (pa * pb))).alias("mi"),
        (-F.sum(p * F.log(pa))).alias("ha"), (-F.sum(p * F.log(pb))).alias("hb"),
    )
    g = g.join(F.broadcast(by_b))
    chance = F.col("pa") * F.col("pb") / pairs(F.col("total"))
    return g.select(
        ratio(F.col("both") - chance, (F.col("pa") + F.col("pb")) / 2 - chance).alias("ari"),
        ratio(F.col("mi"), (F.col("ha") + F.col("hb")) / 2).alias("nmi"),
        ratio(F.col("tops"), F.col("total")).alias("purity"),
        ratio(pairs(F.col("total")) - F.col("pa") - F.col("pb") + 2 * F.col("both"), pairs(F.col("total"))).alias("pair_agreement"),
        ratio(F.col("both"), F.col("pa")).alias("same_kept"),
    )


def confusion_scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: balanced accuracy and macro F1 over the true classes."""
    c = contingency(df, truth, guess)
    hits = c.groupBy("a").agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("tp"))
    said = c.groupBy("b").agg(F.sum("n").alias("g"))
    j = hits.join(said, F.col("a") == F.col("b"), "left")
    return j.agg(F.avg(F.col("tp") / F.col("t")).alias("balanced_accuracy"), F.avg(2 * F.col("tp") / (F.col("t") + F.coalesce("g", F.lit(0)))).alias("macro_f1"))


def chosen(scores: DataFrame, by: Sequence[str], order: Sequence[float]) -> DataFrame:
    """The candidate with the least pooled loss; of exact ties the one declared first. scores: (by, c, n, loss_sum)."""
    place = F.array_position(F.array(*(F.lit(float(c)) for c in order)), F.col("c"))
    g = scores.groupBy(*by, "c").agg((F.sum("loss_sum") / F.sum("n")).alias("loss")).withColumn("at", place)
    return g.groupBy(*by).agg(F.min_by("c", F.struct("loss", "at")).alias("c"), F.min("loss").alias("loss"))


def null_summary(draws: DataFrame, observed: DataFrame, by: Sequence[str], x: str = "x") -> DataFrame:
    """Mean, sample sd and 95 % range of a null, and the p-value (1 + draws at or above) / (n + 1) of what was observed."""
    j = draws.join(observed.withColumnRenamed(x, "seen__"), list(by))
    g = j.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), ((1 + F.count_if(F.col(x) >= F.col("seen__"))) / (F.count("*") + 1)).alias("p_value"))
    return with_quantiles(g, j, by, x, {"low": 0.025, "high": 0.975})


def shuffled_within(df: DataFrame, group: str, key: str, columns: Sequence[str], seed: int = 1) -> DataFrame:
    """The columns' rows dealt anew within each group."""
    a = running(df.drop(*columns).withColumn("one__", F.lit(1)), [group], key, "one__").withColumnRenamed("upto__", "at__")
    b = ranked(df, [group], key, seed, "to__").select(F.col(group).alias("g__"), *columns, "to__")
    return a.join(b, (F.col(group) == F.col("g__")) & (F.col("at__") == F.col("to__"))).select(*df.columns)


def decomposed(df: DataFrame) -> DataFrame:
    """Per row of (y, m0, mc, mr, m1): total gain = configuration + remaining, the interaction, and the identity's error."""
    loss = lambda m: log_loss(F.col("y"), F.col(m))
    t = df.withColumn("total", loss("m0") - loss("m1")).withColumn("config", loss("m0") - loss("mc")).withColumn("remaining", loss("mc") - loss("m1"))
    t = t.withColumn("interaction", loss("mr") - loss("m1") - loss("m0") + loss("mc"))
    return t.withColumn("error", F.abs(F.col("total") - F.col("config") - F.col("remaining")))


# -- clip bootstrap


def clip_blocks(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums that a draw of clips needs: rows and gains of each clip. Rows without a clip take no part."""
    return gains(df).where("clip is not null").groupBy(*by, "clip").agg(F.count("*").alias("n"), F.sum("gain").alias("gain_sum"))


def poisson_weights(clips: DataFrame, draws: int, seed: int = 1, most: int = 12) -> DataFrame:
    """(clip, draw, w): how often a draw takes a clip, a Poisson(1) number from a hash of (seed, draw, clip).

    The same weights serve all arms, so that differences are paired. Drawing
    with replacement tends to this law as clips grow; no draw needs all clips in
    one place. The number comes from 13 hexadecimal digits of an MD5.
    """
    import math

    t = clips.select("clip").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), F.col("clip").cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    below, total = F.lit(0), 0.0
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        below = below + F.when(u >= total, 1).otherwise(0)
    return t.withColumn("w", below.cast("int"))


def bootstrap(df: DataFrame, by: Sequence[str], draws: int = 200, seed: int = 1) -> DataFrame:
    """By arm: the mean gain, and the 95 % range of its clip bootstrap."""
    blocks = clip_blocks(df, by)
    drawn = blocks.join(poisson_weights(blocks, draws, seed).where("w > 0"), "clip").groupBy(*by, "draw").agg((F.sum(F.col("w") * F.col("gain_sum")) / F.sum(F.col("w") * F.col("n"))).alias("x"))
    point = blocks.groupBy(*by).agg((F.sum("gain_sum") / F.sum("n")).alias("gain"))
    ends = drawn.groupBy(*by).agg(F.percentile("x", F.lit(0.025)).alias("low"), F.percentile("x", F.lit(0.975)).alias("high"), F.count("*").alias("draws"))
    return point.join(ends, list(by))
