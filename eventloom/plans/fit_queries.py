"""Queries that fit many logistic models at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import cohort, inference, metrics, models, newton
from ..operators.newton import Fit
from ..sources import tables as T
from ..sources.shared import written
from .common import register
from .event_queries import six

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)

BASE = ("log_chars", "words")
MARKS = ("lines", "digits", "capitals", "marks", "vowels", "mean_word")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """(call_id, clip, label, valid, quality, toxic, BASE, MARKS): labelled documents with measures of their text."""
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("double")
    docs = T.table(spark, d, "documents").select(
        F.col("doc_id").alias("call_id"), F.col("source").alias("clip"), F.col("lang").alias("label"), (F.col("n_chars") < 5000).alias("valid"),
        F.log1p("n_chars").alias("log_chars"), count(r"[^\s]+").alias("words"), count(r"\n").alias("lines"), count("[0-9]").alias("digits"),
        count("[A-Z]").alias("capitals"), count("[.,;:!?]").alias("marks"), count("[aeiouy]").alias("vowels"), S.ratio(F.col("n_chars").cast("double"), count(r"[^\s]+")).alias("mean_word"),
    )
    labels = T.table(spark, d, "labels").select(F.col("doc_id").alias("call_id"), "quality", "toxic")
    return docs.join(labels, "call_id")


def folded(x: DataFrame, k: int) -> DataFrame:
    """Folds that keep clips whole; a null clip is one too. Written, as each fit reads it."""
    f = cohort.group_folds(x, "clip", k).select(F.col("clip").alias("c"), "fold")
    return written(x.join(f, F.col("clip").eqNullSafe(F.col("c"))).drop("c"), "fit-rows")


def arm_losses(oof: DataFrame, arms: list[str], y: str = "y") -> DataFrame:
    """(arm, n, loss) over all held-out rows."""
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.col(a).alias("p")) for a in arms))).alias("x")
    t = oof.where(F.col(y).isNotNull()).select(F.col(y).alias("y"), each).select("y", "x.*").where("p is not null")
    return t.groupBy("arm").agg(F.count("*").alias("n"), F.avg(S.log_loss(F.col("y"), F.col("p"))).alias("loss"))


@query()
def fit4_nested_penalty(spark: SparkSession, d: str) -> DataFrame:
    """C chosen on inner folds, for two targets and two arms: 180 inner and 60 outer fits in one call; the choices, and the loss of the chosen fits on their outer fold."""
    x = folded(texts(spark, d), 5)
    arms = {"m0": list(BASE), "m1": [*BASE, *MARKS]}
    _, choices, out = models.nested_cv(x, "clip", arms, ["quality", "toxic"], ["label"], one_class="rate")
    each = F.explode(F.array(*(F.struct(F.lit(y).alias("target"), F.lit(a).alias("arm"), F.col(y).alias("y"), F.col(f"{y}_{a}").alias("p")) for y in ("quality", "toxic") for a in arms))).alias("x")
    held = out.select("fold", each).select("fold", "x.*").where("y is not null and p is not null").groupBy("target", "arm", "fold")
    held = held.agg(F.count("*").alias("n"), F.avg(S.log_loss(F.col("y"), F.col("p"))).alias("outer_loss"))
    return six(choices.join(held, ["target", "arm", "fold"]).withColumnRenamed("loss", "inner_loss"), "inner_loss", "outer_loss")


@query()
def fit7_mask_ablation(spark: SparkSession, d: str) -> DataFrame:
    """An arm for each mask of the measures, fitted on the same folds: losses, and what each adds to the base."""
    x = folded(texts(spark, d).withColumnRenamed("quality", "y"), 5)
    masks = {"all": "", "counts": "^(lines|digits|marks)$", "letters": "^(capitals|vowels)$", "length": "^mean_word$"}
    named = x.select(*MARKS)
    arms = {"base": list(BASE)} | {f"with_{m}": [*BASE, *T.feature_columns(named, include=p)] for m, p in masks.items()}
    arms |= {f"without_{m}": [*BASE, *T.feature_columns(named, exclude=p)] for m, p in masks.items() if p}
    losses = arm_losses(models.arms_cv(x, arms, ["label"], one_class="rate"), list(arms))
    base = losses.where("arm = 'base'").select(F.col("loss").alias("base_loss"))
    return six(losses.join(F.broadcast(base)).withColumn("gain", F.col("base_loss") - F.col("loss")), "loss", "base_loss", "gain")  # one row


@query()
def fit8_populations(spark: SparkSession, d: str) -> DataFrame:
    """Models trained on all rows or on valid ones over the same folds, scored on all, valid and rejected rows."""
    x = folded(texts(spark, d).withColumnRenamed("quality", "y"), 5)
    out = models.populations_cv(x, BASE, MARKS, ["label"], one_class="rate")
    views = {"full_train_all_test": ("full", F.lit(True)), "full_train_valid_test": ("full", F.col("valid")), "valid_train_valid_test": ("valid", F.col("valid")), "full_train_rejected_test": ("full", ~F.col("valid"))}
    each = F.filter(F.array(*(F.when(m, F.struct(F.lit(v).alias("view"), F.col(f"{p}_m0").alias("m0"), F.col(f"{p}_m1").alias("m1"))) for v, (p, m) in views.items())), lambda s: s.isNotNull())
    t = written(out.where("y is not null").select("y", F.explode(each).alias("x")).select("y", "x.*"), "fit8-views")
    losses = metrics.losses(t, ["view"])
    auc = [metrics.ranking(t, ["view"], m).select("view", F.col("auc").alias(f"auc_{m}")) for m in ("m0", "m1")]
    return six(losses.join(auc[0], "view", "left").join(auc[1], "view", "left"), "loss0", "loss1", "delta", "auc_m0", "auc_m1")


@query()
def fit9_permutation_refits(spark: SparkSession, d: str) -> DataFrame:
    """The measures dealt anew within each label, 19 times, and both targets' models refitted each time: the null of the gain, and where the gain lies in it."""
    draws, k = 19, 3
    x = folded(texts(spark, d).where("label is not null"), k)
    each = x.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    each = each.withColumns({"within": F.concat_ws("|", "label", "draw"), "key": F.col("call_id") * 32 + F.col("draw")})
    moved = metrics.shuffled_within(each, "within", "key", list(MARKS)).drop("within", "key")
    t = written(x.withColumn("draw", F.lit(0)).unionByName(moved), "fit9-rows")
    sets = {f"{kind}{f}_{r}": (F.col("draw") == r) & ((F.col("fold") != f) if kind == "train" else (F.col("fold") == f)) for r in range(draws + 1) for f in range(1, k + 1) for kind in ("train", "test")}
    name = lambda r: "seen" if r == 0 else f"draw{r}"
    fits = [Fit(f"{y}|{name(r)}|{f}", f"train{f}_{r}", f"test{f}_{r}", y, (*BASE, *MARKS), ("label",)) for y in ("quality", "toxic") for r in range(draws + 1) for f in range(1, k + 1)]
    fits += [Fit(f"{y}|base|{f}", f"train{f}_0", f"test{f}_0", y, BASE, ("label",)) for y in ("quality", "toxic") for f in range(1, k + 1)]
    fitted = newton.solve(t.withColumns(sets), fits, ["call_id"], one_class="rate")
    parts = F.split("model", r"\|")
    loss = S.log_loss(F.col("y"), F.col("p")[1])
    sums = fitted.predictions().where("y is not null").groupBy(parts[0].alias("target"), parts[1].alias("arm")).agg(F.avg(loss).alias("loss"))
    sums = written(sums, "fit9-losses")  # a row an arm and target
    fitted.close()
    base = sums.where("arm = 'base'").select("target", F.col("loss").alias("base"))
    gain = sums.join(base, "target").select("target", "arm", (F.col("base") - F.col("loss")).alias("x"))
    seen = gain.where("arm = 'seen'").select("target", "x")
    null = metrics.null_summary(gain.where("arm like 'draw%'").drop("arm"), seen, ["target"])
    return six(null.join(seen.withColumnRenamed("x", "gain"), "target"), "mean", "sd", "low", "high", "p_value", "gain")


@query()
def fit10_oracle_parent(spark: SparkSession, d: str) -> DataFrame:
    """Generated outcomes fitted without and with the score that made them: what the measures add in either case, by scenario."""
    x = written(texts(spark, d).where("clip is not null"), "fit10-texts")  # 32 passes look for intercepts: over measures, not texts
    x = written(inference.zscored(x, ["log_chars", "words"]), "fit10-scaled")
    g = None
    for name, weights in inference.SCENARIOS.items():
        t = inference.scores(x, "log_chars", "words", weights, 1)
        p = inference.expit(F.col("score") + F.lit(inference.intercept(t, "score", 0.3)))
        y = (inference.uniform(F.lit(1), F.lit(name), F.col("call_id")) < p).cast("int")
        part = t.select("call_id", F.col("score").alias(f"parent_{name}"), y.alias(f"y_{name}"))
        g = part if g is None else g.join(part, "call_id")
    rows, folds, _ = models.fold_sets(folded(x.join(g, "call_id"), 5))
    arms = {"standard_m0": BASE, "standard_m1": (*BASE, *MARKS)}
    fits = []
    for name in inference.SCENARIOS:
        parents = {f"oracle_{a[-2:]}": (*columns, f"parent_{name}") for a, columns in arms.items()}
        fits += [Fit(f"{name}|{a}|{f}", f"train{f}", f"test{f}", f"y_{name}", tuple(columns), ("label",)) for a, columns in (arms | parents).items() for f in folds]
    fitted = newton.solve(rows, fits, ["call_id"], one_class="rate")
    parts = F.split("model", r"\|")
    arm = F.split(parts[1], "_")
    t = fitted.predictions().select(parts[0].alias("scenario"), arm[0].alias("kind"), arm[1].alias("m"), S.log_loss(F.col("y"), F.col("p")[1]).alias("loss"))
    mean = lambda m: F.avg(F.when(F.col("m") == m, F.col("loss")))
    out = written(t.groupBy("scenario", "kind").agg(mean("m0").alias("loss0"), mean("m1").alias("loss1")), "fit10-losses")
    fitted.close()
    return six(out.withColumn("delta", F.col("loss0") - F.col("loss1")), "loss0", "loss1", "delta")


@query()
def mlt6_logistic_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients on scaled columns at three penalties, of all labelled documents."""
    x = texts(spark, d).withColumn("all", F.lit(True))
    fits = [Fit(f"C={c}", "all", "all", "quality", (*BASE, *MARKS), ("label",), c) for c in (0.1, 1.0, 10.0)]
    fitted = newton.solve(x, fits)
    out = fitted.coefficients()
    fitted.close()
    return six(out, "value")


@query()
def mlt11_linear_probe(spark: SparkSession, d: str) -> DataFrame:
    """Labels of vectors from a softmax with balanced weights, held out in five folds by hash: balanced accuracy and macro F1."""
    v = T.vectors(spark, d).select("id", F.col("label").alias("y"), "v")
    size = v.agg(F.max(F.size("v"))).first()[0]
    classes = v.agg(F.max("y")).first()[0] + 1
    fold = (F.conv(F.substring(S.seeded(3, F.col("id")), 1, 8), 16, 10).cast("long") % 5 + 1).cast("int")
    x = v.select("id", "y", fold.alias("fold"), *(F.col("v")[k].alias(f"v{k}") for k in range(size)))
    return six(metrics.confusion_scores(models.probe_cv(x, [f"v{k}" for k in range(size)], classes), "y", "guess"), "balanced_accuracy", "macro_f1")


@query()
def mlt18_subset_arms(spark: SparkSession, d: str) -> DataFrame:
    """Models of a few configuration columns, of the others, of all, and of all as principal components, on the same folds."""
    x = folded(texts(spark, d).withColumnRenamed("quality", "y"), 5)
    few = ("lines", "digits", "mean_word")
    arms = {"base": BASE, "few": (*BASE, *few), "others": (*BASE, *(c for c in MARKS if c not in few)), "whole": (*BASE, *MARKS), "axes": BASE}
    oof = models.arms_cv(x, arms, ["label"], axes={"axes": (MARKS, 3)}, one_class="rate")
    return six(arm_losses(oof, list(arms)), "loss")


@query()
def agg20_refit_seeds(spark: SparkSession, d: str) -> DataFrame:
    """The gain of the measures under folds dealt by three seeds, all 30 fits in one call: number, mean and range over the seeds."""
    x = texts(spark, d).withColumnRenamed("quality", "y")
    seeds, k = (1, 2, 3), 5
    for seed in seeds:
        f = cohort.group_folds(x, "clip", k, seed).select(F.col("clip").alias("c"), F.col("fold").alias(f"fold{seed}"))
        x = x.join(f, F.col("clip").eqNullSafe(F.col("c"))).drop("c")
    sets = {f"{kind}{seed}_{f}": (F.col(f"fold{seed}") != f) if kind == "train" else (F.col(f"fold{seed}") == f) for seed in seeds for f in range(1, k + 1) for kind in ("train", "test")}
    arms = {"m0": BASE, "m1": (*BASE, *MARKS)}
    fits = [Fit(f"{seed}|{a}|{f}", f"train{seed}_{f}", f"test{seed}_{f}", "y", columns, ("label",)) for seed in seeds for a, columns in arms.items() for f in range(1, k + 1)]
    fitted = newton.solve(x.withColumns(sets), fits, ["call_id"], one_class="rate")
    parts = F.split("model", r"\|")
    mean = lambda a: F.avg(F.when(parts[1] == a, S.log_loss(F.col("y"), F.col("p")[1])))
    g = written(fitted.predictions().where("y is not null").groupBy(parts[0].alias("seed")).agg((mean("m0") - mean("m1")).alias("gain")), "agg20-gains")
    fitted.close()
    return six(g.agg(F.count("*").alias("seeds"), F.avg("gain").alias("mean"), F.min("gain").alias("least"), F.max("gain").alias("most")), "mean", "least", "most")
