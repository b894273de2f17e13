"""Models: exact median imputation, population scaling, one-hot, splines, logistic regression at C, boosted trees, grouped cross-validation, k-means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import log_loss, ratio
from ..sources.shared import dropped, written
from . import cohort, newton
from . import trees as boosting
from .metrics import chosen
from .newton import Fit
from .ranks import quantiles

FORBIDDEN = ("y", "fold", "clip", "call_id", "target")


class Design:
    """Medians, means and scales of numeric columns and the levels of others, learned from training rows.

    A category may have any number of levels: they are sparse positions of the vector,
    and a level that training lacks has none.
    """

    def __init__(self, train: DataFrame, numeric: Sequence[str], categories: Sequence[str]):
        if bad := [c for c in (*numeric, *categories) if c in FORBIDDEN]:
            raise ValueError(f"not to be used as inputs: {bad}")
        long = train.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in numeric))).alias("u")).select("u.*") if numeric else None
        med = {r["name"]: r["median"] for r in quantiles(long, ["name"], "x", {"median": 0.5}).collect()} if numeric else {}
        self.median = {c: med[c] for c in numeric if c in med}  # columns without any value go
        filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(m))) for c, m in self.median.items()}
        stats = train.agg(*(f(x).alias(f"{n}_{c}") for c, x in filled.items() for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first() if filled else None
        self.scale = {c: (stats[f"m_{c}"] or 0.0, stats[f"s_{c}"] or 1.0) for c in filled}
        self.categories = [*categories]
        self.indexer = self.encoder = None
        if categories:
            texts = train.select(*(F.col(c).cast("string").alias(f"{c}__s") for c in categories))
            self.indexer = StringIndexer(inputCols=[f"{c}__s" for c in categories], outputCols=[f"{c}__at" for c in categories], handleInvalid="keep", stringOrderType="alphabetAsc").fit(texts)
            # the last index stands for levels that training lacks, and dropLast makes it all zeros
            self.encoder = OneHotEncoder(inputCols=[f"{c}__at" for c in categories], outputCols=[f"{c}__hot" for c in categories], dropLast=True).fit(self.indexer.transform(texts))

    def state(self) -> dict:
        """What was learned, as plain values."""
        return {"median": self.median, "scale": self.scale, "levels": dict(zip(self.categories, map(list, self.indexer.labelsArray), strict=True)) if self.indexer else {}}

    def applied(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Adds the features as one vector."""
        parts = [(F.coalesce(F.col(c).cast("double"), F.lit(float(m))) - self.scale[c][0]) / self.scale[c][1] for c, m in self.median.items()]
        out = df.withColumn("numbers__", array_to_vector(F.array(*parts) if parts else F.array().cast("array<double>")))
        inputs = ["numbers__"]
        if self.indexer:
            own = [f"{c}__s" for c in self.categories]
            out = out.withColumns({s: F.col(c).cast("string") for s, c in zip(own, self.categories, strict=True)})
            at = self.indexer.transform(out)
            hot = [f"{c}__hot" for c in self.categories]
            out = self.encoder.transform(at)
            inputs += hot
        return VectorAssembler(inputCols=inputs, outputCol=features).transform(out).select(*df.columns, features)


def spline_columns(x: Column, low: float, high: float, knots: int = 5, degree: int = 3) -> list[Column]:
    """B-spline basis of one column: uniform knots from low to high, and the end values beyond them (Cox-de Boor)."""
    step = (high - low) / (knots - 1)
    at = [low + step * (k - degree) for k in range(knots + 2 * degree)]
    x = F.least(F.greatest(x.cast("double"), F.lit(low)), F.lit(high))
    inner = degree + knots - 2  # the last interval that the data fill, closed at its upper end
    basis = [((x >= at[k]) & ((x <= at[k + 1]) if k == inner else (x < at[k + 1]))).cast("double") if k <= inner else F.lit(0.0) for k in range(len(at) - 1)]
    for d in range(1, degree + 1):
        basis = [(x - at[k]) / (at[k + d] - at[k]) * basis[k] + (at[k + d + 1] - x) / (at[k + d + 1] - at[k + 1]) * basis[k + 1] for k in range(len(at) - d - 1)]
    return basis


def fold_sets(df: DataFrame, fold: str = "fold", within: Column | None = None) -> tuple[DataFrame, list[int], list[str]]:
    """The table with train{f} and test{f} for each fold f (of the rows ``within``, where given), the folds, and the names added. Rows without a fold are in neither."""
    folds = [r[0] for r in df.select(fold).where(F.col(fold).isNotNull()).distinct().orderBy(fold).collect()]  # a few numbers
    inside = F.lit(True) if within is None else within
    added = {f"{kind}{f}": (F.col(fold) != f if kind == "train" else F.col(fold) == f) & inside for f in folds for kind in ("train", "test")}
    return df.withColumns(added), folds, list(added)


def arms_cv(df: DataFrame, arms: dict[str, Sequence[str]], categories: Sequence[str], c: float = 1.0, y: str = "y", axes: dict[str, tuple[Sequence[str], int]] | None = None, one_class: str = "raise") -> DataFrame:
    """Out-of-fold probabilities of each arm, a column each, beside the rows that have a fold; an arm is a list of numeric columns, all are fitted together.

    ``axes`` gives an arm further columns as principal components. The result is a written table.
    """
    t, folds, _ = fold_sets(df)
    own = {a: (tuple(x), k) for a, (x, k) in (axes or {}).items()}
    fits = [Fit(f"{a}|{f}", f"train{f}", f"test{f}", y, tuple(x), tuple(categories), c, axes=own.get(a)) for a, x in arms.items() for f in folds]
    if not fits:
        return df.where("fold is not null").withColumns({a: F.lit(None).cast("double") for a in arms})
    fitted = newton.solve(t, fits, df.columns, one_class)
    out = written(fitted.held_out({a: [f"{a}|{f}" for f in folds] for a in arms}).where("fold is not null"), "held-out")
    fitted.close()
    return out


def paired_cv(df: DataFrame, base: Sequence[str], extra: Sequence[str], categories: Sequence[str], c: float = 1.0, trees: int = 0) -> DataFrame:
    """Out-of-fold probabilities m0 (base) and m1 (base and extra) of each row; all that is learned comes from the other folds.

    With ``trees`` the models are that many boosted trees, else logistic ones.
    """
    if not trees:
        return arms_cv(df, {"m0": base, "m1": [*base, *extra]}, categories, c)
    t, folds, _ = fold_sets(df)
    fits = [Fit(f"{a}|{f}", f"train{f}", f"test{f}", "y", tuple(x), tuple(categories)) for a, x in (("m0", base), ("m1", [*base, *extra])) for f in folds]
    fitted = boosting.boost(t, fits, df.columns, boosting.Settings(rounds=trees))
    out = written(fitted.held_out({a: [f"{a}|{f}" for f in folds] for a in ("m0", "m1")}).where("fold is not null"), "trees-held-out")
    fitted.close()
    return out


def nested_cv(df: DataFrame, group: str, arms: dict[str, Sequence[str]], targets: Sequence[str], categories: Sequence[str], cs: Sequence[float] = (1.0, 0.1, 10.0), inner: int = 3, one_class: str = "raise") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores, choices, held out) of a penalty chosen inside each outer fold, for every target and arm.

    Within the rows outside an outer fold, inner folds keep groups whole; each C is fitted
    on all but one of them and scored on it. The C with the least pooled loss (of exact ties
    the one declared first) is taken for the outer fold's fit. Inner and outer fits are
    solved together; of the outer ones those with the chosen C are used.
    scores: (target, arm, fold, c, inner_fold, n, loss_sum); choices: (target, arm, fold, c,
    loss, ties); held out: the rows with a column {target}_{arm} each.
    """
    df = df.where("fold is not null")
    outer = cohort.nested_folds(df.select(group, "fold").distinct(), df, group, inner)
    wide = outer.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("outer_fold", "inner_fold"))).alias("inner__"))
    right = wide.withColumnRenamed(group, "group__")
    t, folds, _ = fold_sets(df.join(right, F.col(group).eqNullSafe(F.col("group__")), "left").drop("group__"))
    fits, spec = [], {}
    sets = {}
    for f in folds:
        place = F.element_at("inner__", F.lit(f))
        for i in range(1, inner + 1):
            sets |= {f"train{f}_{i}": (F.col("fold") != f) & (place != i), f"test{f}_{i}": (F.col("fold") != f) & (place == i)}
        for y in targets:
            for a, columns in arms.items():
                for c in cs:
                    fits.append(Fit(f"{y}|{a}|{f}|{c}", f"train{f}", f"test{f}", y, tuple(columns), tuple(categories), c))
                    for i in range(1, inner + 1):
                        fits.append(Fit(f"{y}|{a}|{f}|{c}|{i}", f"train{f}_{i}", f"test{f}_{i}", y, tuple(columns), tuple(categories), c))
                        spec[fits[-1].name] = (y, a, f, float(c), i)
    fitted = newton.solve(t.withColumns(sets), fits, df.columns, one_class)
    loss = log_loss(F.col("y"), F.col("p")[1])
    long = fitted.predictions([f for f in fits if f.name in spec]).where("y is not null").groupBy("model").agg(F.count("*").alias("n"), F.sum(loss).alias("loss_sum"))
    names = df.sparkSession.createDataFrame([(m, *x) for m, x in spec.items()], "model string, target string, arm string, fold int, c double, inner_fold int")
    scores = written(long.join(F.broadcast(names), "model").drop("model"), "nested-scores")  # a row a fit
    by = ["target", "arm", "fold"]
    pooled_loss = scores.groupBy(*by, "c").agg((F.sum("loss_sum") / F.sum("n")).alias("l"))
    ties = pooled_loss.join(pooled_loss.groupBy(*by).agg(F.min("l").alias("least")), by).groupBy(*by).agg(F.count_if(F.col("l") == F.col("least")).alias("ties"))
    choices = chosen(scores, by, cs).join(ties, by)
    picked: dict[str, list[str]] = {f"{y}_{a}": [] for y in targets for a in arms}
    for r in choices.collect():  # a row a target, arm and fold
        picked[f"{r.target}_{r.arm}"].append(f"{r.target}|{r.arm}|{r.fold}|{r.c}")
    out = written(fitted.held_out(picked), "nested-held-out")
    fitted.close()
    return scores, choices, out


def populations_cv(df: DataFrame, base: Sequence[str], extra: Sequence[str], categories: Sequence[str], valid: str = "valid", one_class: str = "raise") -> DataFrame:
    """Held-out full_m0, full_m1, valid_m0, valid_m1: trained on all rows or on valid ones, over the same folds; the valid models test valid rows alone."""
    t, folds, _ = fold_sets(df)
    v = F.coalesce(F.col(valid), F.lit(False))
    t = t.withColumns({f"{kind}v{f}": F.col(f"{kind}{f}") & v for f in folds for kind in ("train", "test")})
    arms = {"m0": tuple(base), "m1": (*base, *extra)}
    fits = [Fit(f"{p}_{a}|{f}", f"train{k}{f}", f"test{k}{f}", "y", x, tuple(categories)) for p, k in (("full", ""), ("valid", "v")) for a, x in arms.items() for f in folds]
    fitted = newton.solve(t, fits, df.columns, one_class)
    out = written(fitted.held_out({f"{p}_{a}": [f"{p}_{a}|{f}" for f in folds] for p in ("full", "valid") for a in arms}).where("fold is not null"), "populations")
    fitted.close()
    return out


def probe_cv(df: DataFrame, columns: Sequence[str], classes: int, y: str = "y") -> DataFrame:
    """(df's columns, guess): held-out classes of a softmax with balanced class weights."""
    t, folds, _ = fold_sets(df)
    fits = [Fit(f"probe|{f}", f"train{f}", f"test{f}", y, tuple(columns), balanced=True, classes=classes) for f in folds]
    fitted = newton.solve(t, fits, df.columns)
    best = F.array_position("p", F.array_max("p")).cast("int") - 1
    out = written(fitted.predictions().select(*df.columns, best.alias("guess")), "probe")
    fitted.close()
    return out


def transform_state(df: DataFrame, numeric: Sequence[str], categories: Sequence[str] = ()) -> DataFrame:
    """(fold, name, median, mean, sd, n): what each fold's transforms learn, from the rows of the other folds alone."""
    df = written(df, "state-rows")
    folds = [r[0] for r in df.select("fold").distinct().orderBy("fold").collect()]  # a few numbers
    out = []
    for f in folds:
        train = df.where(F.col("fold") != f)
        d, n = Design(train, numeric, categories), train.count()
        out += [(int(f), c, float(d.median[c]), float(d.scale[c][0]), float(d.scale[c][1]), n) for c in d.median]
    dropped(df)
    return df.sparkSession.createDataFrame(out, "fold int, name string, median double, mean double, sd double, n long")


def threshold_scores(oof: DataFrame, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Balanced accuracy and macro F1 at the prevalence of the other folds as threshold."""
    n = oof.groupBy("fold").agg(F.count("*").alias("n__"), F.sum("y").alias("k__"))
    w = Window.partitionBy(F.lit(1))  # a row a fold
    n = n.select(F.col("fold").alias("f__"), ratio(F.sum("k__").over(w) - F.col("k__"), F.sum("n__").over(w) - F.col("n__")).alias("cut__"))
    t = oof.join(F.broadcast(n), F.col("fold") == F.col("f__")).withColumn("g__", (F.col(p) >= F.col("cut__")).cast("int"))
    y, g = F.col("y"), F.col("g__")
    c = t.groupBy(*by).agg(F.count_if((y == 1) & (g == 1)).alias("tp"), F.count_if((y == 0) & (g == 1)).alias("fp"), F.count_if((y == 0) & (g == 0)).alias("tn"), F.count_if((y == 1) & (g == 0)).alias("fn"))
    f1 = lambda a: F.coalesce(ratio(2 * F.col(a), 2 * F.col(a) + F.col("fp") + F.col("fn")), F.lit(0.0))
    ba = (ratio(F.col("tp"), F.col("tp") + F.col("fn")) + ratio(F.col("tn"), F.col("tn") + F.col("fp"))) / 2
    return c.select(*by, "tp", "fp", "tn", "fn", ba.alias("balanced_accuracy"), ((f1("tp") + f1("tn")) / 2).alias("macro_f1"))


def pooled(oof: DataFrame) -> DataFrame:
    """One row: mean losses over all held-out rows, and the gain."""
    y = F.col("y")
    g = oof.agg(F.count("*").alias("n"), F.avg(log_loss(y, F.col("m0"))).alias("loss0"), F.avg(log_loss(y, F.col("m1"))).alias("loss1"))
    return g.withColumn("delta", F.col("loss0") - F.col("loss1"))


def clustered(df: DataFrame, k: int, seed: int = 1, v: str = "v") -> DataFrame:
    """(id, cluster): k-means."""
    x = df.select("id", array_to_vector(v).alias("features"))
    return KMeans(k=k, seed=seed, predictionCol="cluster").fit(x).transform(x).select("id", "cluster")
