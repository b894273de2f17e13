"""Queries that fit models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohort, models, spaces
from ..sources import tables as T
from ..sources.shared import written
from .common import register
from .event_queries import six

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)


def _design(spark: SparkSession, d: str) -> DataFrame:
    p = T.predictions(spark, d).where("target = 'post'").select("call_id", "clip", "label", "fold", "y")
    docs = T.table(spark, d, "documents").select(F.col("doc_id").alias("call_id"), F.log1p("n_chars").alias("log_chars"), F.length("text").cast("double").alias("chars"), F.size(F.split("text", " ")).cast("double").alias("words"))
    return p.join(docs, "call_id")


def _refolded(x: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows with the fold of their clip; a null clip is one too."""
    f = folds.select(F.col("clip").alias("c"), F.col("cv").alias("fold"))
    return x.drop("fold").join(f, F.col("clip").eqNullSafe(F.col("c"))).drop("c")


@query()
def fit1_paired_grouped_cv(spark: SparkSession, d: str) -> DataFrame:
    """Held-out losses of a base and a wider logistic model over folds that keep sources whole."""
    x = _design(spark, d)
    folds = cohort.group_folds(x, "clip", 3).select("clip", F.col("fold").alias("cv"))
    oof = models.paired_cv(_refolded(x, folds), ["log_chars"], ["chars", "words"], ["label"])
    return six(models.pooled(oof), "loss0", "loss1", "delta")


@query()
def mlt4_pca(spark: SparkSession, d: str) -> DataFrame:
    """Share of variance that each of the first principal components of the embeddings explains."""
    v = written(T.vectors(spark, d).select("v"), "mlt4-vectors")
    return six(spaces.explained(v, 10), "share")


@query()
def mlt15_nested_spaces(spark: SparkSession, d: str) -> DataFrame:
    """Spaces of 5, 10, 30 and all axes from one fit: share of the variance, and mean squared length of the vectors in each."""
    v = written(T.vectors(spark, d).select("id", "v"), "mlt15-vectors")
    s = spaces.fitted(v)
    if s is None:
        return spark.createDataFrame([], "space string, axes int, share double, length double")
    out = None
    for k in (5, 10, 30, len(s.variances)):
        z = spaces.projected(v, s, k).where("z is not null")
        length = F.avg(F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x))
        name = "full" if k == len(s.variances) else f"pca{k}"
        part = z.agg(length.alias("length")).select(F.lit(name).alias("space"), F.lit(k).alias("axes"), F.lit(float(s.shares()[:k].sum())).alias("share"), "length")
        out = part if out is None else out.unionByName(part)
    return six(out, "share", "length")


@query()
def clu12_kmeans(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of k-means clusters of the embeddings."""
    return models.clustered(T.vectors(spark, d), 4, seed=1).groupBy("cluster").agg(F.count("*").alias("n"))
