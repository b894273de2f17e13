"""Queries on clusters by density, in the first three principal axes of the vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import density, inference, metrics, reports, spaces
from ..sources import tables as T
from ..sources.shared import written
from .common import register
from .event_queries import six

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)
AXES, NEIGHBOURS = 3, 5
CUT = (8, "leaf", 0.0)
GRID = [(size, choice, epsilon) for size in (5, 8, 20) for choice in ("eom", "leaf") for epsilon in (0.0, 0.05)]


def _space(spark: SparkSession, d: str) -> DataFrame:
    """(id, label, v) along the first axes."""
    v = written(T.vectors(spark, d).select("id", "label", "v"), "density-vectors")
    space = spaces.fitted(v, AXES)
    if space is None:
        return v.where("false")
    return written(spaces.projected(v, space, keep=("id", "label")).withColumnRenamed("z", "v"), "density-space")


@query()
def clu1_density(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's cluster, null for noise, and how surely it belongs to it."""
    labels, _ = density.clusters(_space(spark, d), NEIGHBOURS, [CUT])
    return six(labels.select("id", "cluster", "probability"), "probability")


@query()
def clu1_persistence(spark: SparkSession, d: str) -> DataFrame:
    """Clusters by smallest member, with their sizes and persistence."""
    _, found = density.clusters(_space(spark, d), NEIGHBOURS, [CUT])
    return six(found.select("cluster", "n", "persistence"), "persistence")


@query()
def clu2_density_grid(spark: SparkSession, d: str) -> DataFrame:
    """Solutions for two numbers of neighbours, each from one hierarchy: clusters, noise, sizes, persistence, agreement with the labels."""
    v, out = _space(spark, d), None
    for k in (NEIGHBOURS, 2 * NEIGHBOURS):
        labels, found = density.clusters(v, k, GRID)
        stats = density.solution_stats(labels, found).join(density.against(labels, v), ["size", "choice", "epsilon"]).withColumn("neighbours", F.lit(k))
        out = stats if out is None else out.unionByName(stats)
    return six(out, "noise_rate", "largest_share", "median_size", "mean_persistence", "max_persistence", "label_ari")


@query()
def clu2_grid_stability(spark: SparkSession, d: str) -> DataFrame:
    """How far solutions of the grid that have two clusters or more, and less than 95% noise, agree in pairs."""
    labels, found = density.clusters(_space(spark, d), NEIGHBOURS, GRID)
    kept = density.solution_stats(labels, found).where("n_clusters >= 2 and noise_rate < 0.95").select("size", "choice", "epsilon")
    name = F.concat_ws("|", F.format_string("%03d", "size"), "choice", F.col("epsilon").cast("string"))
    t = labels.join(F.broadcast(kept), ["size", "choice", "epsilon"])  # a row a setting
    return six(reports.solution_pairs(t.select(name.alias("setting"), "id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))), "ari")


@query()
def clu4_density_subsample(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of all vectors against those of a subsample by hash, over the subsample."""
    v = _space(spark, d)
    some = v.where(F.substring(S.seeded(5, F.col("id")), 1, 1) < "c")
    whole, _ = density.clusters(v, NEIGHBOURS, [CUT])
    part, _ = density.clusters(some, NEIGHBOURS, [CUT])
    cluster = lambda t, c: t.select("id", F.coalesce("cluster", F.lit(-1)).alias(c))
    both = written(cluster(part, "b").join(cluster(whole, "a"), "id"), "density-pair")
    agreement = metrics.agreement(both, "a", "b")
    return six(agreement.join(F.broadcast(both.agg(F.count("*").alias("n")))), *agreement.columns)  # one row each


@query()
def clu14_noise_protocols(spark: SparkSession, d: str) -> DataFrame:
    """Labels against clusters with noise as a cluster of its own, and without it: agreement, and the labels' silhouette."""
    v, out = _space(spark, d), None
    labels, _ = density.clusters(v, NEIGHBOURS, [CUT])
    t = written(v.join(labels.select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster")), "id"), "density-labels")
    for name, rows in (("include_noise", t), ("exclude_noise", t.where("cluster <> -1"))):
        g = rows.agg(F.count("*").alias("n"), F.countDistinct("label").alias("n_labels"), F.countDistinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("n_clusters"), F.avg((F.col("cluster") == -1).cast("double")).alias("noise_rate"))
        near = inference.silhouettes(rows, "label").agg(F.avg("s").alias("silhouette"))
        g = g.join(metrics.agreement(rows, "label", "cluster").select("ari", "purity")).join(inference.adjusted_information(rows, "label", "cluster").select("ami")).join(near)  # one row each
        g = g.withColumn("protocol", F.lit(name))
        out = g if out is None else out.unionByName(g)
    return six(out, "noise_rate", "ari", "purity", "ami", "silhouette")
