"""Clusters by density: a spanning tree of mutual reachability, its hierarchy, and cuts of it at many settings.

A vector's core distance is that to its k-th nearest other vector; two vectors reach each
other at the largest of their core distances and their own distance. The hierarchy of
what is connected up to a distance is condensed to clusters of a least size, of which some are chosen.

How it is done at any size:

* **Tree.** Rows fall into blocks that are cells of space, and visit only blocks that may hold a nearer row or an edge
  of the tree (``cells``). Edges are ordered by (weight, smaller id, larger id), so that the tree is one.
* **Sweeps.** Edges are put in order in chunks of some 260,000. One chunk at a time is merged, from light to heavy, on the
  components that lighter chunks left; what a chunk changes has at most two rows an edge and is broadcast to the
  table of vectors. Going down the hierarchy, and up and down the tree of clusters, is done in chunks in the
  same way, so that no task and no driver holds more than one of them. A sweep reads the vectors' table
  once a chunk; sweeps end when all is connected.
* **Cuts.** Least sizes, choices and distances are rows of a table of settings that share one hierarchy.

Vectors that are null, empty or hold null or non-finite components take no part and are noise, as is a single vector. With
fewer than k others the farthest counts. Distances below FLOOR (equal rows) count as FLOOR, so that no density is infinite.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import ratio
from ..sources.shared import dropped, written
from . import cells
from .ranks import with_quantiles

FLOOR = 1e-12
#: Rows of a sweep's task, about; rows of a block of :mod:`cells`.
CHUNK, BLOCK = 1 << 18, 1000
#: A cut: clusters' least size, "eom" (excess of mass) or "leaf", and the distance below which clusters aren't split.
Setting = tuple[int, str, float]


def finite(df: DataFrame, v: str = "v") -> DataFrame:
    """Rows whose vector has components, all of them finite."""
    ok = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(v).isNotNull() & ok)


def _merged(offset: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A chunk of edges between components: the merges they make, and what components become."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["w", "a", "b"])
        up: dict[int, int] = {}
        state: dict[int, tuple] = {}  # component: its last merge (or -1), size

        def find(c: int) -> int:
            root = c
            while up.get(root, root) != root:
                root = up[root]
            while up.get(c, c) != root:
                up[c], c = root, up[c]
            return root

        out = []
        for w, ca, ta, na, cb, tb, nb in g[["w", "comp_a", "top_a", "size_a", "comp_b", "top_b", "size_b"]].itertuples(index=False):
            for c, t, n in ((ca, ta, na), (cb, tb, nb)):
                up.setdefault(c, c)
                state.setdefault(c, (t, n))
            p, q = sorted((find(ca), find(cb)))
            if p != q:
                (tp, np_), (tq, nq) = state[p], state[q]
                rank = offset + len(out)
                out.append(("merge", rank, w, tp, tq, p if tp < 0 else 0, q if tq < 0 else 0, np_, nq))
                up[q], state[p] = p, (rank, np_ + nq)
        for c in list(up):
            r = find(c)
            out.append(("map", c, 0.0, state[r][0], -1, r, 0, state[r][1], 0))
        return pd.DataFrame(out, columns=["kind", "key", "w", "left", "right", "left_id", "right_id", "n_left", "n_right"])

    return run


_MERGES = "kind string, key long, w double, left long, right long, left_id long, right_id long, n_left long, n_right long"


def hierarchy(points: DataFrame, edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(rank, w, left, right, left_id, right_id, n_left, n_right): merges from light to heavy.

    A side is an earlier merge by its rank, or -1 and the id of a vector.
    """
    n = points.count()
    state = points.select("id", F.col("id").alias("comp"), F.lit(-1).cast("long").alias("top"), F.lit(1).cast("long").alias("size"))
    e = written(edges, "edges")
    parts = max(1, -(-e.count() // chunk))
    e, found_edges = e.withColumn("chunk", F.lit(0)), e
    if parts > 1:
        e = written(found_edges.repartitionByRange(parts, "w", "a", "b").withColumn("chunk", F.spark_partition_id()), "edges-in-order")
    done, found = [], 0
    for c in range(parts):
        if found >= n - 1:
            break
        side = lambda s: state.select(F.col("id").alias(s), F.col("comp").alias(f"comp_{s}"), F.col("top").alias(f"top_{s}"), F.col("size").alias(f"size_{s}"))  # noqa: B023, E731
        j = e.where(F.col("chunk") == c).join(side("a"), "a").join(side("b"), "b").where("comp_a <> comp_b")
        out = written(j.groupBy(F.lit(0).alias("all")).applyInPandas(_merged(found), _MERGES), "merges")
        done.append(out)
        found += out.where("kind = 'merge'").count()
        change = out.where("kind = 'map'").select(F.col("key").alias("comp"), F.col("left_id").alias("to"), F.col("left").alias("now"), F.col("n_left").alias("many"))
        old, moved = state, state.join(F.broadcast(change), "comp", "left")  # two rows an edge of the chunk at most
        state = moved.select("id", F.coalesce("to", "comp").alias("comp"), F.coalesce("now", "top").alias("top"), F.coalesce("many", "size").alias("size"))
        if found < n - 1:
            state = written(state, "components")
            dropped(old)
    dropped(state)
    if not done:
        return points.sparkSession.createDataFrame([], _MERGES).withColumnRenamed("key", "rank").drop("kind")
    out = _together(done, "kind = 'merge'", "hierarchy").withColumnRenamed("key", "rank").drop("kind")
    dropped(e, found_edges)
    return out


def _together(tables: list[DataFrame], which: str, name: str) -> DataFrame:
    """Rows of the chunks' tables: as one table where there are several."""
    every = tables[0]
    if len(tables) == 1:
        return every.where(which)
    for t in tables[1:]:
        every = every.unionByName(t)
    out = written(every.where(which), name)
    dropped(*tables)
    return out


def _swept(nodes: DataFrame, key: str, by: Sequence[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, message: str, chunk: int, descending: bool) -> DataFrame:
    """``run`` on a chunk of nodes at a time, in order of their key; its rows of kind "message" reach later chunks as more rows of these.

    Nodes come with kind "node". A chunk has at most ``chunk`` keys, and gets the messages to them.
    """
    at = F.floor(F.col(key) / chunk)
    found = nodes.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    if found.a is None:
        return nodes.sparkSession.createDataFrame([], schema)
    order, types = range(found.a, found.b + 1), {f.name: f.dataType for f in StructType.fromDDL(schema)}
    done: list[DataFrame] = []
    for c in reversed(order) if descending else order:
        t = nodes.where(at == c).withColumn("kind", F.lit("node"))
        t = t.withColumns({k: F.lit(None).cast(types[k]) for k in message.split() if k not in t.columns})
        for earlier in done:
            t = t.unionByName(earlier.where((F.col("kind") == "message") & (at == c)).select(*by, "kind", *message.split()), allowMissingColumns=True)
        t = t.na.fill(0).na.fill(False)  # whole numbers with nulls would become doubles in pandas
        done.append(written(t.groupBy(*by).applyInPandas(run, schema), "sweep"))
    return _together(done, "kind <> 'message'", "swept")


_CONDENSED = "size int, kind string, rank long, cluster long, lam double, n long, split boolean, id long"


def _condensed(g: pd.DataFrame) -> pd.DataFrame:
    """Down a chunk of merges: clusters, at which density they split, and at which each vector leaves its cluster."""
    size, out = int(g["size"].iloc[0]), []
    heard = {int(r): (int(c), lam, bool(s)) for r, c, lam, s in g.loc[g["kind"] == "message", ["rank", "cluster", "lam", "split"]].itertuples(index=False)}
    nodes = g[g["kind"] == "node"].sort_values("rank", ascending=False)
    here = set(nodes["rank"])
    for r, w, left, right, li, ri, nl, nr in nodes[["rank", "w", "left", "right", "left_id", "right_id", "n_left", "n_right"]].itertuples(index=False):
        n, lam = nl + nr, 1.0 / max(w, FLOOR)
        told = heard.pop(r, None)
        if n >= size:
            cluster, birth, split = told or (-1, 0.0, True)
            if split:
                out.append(("cluster", r, cluster, birth, n, False, 0))
                cluster = r
            split = nl >= size and nr >= size
            if split:
                out.append(("split", r, cluster, lam, n, True, 0))
            told = cluster, lam, split
        else:
            told = told or (-1, 0.0, False)
            told = told[0], told[1], False
        for child, own in ((left, li), (right, ri)):
            if child < 0:
                out.append(("point", -1, told[0], told[1], 1, False, own))
            elif child in here:
                heard[child] = told
            else:
                out.append(("message", child, *told[:2], 0, told[2], 0))
    t = pd.DataFrame(out, columns=["kind", "rank", "cluster", "lam", "n", "split", "id"])
    t.insert(0, "size", size)
    return t


_RAISED = "size int, kind string, cluster long, value double, best boolean"


def _raised(g: pd.DataFrame) -> pd.DataFrame:
    """Up a chunk of clusters: which hold at least as much as the best of those below them."""
    size, below, out = int(g["size"].iloc[0]), {}, []
    for c, value in g.loc[g["kind"] == "message", ["cluster", "value"]].itertuples(index=False):
        below[c] = below.get(c, 0.0) + value
    nodes = g[g["kind"] == "node"].sort_values("cluster")
    here = set(nodes["cluster"])
    for c, parent, own in nodes[["cluster", "parent", "stability"]].itertuples(index=False):
        under = below.get(c)
        best = under is None or own >= under
        value = own if best else under
        out.append((size, "node", c, value, best))
        if parent in here:
            below[parent] = below.get(parent, 0.0) + value
        elif parent >= 0:
            out.append((size, "message", parent, value, False))
    return pd.DataFrame(out, columns=["size", "kind", "cluster", "value", "best"])


_CHOSEN = "size int, choice string, epsilon double, kind string, cluster long, chosen long"


def _chosen(g: pd.DataFrame) -> pd.DataFrame:
    """Down a chunk of clusters: the chosen one that each belongs to, or -1."""
    size, choice, epsilon = int(g["size"].iloc[0]), g["choice"].iloc[0], float(g["epsilon"].iloc[0])
    told = {int(c): int(x) for c, x in g.loc[g["kind"] == "message", ["cluster", "chosen"]].itertuples(index=False)}
    nodes, out = g[g["kind"] == "node"].sort_values("cluster", ascending=False), []
    here = set(nodes["cluster"])
    children: dict[int, list[int]] = {}
    for c, lower in nodes[["cluster", "lower"]].itertuples(index=False):
        children[c] = [] if lower is None else [int(x) for x in lower]
    for c, parent, best, split in nodes[["cluster", "parent", "best", "split"]].itertuples(index=False):
        mine = told.get(c, -1)
        if mine < 0 and parent >= 0:
            leaf = split == 0  # a density is above 0
            if (leaf if choice == "leaf" else best) or (not leaf and 1.0 / split < epsilon):
                mine = c
        out.append((size, choice, epsilon, "node", c, mine))
        for x in children[c]:
            if x in here:
                told[x] = mine
            else:
                out.append((size, choice, epsilon, "message", x, mine))
    return pd.DataFrame(out, columns=["size", "choice", "epsilon", "kind", "cluster", "chosen"])


def cuts(points: DataFrame, merges: DataFrame, settings: Sequence[Setting], chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(size, choice, epsilon, id, cluster, probability) of (id), and (size, choice, epsilon, cluster, n, stability, persistence).

    A cluster is called by its smallest member; noise has none, and probability 0. A vector's
    probability is the density at which it leaves over the largest that its cluster reaches, its persistence the
    stability over members times the largest density of all. The whole is never a cluster.
    """
    spark = points.sparkSession
    for size, choice, epsilon in settings:
        if size < 2 or choice not in ("eom", "leaf") or epsilon < 0:
            raise ValueError((size, choice, epsilon))
    key = ["size", "choice", "epsilon"]
    asked = spark.createDataFrame([(int(a), b, float(c)) for a, b, c in settings], "size int, choice string, epsilon double").distinct()
    sizes = F.broadcast(asked.select("size").distinct())  # a row a setting
    t = _swept(merges.crossJoin(sizes), "rank", ["size"], _condensed, _CONDENSED, "rank cluster lam split", chunk, True)
    leaves, born = t.where("kind = 'point'"), t.where("kind = 'cluster'").select("size", F.col("rank").alias("cluster"), F.col("cluster").alias("parent"), F.col("lam").alias("birth"))
    gone = t.where("kind <> 'cluster' and cluster >= 0").groupBy("size", "cluster").agg(F.sum(F.col("n") * F.col("lam")).alias("s"), F.sum("n").alias("k"), F.max("lam").alias("top"), F.max(F.when(F.col("split"), F.col("lam"))).alias("split"))
    lower = born.where("parent >= 0").groupBy("size", F.col("parent").alias("cluster")).agg(F.sort_array(F.collect_list("cluster")).alias("lower"))  # two a cluster
    tree = written(born.join(gone, ["size", "cluster"]).join(lower, ["size", "cluster"], "left").withColumn("stability", F.col("s") - F.col("k") * F.col("birth")), "clusters")
    best = _swept(tree.select("size", "cluster", "parent", "stability"), "cluster", ["size"], _raised, _RAISED, "cluster value", chunk, False)
    nodes = written(tree.select("size", "cluster", "parent", "split", "lower").join(best.select("size", "cluster", "best"), ["size", "cluster"]).join(F.broadcast(asked), "size"), "cluster-nodes")
    chosen = _swept(nodes, "cluster", key, _chosen, _CHOSEN, "cluster chosen", chunk, True).where("chosen >= 0").drop("kind")
    dropped(nodes)
    own = tree.select("size", F.col("cluster").alias("chosen"), "top", "stability")
    member = leaves.select("size", "id", "cluster", "lam").join(chosen, ["size", "cluster"]).join(own, ["size", "chosen"])
    names = member.groupBy(*key, "chosen").agg(F.min("id").alias("name"), F.count("*").alias("n"), F.max("stability").alias("stability"))
    most = tree.groupBy("size").agg(F.max("top").alias("most"))
    found = names.join(F.broadcast(most), "size").select(*key, F.col("name").alias("cluster"), "n", "stability", (F.col("stability") / (F.col("n") * F.col("most"))).alias("persistence"))
    labelled = member.join(names.select(*key, "chosen", "name"), [*key, "chosen"]).select(*key, "id", F.col("name").alias("cluster"), (F.least("lam", "top") / F.col("top")).alias("probability"))
    every = points.select("id").crossJoin(F.broadcast(asked)).join(labelled, [*key, "id"], "left")
    return every.select(*key, "id", "cluster", F.coalesce("probability", F.lit(0.0)).alias("probability")), found


def clusters(df: DataFrame, samples: int, settings: Sequence[Setting], v: str = "v", block: int = BLOCK, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """:func:`cuts` of (id, v) with core distances to the ``samples``-th other vector."""
    points, boxes = cells.cores(finite(df.select("id", F.col(v).cast("array<double>").alias("v"))), samples, block)
    edges = cells.edges(points, boxes)
    merges = hierarchy(points.select("id"), edges, chunk)
    dropped(edges)
    out = cuts(df.select("id"), merges, settings, chunk)
    dropped(points)
    return out


def solution_stats(labels: DataFrame, found: DataFrame, by: Sequence[str] = ("size", "choice", "epsilon")) -> DataFrame:
    """(by, n_clusters, noise_rate, largest_share, median_size, mean_persistence, max_persistence); no clusters: 0 and nulls."""
    g = labels.groupBy(*by).agg(F.count("*").alias("rows"), F.avg(F.col("cluster").isNull().cast("double")).alias("noise_rate"))
    c = found.groupBy(*by).agg(F.count("*").alias("n_clusters"), F.max("n").alias("largest"), F.avg("persistence").alias("mean_persistence"), F.max("persistence").alias("max_persistence"))
    c = with_quantiles(c, found.select(*by, F.col("n").cast("double").alias("n")), list(by), "n", {"median_size": 0.5})
    j = g.join(c, list(by), "left").na.fill(0, ["n_clusters", "largest"])
    return j.select(*by, "n_clusters", "noise_rate", (F.col("largest") / F.col("rows")).alias("largest_share"), "median_size", "mean_persistence", "max_persistence")


def against(labels: DataFrame, truth: DataFrame, by: Sequence[str] = ("size", "choice", "epsilon")) -> DataFrame:
    """(by, label_ari): adjusted Rand index of each setting's clusters, noise as one of them, and the labels of (id, label); null where chance decides all."""
    t = labels.join(truth.select("id", "label"), "id")
    n = t.groupBy(*by, F.col("cluster").alias("c"), "label").agg(F.count("*").alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    side = lambda c, out: n.groupBy(*by, c).agg(F.sum("n").alias("m")).groupBy(*by).agg(pairs("m").alias(out))
    both = n.groupBy(*by).agg(pairs("n").alias("both"), F.sum("n").alias("rows"))
    g = both.join(side("c", "pc"), list(by)).join(side("label", "pl"), list(by))
    chance = ratio(F.col("pc") * F.col("pl"), F.col("rows") * (F.col("rows") - 1) / 2.0)
    return g.select(*by, ratio(F.col("both") - chance, (F.col("pc") + F.col("pl")) / 2 - chance).alias("label_ari"))
