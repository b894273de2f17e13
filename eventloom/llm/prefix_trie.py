"""Conversation prefix trie: succinct level-order tries of prefix shards, and a trie of heavy upper levels.

Every conversation is rebuilt (:func:`rebuilt`): the first h turns of the conversation
that heads its hundred, then its own turns after its first h. Tasks read a
conversation's turns in order and chain a digest of 128 bits over them, so that a
prefix is known by its depth's digest; texts stay where they were read.

A prefix with more than :func:`heavy_cap` conversations is heavy: these form the upper
levels, at most HEAVY nodes whatever the input's size. What is left below them are
light subtrees; each lies in one shard, told by the digest of its top. A prefix that one
conversation alone has is a tail, as in succinct tries: it isn't stored in a trie, but
described from the conversation's own row. So a shard has shared prefixes only.

A shard's task orders its nodes by level, writes the LOUDS bitvector (a one for each
child, a zero to end) and the labels (digests), takes parents from the bitvector by
rank and select, and adds up leaves and savings from the last level to the first with
``numpy.add.at``. The tops' sums are added by heavy parent, and the upper trie, of
bounded size, is rolled up in the same way.

The digest of the conversations that end at a node covers their ids in order. Ids of a
node with few are sorted in one expression; those of a node with more than ENDS are
sorted by range, rendered in pieces by many tasks, and one task hashes the pieces as
they come, which holds one piece at a time.

Values: null role or text is empty; null turns come first; rows of equal turn go by the
MD5 of role and text, and repeated rows are turns each. Rows with a null conv_id belong
to no conversation. A node's path of shared prefixes must fit its shard: some 100 bytes
a node. Heads are looked for by ``conv_id - conv_id % 100``, with the sign of Spark's
``%``. An empty table has no conversation and so no node, not even a root. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import temporary, written

ROOT = bytes(16)
#: Heavy nodes at most; conversations that a light node may have whatever the table's size.
HEAVY, LIGHT = 1 << 17, 4096
#: Nodes of a shard, about.
SHARD = 200_000
#: Ids that end at a node and are sorted in one expression, at most; ids of a piece.
ENDS, PIECE = 10_000, 50_000
#: Conversations that share a head; turns that may come from it are fewer than MOST.
HUNDRED, MOST = 100, 6
PATHS = "conv_id long, depth long, node binary, parent binary, chars long, last boolean"
NODES = "conv_id long, depth long, node binary, parent binary, n_convs long, chars long"
ROLLED = f"{NODES}, parent_conv_id long, n_children long, n_leaves long, saved_tokens long"


def rebuilt(rows: DataFrame) -> DataFrame:
    """(conv_id, skip, own, turn, digest, chars): the turns that a rebuilt conversation is made of.

    Rows with ``own`` follow those without; of the own rows, the first ``skip`` are to be left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = rows.where("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    skip = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    heads = turns.where(F.col("conv_id") % HUNDRED == 0).withColumn("place", F.row_number().over(order)).where(F.col("place") < MOST)
    heads = heads.select(F.col("conv_id").alias("head"), F.col("place").alias("turn"), "digest", "chars")
    convs = turns.select("conv_id").distinct().withColumn("skip", skip).withColumn("head", F.col("conv_id") - F.col("conv_id") % HUNDRED)
    first = convs.join(heads, "head").where(F.col("turn") <= F.col("skip"))
    first = first.select("conv_id", "skip", F.lit(False).alias("own"), F.col("turn").cast("long"), "digest", "chars")
    return first.unionByName(turns.select("conv_id", skip.alias("skip"), F.lit(True).alias("own"), F.col("turn").cast("long"), "digest", "chars"))


def paths(turns: DataFrame) -> DataFrame:
    """A row for each prefix of each conversation; ``last`` where the conversation ends. One without turns ends at the root, depth 0."""
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "own", F.asc_nulls_first("turn"), "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, depth, node, skip = None, 0, ROOT, 0
        row: tuple | None = None  # the conversation's last so far
        for b in batches:
            out: list[tuple] = []
            for c, left_out, own, digest, chars in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4, 5)), strict=True):
                if c != conv:
                    if row is not None:
                        out.append((*row, True))
                    conv, depth, node, skip = c, 0, ROOT, left_out
                    row = (c, 0, ROOT, None, 0)
                if own and skip:
                    skip -= 1
                    continue
                if depth:
                    out.append((*row, False))
                parent, depth = node, depth + 1
                node = hashlib.blake2b(parent + digest, digest_size=16).digest()
                row = (c, depth, node, parent, chars)
            if out:
                yield _batch(out)
        if row is not None:
            yield _batch([(*row, True)])

    return dealt.mapInArrow(run, PATHS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "depth", "node", "parent", "chars", "last"])


class Louds:
    """A forest in level order: bits, labels and what they tell of each node.

    The bits begin with those of a root above all trees: a one for each tree, a zero.
    """

    def __init__(self, node: np.ndarray, parent: np.ndarray, depth: np.ndarray):
        at = pd.Index(node)
        up = at.get_indexer(parent)
        high, low = np.frombuffer(b"".join(node), ">u8").reshape(-1, 2).T.astype(np.uint64)
        levels: list[np.ndarray] = []
        place = np.full(len(node), -1)
        n = 0
        by_depth = np.argsort(depth, kind="stable")
        cuts = np.flatnonzero(np.diff(depth[by_depth], prepend=-1)) if len(node) else np.zeros(0, int)
        for level in np.split(by_depth, cuts[1:]) if len(node) else []:
            # trees whose tops lie deeper come in where their depth does; a node's siblings lie together
            own = level[np.lexsort((low[level], high[level], np.where(up[level] < 0, -1, place[up[level]])))]
            place[own] = np.arange(n, n + len(own))
            n += len(own)
            levels.append(own)
        self.order = np.concatenate(levels) if levels else np.zeros(0, int)
        self.ends = np.cumsum([len(x) for x in levels]).astype(int)
        above = np.where(up[self.order] < 0, -1, place[up[self.order]])
        # tops of trees aside, the order by level is one by parent, and so the bits tell it
        self.tops = above < 0
        self.degrees = np.bincount(above[~self.tops], minlength=n)
        self.labels = node[self.order]
        below = np.flatnonzero(~self.tops)
        runs = np.r_[int(self.tops.sum()), self.degrees]
        self.bits = np.ones(int(runs.sum()) + n + 1, bool)
        self.bits[np.cumsum(runs + 1) - 1] = False
        self.parents = np.full(n, -1)
        ones = np.flatnonzero(self.bits)  # select: where the j-th one is
        rank = ones - np.arange(len(ones))  # zeros before it: whose child it is, the root above all being the first
        self.parents[below] = rank[int(self.tops.sum()) :] - 1

    def rolled(self, x: np.ndarray) -> np.ndarray:
        """Sums over subtrees, from the last level to the first."""
        x = x.copy()
        for a, b in reversed(list(zip(np.r_[0, self.ends[:-1]], self.ends, strict=True))):
            own = np.arange(a, b)[~self.tops[a:b]]
            np.add.at(x, self.parents[own], x[own])
        return x


def roll_up(t: pd.DataFrame) -> pd.DataFrame:
    """NODES with what the trie tells of each; ``more_*`` are children, leaves and savings below that aren't in the table."""
    node = np.array(t["node"].to_list() or [], object)
    parent = np.array([x if x is not None else b"" for x in t["parent"]], object)
    trie = Louds(node, parent, t["depth"].to_numpy(np.int64))
    t = t.iloc[trie.order]
    get = lambda c: t[c].to_numpy(np.int64)
    children = trie.degrees + get("more_children")
    leaves = trie.rolled((children == 0) + get("more_leaves"))
    saved = trie.rolled((get("n_convs") - 1) * get("chars") + get("more_saved"))
    conv = pd.array(get("conv_id"), dtype="Int64")
    up = conv.take(np.maximum(trie.parents, 0)) if len(conv) else conv
    up[trie.tops] = pd.NA
    out = t[["conv_id", "depth", "node", "parent", "n_convs", "chars"]].reset_index(drop=True)
    return out.assign(parent_conv_id=up, n_children=children, n_leaves=leaves, saved_tokens=saved)


def heavy_cap(rows: int) -> int:
    """Conversations that a light node may have: at most HEAVY nodes have more, as a row of ``paths`` counts for one node."""
    return max(LIGHT, -(-rows // HEAVY))


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id)."""
    spark = ends.sparkSession
    cap = max(ENDS, -(-ends.count() // HEAVY))
    hot = [r.node for r in ends.groupBy("node").count().where(F.col("count") > cap).select("node").collect()]  # HEAVY rows at most
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    digest = F.sha2(joined.cast("binary"), 256).alias("ends_sha256")
    if not hot:
        return ends.groupBy("node").agg(digest)
    names = F.broadcast(spark.createDataFrame([(x,) for x in hot], "node binary"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = np.array(b.column(0).to_pylist(), object)
            conv = b.column(1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, int)
            for a, z in zip(cuts, np.r_[cuts[1:], len(node)], strict=True):
                for k in range(a, z, PIECE):
                    piece = conv[k : min(z, k + PIECE)]
                    text = ",".join(map(str, piece.tolist())).encode()
                    yield pa.RecordBatch.from_arrays([pa.array([node[a]], pa.binary()), pa.array([piece[0]], pa.int64()), pa.array([text], pa.binary())], ["node", "first", "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, hashlib.sha256()
        one = lambda: pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])], ["node", "ends_sha256"])
        for b in batches:
            for own, piece in zip(b.column(0), b.column(2), strict=True):
                if own.as_py() != node:
                    if node is not None:
                        yield one()
                    node, sha = own.as_py(), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(piece.as_buffer())
        if node is not None:
            yield one()

    many = ends.join(names, "node", "left_semi").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = many.mapInArrow(render, "node binary, first long, piece binary")
    streamed = pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashed, "node binary, ends_sha256 string")
    return ends.join(names, "node", "left_anti").groupBy("node").agg(digest).unionByName(streamed)


def trie(rows: DataFrame) -> DataFrame:
    """All nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. The result is a written table."""
    with temporary():
        return written(_trie(rows), "trie-nodes", keep=True)


def _trie(rows: DataFrame) -> DataFrame:
    every = written(paths(rebuilt(rows.select("conv_id", "turn", "role", "text"))), "trie-paths")
    below = every.where("depth > 0")
    convs, smallest, total = every.agg(F.count_if("last"), F.min("conv_id"), F.count("*")).first()
    spark = rows.sparkSession
    out = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not convs:
        return spark.createDataFrame([], out)
    cap = heavy_cap(total)
    heavy = written(below.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > cap).select("node", F.lit(True).alias("heavy")), "trie-heavy")
    # the shard of a light prefix is told by the first light prefix on its path
    marked = below.join(F.broadcast(heavy), "node", "left")
    path = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = F.first(F.when(F.col("heavy").isNull(), F.col("node")), ignorenulls=True).over(path)
    nodes = marked.withColumn("top", top).groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.count("*").alias("n_convs"),
        F.min("chars").alias("chars"), F.bool_or("last").alias("last"), F.min("top").alias("top"),
    )
    nodes = written(nodes, "trie-prefixes")
    root = spark.createDataFrame([(smallest, 0, ROOT, None, convs, 0)], NODES)
    plain = ["conv_id", "depth", "node", "parent", "n_convs", "chars"]
    tails, shared = nodes.where("n_convs = 1"), nodes.where((F.col("n_convs") > 1) & (F.col("n_convs") <= cap))
    upper = written(nodes.where(F.col("n_convs") > cap).select(*plain).unionByName(root), "trie-upper")
    above = F.broadcast(upper.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    heads = tails.groupBy("parent").agg(F.count("*").alias("more_children"))

    # light subtrees: a node's tails are children that the trie doesn't hold
    bucket = F.pmod(F.xxhash64("top"), F.lit(-(-shared.count() // SHARD) or 1)).alias("shard")
    light = shared.join(heads.withColumnRenamed("parent", "node"), "node", "left").select(bucket, *plain, F.coalesce("more_children", F.lit(0)).alias("more_children"))
    light = light.withColumns({"more_leaves": F.col("more_children"), "more_saved": F.lit(0)})
    rolled = written(light.groupBy("shard").applyInPandas(lambda t: roll_up(t), ROLLED), "trie-light")
    top_rows = rolled.where("parent_conv_id is null")

    # heavy upper levels, with what hangs below them
    hung = top_rows.select("parent", F.lit(1).alias("c"), F.col("n_leaves").alias("l"), F.col("saved_tokens").alias("s"))
    hung = hung.unionByName(heads.select("parent", F.col("more_children").alias("c"), F.col("more_children").alias("l"), F.lit(0).alias("s")))
    hung = hung.join(above.select("parent"), "parent", "left_semi").groupBy(F.col("parent").alias("node"))
    hung = hung.agg(F.sum("c").alias("more_children"), F.sum("l").alias("more_leaves"), F.sum("s").alias("more_saved"))
    bounded = upper.join(hung, "node", "left").fillna(0, ["more_children", "more_leaves", "more_saved"])  # HEAVY rows and the root
    high = bounded.withColumn("shard", F.lit(0)).groupBy("shard").applyInPandas(lambda t: roll_up(t), ROLLED)

    # what parents are called: heavy ones by a small table, others in their shard's rows
    named = rolled.where("parent_conv_id is not null").unionByName(top_rows.drop("parent_conv_id").join(above, "parent").select(*rolled.columns))
    stored = named.unionByName(high)
    ends = every.where("last").select("node", "conv_id")
    digests = ends_digests(written(ends.join(tails.select("node"), "node", "left_anti"), "trie-ends"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    got = stored.join(digests, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    own = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    light_names = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("shared_id"))
    high_tails = tails.join(above, "parent")
    low_tails = tails.join(above.select("parent"), "parent", "left_anti").join(light_names, "parent", "left").withColumn("parent_conv_id", F.coalesce("shared_id", "conv_id"))
    ended = [
        "conv_id", "depth", "parent_conv_id", "n_convs", (~F.col("last")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), F.when(F.col("last"), own).otherwise(none).alias("ends_sha256"),
    ]
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return got.select(*columns).unionByName(high_tails.select(*ended)).unionByName(low_tails.select(*ended))
