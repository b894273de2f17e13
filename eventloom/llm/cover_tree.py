"""Embedding near-dedup: all pairs of a cosine or more, by cover trees that are walked in pairs.

For unit vectors a cosine is a distance, and distances obey the triangle inequality. A
cover tree has levels of halving radii: a node's children are centres of the next level
(its own centre again among them), and a node keeps its covering radius, the largest
distance from its centre to a vector below it. Two nodes whose centres are farther apart
than both radii and the threshold hold no pair; where even the farthest vectors are
within the threshold, all their pairs are links, which are counted without being made.
What neither bound decides goes down a level, and pairs of vectors are compared at last.
So the pairs are exact.

Equal vectors are one vector with a count. The upper levels are fitted on a bounded
sample (SAMPLE vectors, SAMPLE_BYTES): balls that hold many of its vectors become nodes
of their own, as far down as they need; every vector is put into one leaf of these, and
the leaves' radii are those of all their vectors. A level has at most LEAVES / 2 of them. A leaf whose
vectors are all within the threshold of each other, and two leaves alike, are linked as a
whole. Between other leaves that may hold pairs, those vectors meet which the other
leaf's ball allows, dealt into parts of BLOCK vectors: each pair of parts is a task, which
makes both parts' trees and walks them. So no leaf, however hot, needs a task of its own.
Where vectors have no clusters the bounds decide only near the leaves, and the work grows
with the square of the different vectors.

Values: vectors that are null, empty, zero or hold null or non-finite components have no
links, nor have rows with a null vec_id (component_id is null then). Vectors of different
lengths don't link. Rows that repeat a vec_id are vectors each, but one node of the
links' components. Equal vectors link. Empty tables give an empty result. Of other
columns, whatever their names, nothing is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import parted, usable
from .components import components
from .scratch import temporary, written

SAMPLE, SAMPLE_BYTES, LEAVES = 8192, 32 << 20, 256
#: Vectors of a part at most, about, and their bytes in double precision.
BLOCK, BLOCK_BYTES = 4096, 32 << 20
#: Vectors of a node that isn't split further; candidates for centres that are looked at together.
SMALL, CHUNK = 8, 256
#: Allowance for the rounding of distances.
SLACK = 1e-6
KEY = "h1 long, h2 long"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of unit vectors."""
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def below(radius: float) -> float:
    """The largest power of two that is smaller."""
    return 2.0 ** (np.ceil(np.log2(radius)) - 1)


def net(x: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres, owner of each row, distance to it): every row is within r of its centre, centres are more than r apart; row 0 is a centre."""
    owner, off = np.full(len(x), -1), np.zeros(len(x))
    centres: list[int] = []
    left = np.arange(len(x))
    while len(left):
        some = left[:CHUNK]
        near = distances(x[some], x[some]) <= r
        covered, chosen = np.zeros(len(some), bool), []
        for i in range(len(some)):
            if not covered[i]:
                chosen.append(i)
                covered |= near[i]
        d = distances(x[some[chosen]], x[left])
        best = d.argmin(axis=0)
        least = d[best, np.arange(len(left))]
        self_at = np.searchsorted(left, some[chosen])
        best[self_at], least[self_at] = np.arange(len(chosen)), 0.0
        got = least <= r
        owner[left[got]], off[left[got]] = best[got] + len(centres), least[got]
        centres.extend(some[chosen].tolist())
        left = left[~got]
    return np.array(centres), owner, off


class CoverTree:
    """Nodes in level order. ``order`` lists the vectors so that each node's are a range of it, and a node's children are a range of nodes."""

    def __init__(self, x: np.ndarray, finest: float):
        order = np.arange(len(x))
        start, end, centre, radius = [0], [len(x)], [0], [float(distances(x[:1], x).max())]
        child, children = [], []
        at = 0
        while at < len(start):
            a, b, r = start[at], end[at], radius[at]
            child.append(len(start))
            if b - a <= SMALL or r <= finest:
                children.append(0)
                at += 1
                continue
            own = order[a:b]
            first = np.flatnonzero(own == centre[at])[0]
            own = np.r_[own[first], np.delete(own, first)]
            centres, owner, off = net(x[own], below(r))
            sort = np.argsort(owner, kind="stable")
            order[a:b] = own[sort]
            sizes = np.bincount(owner, minlength=len(centres))
            ends = a + np.cumsum(sizes)
            reach = np.zeros(len(centres))
            np.maximum.at(reach, owner, off)
            start += (ends - sizes).tolist()
            end += ends.tolist()
            centre += own[centres].tolist()
            radius += reach.tolist()
            children.append(len(centres))
            at += 1
        self.x, self.order = x, order
        self.start, self.end, self.centre = np.array(start), np.array(end), np.array(centre)
        self.radius, self.child, self.children = np.array(radius), np.array(child), np.array(children)
        self.mid = x[self.centre]


def _ragged(a: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value): a[i], a[i] + 1, ... of n[i] values for each i."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) + np.repeat(a - np.cumsum(n) + n, n)


def merged(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each place of n is joined to by pairs (a, b)."""
    label = np.arange(n)
    while True:
        u, v = label[a], label[b]
        if (u == v).all():
            return label
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (label != label[label]).any():
            label = label[label]


class Walk:
    """Links between two trees, or within one: counts for each vector, and what they join."""

    def __init__(self, a: CoverTree, wa: np.ndarray, b: CoverTree | None, wb: np.ndarray | None, cosine: float):
        self.same = b is None
        self.a, self.b = a, a if b is None else b
        self.cosine, self.reach = cosine, float(np.sqrt(2 - 2 * cosine))
        self.wa, self.wb = wa, wa if b is None else wb
        n, m = len(a.order), len(self.b.order)
        self.mass_a = np.r_[0, np.cumsum(self.wa[self.a.order])]
        self.mass_b = np.r_[0, np.cumsum(self.wb[self.b.order])]
        self.gain_a, self.gain_b = np.zeros(n + 1, np.int64), np.zeros(m + 1, np.int64)  # by place in order, as differences
        self.run_a, self.run_b = np.zeros(n + 1, np.int64), np.zeros(m + 1, np.int64)  # places joined with the next
        self.ties: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0
        self._walk()

    def _bound(self, d: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = self.a.radius[i] + self.b.radius[j]
        return d - r <= self.reach + SLACK, d + r <= self.reach - SLACK

    def _whole(self, i: np.ndarray, j: np.ndarray) -> None:
        """All pairs between the vectors of nodes i and j are links."""
        a, b = self.a, self.b
        left, right = self.mass_a[a.end[i]] - self.mass_a[a.start[i]], self.mass_b[b.end[j]] - self.mass_b[b.start[j]]
        for gain, t, k, w in ((self.gain_a, a, i, right), (self.gain_b, b, j, left)):
            np.add.at(gain, t.start[k], w)
            np.add.at(gain, t.end[k], -w)
        for run, t, k in ((self.run_a, a, i), (self.run_b, b, j)):
            np.add.at(run, t.start[k], 1)
            np.add.at(run, t.end[k] - 1, -1)
        self._tie(a.start[i], b.start[j])

    def _own(self, i: np.ndarray) -> None:
        """All pairs within node i are links."""
        a = self.a
        w = self.mass_a[a.end[i]] - self.mass_a[a.start[i]]
        np.add.at(self.gain_a, a.start[i], w)
        np.add.at(self.gain_a, a.end[i], -w)
        np.add.at(self.run_a, a.start[i], 1)
        np.add.at(self.run_a, a.end[i] - 1, -1)
        row, p = _ragged(a.start[i], a.end[i] - a.start[i])  # not with itself
        own = self.wa[a.order[p]]
        np.add.at(self.gain_a, p, -own)
        np.add.at(self.gain_a, p + 1, own)

    def _tie(self, p: np.ndarray, q: np.ndarray) -> None:
        self.ties.append((p, q + (0 if self.same else len(self.a.order))))
        self.held += len(p)
        if self.held > 2_000_000:
            label = self._labels()
            rest = np.flatnonzero(label != np.arange(len(label)))
            self.ties, self.held = [(rest, label[rest])], len(rest)

    def _labels(self) -> np.ndarray:
        n = len(self.a.order) + (0 if self.same else len(self.b.order))
        p, q = (np.concatenate(x) for x in zip(*self.ties, strict=True)) if self.ties else (np.zeros(0, int), np.zeros(0, int))
        return merged(n, p, q)

    def _members(self, i: np.ndarray, j: np.ndarray, own: bool) -> None:
        """Pairs of leaves, vector by vector."""
        a, b = self.a, self.b
        row, p = _ragged(a.start[i], a.end[i] - a.start[i])
        at, q = _ragged(b.start[j][row], (b.end[j] - b.start[j])[row])
        p = p[at]
        if own:
            p, q = p[p < q], q[p < q]
        for k in range(0, len(p), 32_768):
            u, v = p[k : k + 32_768], q[k : k + 32_768]
            cos = np.einsum("ij,ij->i", a.x[a.order[u]], b.x[b.order[v]])
            u, v = u[cos >= self.cosine], v[cos >= self.cosine]
            for gain, at, w in ((self.gain_a, u, self.wb[b.order[v]]), (self.gain_b if not self.same else self.gain_a, v, self.wa[a.order[u]])):
                np.add.at(gain, at, w)
                np.add.at(gain, at + 1, -w)
            self._tie(u, v)

    def _walk(self) -> None:
        a, b = self.a, self.b
        stack: list[tuple[np.ndarray, np.ndarray]] = []
        if self.same:
            own = np.zeros(1, int)
            while len(own):  # nodes with themselves
                tight = 2 * a.radius[own] <= self.reach - SLACK
                self._own(own[tight])
                own = own[~tight]
                leaf = a.children[own] == 0
                self._members(own[leaf], own[leaf], True)
                own = own[~leaf]
                for i in own:
                    self._dense(i, i, stack)
                own = _ragged(a.child[own], a.children[own])[1]
        else:
            stack.append((np.zeros(1, int), np.zeros(1, int)))
        while stack:
            i, j = stack.pop()
            if len(i) > 32_768:
                stack.append((i[32_768:], j[32_768:]))
                i, j = i[:32_768], j[:32_768]
            d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", a.mid[i], b.mid[j])))
            near, all_in = self._bound(d, i, j)
            self._whole(i[all_in], j[all_in])
            open_ = near & ~all_in
            i, j = i[open_], j[open_]
            ends = (a.children[i] == 0) & (b.children[j] == 0)
            self._members(i[ends], j[ends], False)
            i, j = i[~ends], j[~ends]
            many = a.children[i] * b.children[j] >= 4096
            for u, v in zip(i[many], j[many], strict=True):
                self._dense(u, v, stack)
            i, j = i[~many], j[~many]
            left = (a.children[i] > 0) & ((a.radius[i] >= b.radius[j]) | (b.children[j] == 0))
            row, u = _ragged(a.child[i[left]], a.children[i[left]])
            if len(u):
                stack.append((u, j[left][row]))
            row, v = _ragged(b.child[j[~left]], b.children[j[~left]])
            if len(v):
                stack.append((i[~left][row], v))

    def _dense(self, i: int, j: int, stack: list) -> None:
        """All pairs of two nodes' children at once; of one node's, each pair once."""
        a, b = self.a, self.b
        own = self.same and i == j
        right = np.arange(b.child[j], b.child[j] + b.children[j])
        step = max(1, 2_000_000 // len(right))
        for k in range(0, a.children[i], step):
            left = np.arange(a.child[i] + k, a.child[i] + min(k + step, a.children[i]))
            near, all_in = self._bound(distances(a.mid[left], b.mid[right]), left[:, None], right[None, :])
            if own:
                later = left[:, None] < right[None, :]
                near, all_in = near & later, all_in & later
            u, v = np.nonzero(all_in)
            if len(u):
                self._whole(left[u], right[v])
            u, v = np.nonzero(near & ~all_in)
            if len(u):
                stack.append((left[u], right[v]))

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """(links, mate) of each vector of a, then of b: mate is the place of one it is joined to, the same for all that are joined."""
        if self.same:
            self.gain_a, self.run_a = self.gain_a + self.gain_b, self.run_a + self.run_b
        sides = [(self.gain_a, self.run_a, 0, self.a)] + ([] if self.same else [(self.gain_b, self.run_b, len(self.a.order), self.b)])
        for _, run, base, _ in sides:
            p = np.flatnonzero(np.cumsum(run)[:-1] > 0) + base
            self._tie(p, p + 1 - (0 if self.same else len(self.a.order)))
        label = self._labels()
        back = np.concatenate([t.order + base for _, _, base, t in sides])
        links, mate = np.zeros(len(label), np.int64), np.zeros(len(label), int)
        links[back] = np.concatenate([np.cumsum(gain)[:-1] for gain, _, _, _ in sides])
        mate[back] = back[label]
        return links, mate


class Upper:
    """Leaves of the upper levels: a centre each, and whose children they are tried after."""

    def __init__(self, x: np.ndarray, rows: int, block: int, finest: float):
        self.centres: list[np.ndarray] = []
        #: Of each leaf: children to try first, as (leaf, radius).
        self.inside: list[list[tuple[int, float]]] = []
        need = max(SMALL, -(-len(x) // LEAVES) * 2)
        self._node(x, x[0], 2.0, rows / max(1, len(x)), block, need, finest)
        self.middle = np.array(self.centres)

    def _node(self, x: np.ndarray, centre: np.ndarray, radius: float, scale: float, block: int, need: int, finest: float) -> int:
        own = len(self.centres)
        self.centres.append(centre)
        self.inside.append([])
        r = radius / 2
        while r > finest and len(x) * scale > block and len(x) >= need:
            for middle, ball in self._dense(x, r, need):
                if len(ball) == len(x):
                    break  # one ball holds all: the next level tells more
                self.inside[own].append((self._node(x[ball], middle, r, scale, block, need, finest), r))
            if self.inside[own]:
                break
            r /= 2
        return own

    @staticmethod
    def _dense(x: np.ndarray, r: float, need: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Balls of radius r with so many rows, fullest first; a row is in one at most."""
        count = np.concatenate([(distances(x[k : k + 1024], x) <= r).sum(axis=1) for k in range(0, len(x), 1024)])
        free = np.ones(len(x), bool)
        for i in np.argsort(-count, kind="stable"):
            if count[i] < need:
                return
            if free[i]:
                ball = np.flatnonzero(free & (distances(x[i : i + 1], x)[0] <= r))
                if len(ball) >= need:
                    free[ball] = False
                    yield x[i], ball

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """Of each row: from the root down to the nearest child while one covers it."""
        d = distances(x, self.middle)
        at = np.zeros(len(x), int)
        for node, children in enumerate(self.inside):  # children come after their parent
            if children and len(own := np.flatnonzero(at == node)):
                to, r = np.array([c for c, _ in children]), np.array([r for _, r in children])
                far = d[np.ix_(own, to)]
                far = np.where(far <= r, far, np.inf)
                best = far.argmin(axis=1)
                got = np.isfinite(far[np.arange(len(own)), best])
                at[own[got]] = to[best[got]]
        return at


def near_links(df: DataFrame, cosine: float = 0.95, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row. The result is a written table; those on the way are deleted."""
    with temporary():
        return written(_near_links(df, cosine, vec_id, vec), "cover-found", keep=True)


def _near_links(df: DataFrame, cosine: float, vec_id: str, vec: str) -> DataFrame:
    part = F.col("id").isNotNull() & usable(F.col("v"))
    key = {"h1": F.when(part, F.xxhash64("v")), "h2": F.when(part, F.xxhash64(F.lit(7), "v"))}
    plain = df.schema[vec].dataType.simpleString() in ("array<float>", "array<double>")
    rows = df.select(F.col(vec_id).cast("long").alias("id"), (F.col(vec) if plain else F.col(vec).cast("array<double>")).alias("v")).withColumns(key)
    taking = rows.where("h1 is not null")
    vectors = taking.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.any_value("v").alias("v"))
    vectors = written(vectors.withColumn("dim", F.size("v")), "cover-vectors")
    found, edges = [], []
    for r in vectors.groupBy("dim").agg(F.count("*").alias("rows")).orderBy("dim").collect():  # a row a length
        links = written(_joined(vectors.where(F.col("dim") == r.dim), r.dim, r.rows, cosine), "cover-links")
        found.append(links.select("h1", "h2", "links"))
        edges.append(links.select(F.col("id").alias("a"), F.col("mate").alias("b")))
    names = vectors.select("h1", "h2", F.col("id").alias("least"), "n")
    # an id with more than one vector joins them
    twice = taking.groupBy("id").agg(F.min("h1").alias("p"), F.max("h1").alias("q")).where("p <> q").select("id")
    edges.append(taking.join(twice, "id").join(names, ["h1", "h2"]).select(F.col("id").alias("a"), F.col("least").alias("b")))
    every, ties = found[0] if found else None, edges[0]
    for x in found[1:]:
        every = every.unionByName(x)
    for x in edges[1:]:
        ties = ties.unionByName(x)
    roots = components(ties)
    if every is not None:
        names = names.join(every.groupBy("h1", "h2").agg(F.sum("links").alias("links")), ["h1", "h2"], "left")
    else:
        names = names.withColumn("links", F.lit(0))
    names = names.join(roots, F.col("least") == F.col("node"), "left").select("h1", "h2", F.coalesce("root", "least").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = rows.select("id", "h1", "h2").join(names, ["h1", "h2"], "left")
    component = F.coalesce("root", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _unit(x: pd.Series | pa.Array) -> np.ndarray:
    cells = x.to_numpy(zero_copy_only=False) if isinstance(x, pa.Array) else x
    return parted(np.stack(cells))[0]


def _joined(vectors: DataFrame, dim: int, rows: int, cosine: float) -> DataFrame:
    """(h1, h2, id, links, mate) of different vectors of one length: how many rows each links with (its own copies aside), and an id that links lead to."""
    spark = vectors.sparkSession
    block = int(max(SMALL, min(BLOCK, BLOCK_BYTES // (8 * dim))))
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    share = most / rows
    sample = vectors.select("v").where(F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 30)) < int(share * (1 << 30))).toArrow() if share < 1 else vectors.select("v").toArrow()  # about SAMPLE rows
    x = _unit(sample.column(0).combine_chunks()) if len(sample) else np.eye(1, dim)
    reach = float(np.sqrt(2 - 2 * cosine))
    upper = spark.sparkContext.broadcast(Upper(x, rows, block, reach / 4))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = upper.value
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                p = b.slice(at, 2048)
                x = _unit(p.column(4))
                leaf = own.leaf(x)
                off = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x, own.middle[leaf])))
                yield pa.RecordBatch.from_arrays([*(p.column(k) for k in range(5)), pa.array(leaf.astype(np.int32)), pa.array(off)], ["h1", "h2", "id", "n", "v", "leaf", "off"])

    kind = vectors.schema["v"].dataType.simpleString()
    base = f"{KEY}, id long, n long, v {kind}, leaf int"
    located = vectors.select("h1", "h2", "id", "n", "v").mapInArrow(placed, f"{base}, off double")
    located = written(located, "cover-leaves")
    stats = located.groupBy("leaf").agg(F.max("off").alias("r"), F.sum("n").alias("n"), F.min("id").alias("id")).orderBy("leaf").toPandas()  # a row a leaf
    leaves, radius = stats["leaf"].to_numpy(), stats["r"].to_numpy() + SLACK
    d = distances(upper.value.middle[leaves], upper.value.middle[leaves])
    np.fill_diagonal(d, 0)
    far = d + radius[:, None] + radius[None, :]
    whole, near = far <= reach - SLACK, d - radius[:, None] - radius[None, :] <= reach + SLACK
    # leaves that are linked as a whole, with themselves or others
    total = stats["n"].to_numpy()
    gains = (whole * total[None, :]).sum(axis=1)
    group = merged(len(leaves), *np.nonzero(whole))
    mates = stats["id"].to_numpy()
    least = np.array([mates[group == g].min() for g in group]) if len(group) else mates
    known = [(int(k), int(g), bool(w), int(m)) for k, g, w, m in zip(leaves, gains, whole.diagonal(), least, strict=True) if g]
    out = spark.createDataFrame([], f"{KEY}, id long, links long, mate long")
    if known:
        names = F.broadcast(spark.createDataFrame(known, "leaf int, gain long, own boolean, mate long"))
        gain = F.col("gain") - F.when(F.col("own"), F.col("n")).otherwise(0)
        out = located.join(names, "leaf").select("h1", "h2", "id", gain.alias("links"), "mate")
    meetings = [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(near & ~whole)), strict=True)]
    if not meetings:
        return out
    sides = spark.sparkContext.broadcast((leaves, radius, meetings))

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, radius, meetings = sides.value
        middle = upper.value.middle[leaves]
        slot = {int(leaf): k for k, leaf in enumerate(leaves)}
        at_leaf: dict[int, list[tuple[int, int, int]]] = {}
        for m, (i, j) in enumerate(meetings):
            at_leaf.setdefault(i, []).append((m, j, 0))
            if i != j:
                at_leaf.setdefault(j, []).append((m, i, 1))
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                p = b.slice(at, 2048)
                d = distances(_unit(p.column(4)), middle)
                ok = d <= radius + reach + SLACK
                own = [slot[k] for k in p.column(5).to_pylist()]
                to = [[2 * m + side for m, j, side in at_leaf.get(i, ()) if i == j or row[j]] for i, row in zip(own, ok, strict=True)]
                yield pa.RecordBatch.from_arrays([*(p.column(k) for k in range(5)), pa.array(to, pa.list_(pa.int32()))], ["h1", "h2", "id", "n", "v", "to"])

    sent = written(located.select("h1", "h2", "id", "n", "v", "leaf").mapInArrow(touched, f"{KEY}, id long, n long, v {kind}, to array<int>").where(F.size("to") > 0), "cover-meetings")
    held = dict(sent.select(F.explode("to").alias("k")).groupBy("k").count().collect())  # two rows a meeting
    parts = lambda k: max(1, -(-held.get(k, 0) // block))
    table = []
    for m, (i, j) in enumerate(meetings):
        left, right = parts(2 * m), parts(2 * m) if i == j else parts(2 * m + 1)
        if i == j or held.get(2 * m) and held.get(2 * m + 1):
            table += [(2 * m, m, 0, i == j, left, right)] + ([] if i == j else [(2 * m + 1, m, 1, False, right, left)])
    if not table:
        return out
    table = F.broadcast(spark.createDataFrame(table, "k int, m int, side int, self boolean, own int, other int"))
    dealt = sent.withColumn("k", F.explode("to")).drop("to").join(table, "k")
    p = F.pmod(F.xxhash64("h1", F.lit(3)), F.col("own")).cast("int")
    dealt = dealt.withColumn("p", p).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("other") - 1)))
    swap = F.when(F.col("self"), F.col("p") > F.col("q")).otherwise(F.col("side") == 1)
    dealt = dealt.select("m", F.when(swap, F.col("q")).otherwise(F.col("p")).alias("a"), F.when(swap, F.col("p")).otherwise(F.col("q")).alias("b"), swap.alias("right"), "self", "h1", "h2", "id", "n", "v")

    def meet(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["right", "h1", "h2"], kind="stable")
        x, w, right = _unit(t["v"]), t["n"].to_numpy(np.int64), t["right"].to_numpy(bool)
        finest = reach / 64
        inner = bool(t["self"].iloc[0]) and t["a"].iloc[0] == t["b"].iloc[0]
        empty = t.iloc[:0][["h1", "h2", "id"]].assign(links=0, mate=0)
        if inner:
            walk = Walk(CoverTree(x, finest), w, None, None, cosine)
        elif right.all() or not right.any():
            return empty
        else:
            walk = Walk(CoverTree(x[~right], finest), w[~right], CoverTree(x[right], finest), w[right], cosine)
        links, mate = walk.found()
        t = t[["h1", "h2", "id"]].assign(links=links, mate=t["id"].to_numpy()[mate])
        return t[t["links"] > 0]

    return out.unionByName(dealt.groupBy("m", "a", "b").applyInPandas(meet, f"{KEY}, id long, links long, mate long"))
