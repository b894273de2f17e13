"""Core distances and the edges of a spanning tree of mutual reachability, by cells of space: exact, without looking at all pairs.

Rows fall into blocks that are cells of space: planes through a bounded sample, which decide only how even
the cells are, then medians inside a cell. Rows visit another block only if its box may hold what they look for:

* **Cores.** A row's k-th nearest in its own block is a bound; it visits blocks whose box is nearer than that.
* **Edges.** Each block has the spanning tree of its rows, and a hub, its row of the least core. ``up`` is the heaviest edge
  on a row's way to the hub. The blocks' lightest links, or their hubs' own distances, give the heaviest step H on the best way between two hubs.
  An edge heavier than the larger of H and both rows' ups closes a ring of lighter ones, and is in no spanning tree of least weight;
  each other edge is found from the row whose up, or whose H, admits it.

In few dimensions a row visits its neighbours' blocks alone, so that the work grows with rows times a block's rows. In many
dimensions without clusters the boxes rule out little, and each row visits all blocks. There are MOST blocks, about, and the driver
holds for each its box, its hub and a few links. Rows are spread by a hash where many equal ones make a cell large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dropped, written

#: Blocks, about, at most; rows of the sample; blocks of a cell of the sample; most blocks' rows that one task cuts.
MOST, SAMPLE, CELL, WIDE = 1 << 14, 1 << 16, 16, 64
#: Pairs whose distances are held at once; edges held before they are thinned.
AT_ONCE, HELD = 1 << 20, 1 << 21
NEAR = 1 - 1e-12  # boxes' distances are rounded


def _halved(x: np.ndarray, leaves: int) -> list:
    """Planes (axis, value, lower, upper) that cut rows into about even leaves; a leaf is None."""
    if leaves < 2 or len(x) < 2:
        return None
    axis = int(np.argmax(np.ptp(x, axis=0)))
    value = float(np.median(x[:, axis]))
    low = x[:, axis] <= value
    if low.all():
        return None  # half of the rows or more are one value
    return [axis, value, _halved(x[low], leaves - leaves // 2), _halved(x[~low], leaves // 2)]


def _leaf(x: np.ndarray, planes: list | None, rows: np.ndarray, out: np.ndarray, at: int) -> int:
    """Numbers the leaves from ``at`` on; the first number that is free."""
    if planes is None:
        out[rows] = at
        return at + 1
    axis, value, lower, upper = planes
    low = x[rows, axis] <= value
    return _leaf(x, upper, rows[~low], out, _leaf(x, lower, rows[low], out, at))


def _cut(x: np.ndarray, rows: np.ndarray, most: int, out: np.ndarray, at: int) -> int:
    """Cuts rows at medians of their widest axis until no block has more than ``most``."""
    if len(rows) <= most:
        out[rows] = at
        return at + 1
    axis = int(np.argmax(np.ptp(x[rows], axis=0)))
    order = rows[np.argsort(x[rows, axis], kind="stable")]
    return _cut(x, order[len(rows) // 2 :], most, out, _cut(x, order[: len(rows) // 2], most, out, at))


def _stack(v: pd.Series) -> np.ndarray:
    return np.stack(v).astype(float)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs; an axis at a time, so that nothing cancels."""
    d = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        d += (x[:, k, None] - y[None, :, k]) ** 2
    return d


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances row by row, as any pair has them wherever it is met."""
    return np.sqrt(((x - y) ** 2).sum(axis=1))


def _parts(n: int, wide: int) -> Iterator[slice]:
    step = max(1, AT_ONCE // max(1, wide))
    return (slice(k, k + step) for k in range(0, n, step))


def _least(x: np.ndarray, y: np.ndarray, k: int, same: bool = False) -> np.ndarray:
    """Each row's k least distances to rows of y, in order; inf where there are fewer. ``same``: x is y, and no row counts itself."""
    out = np.full((len(x), k), np.inf)
    m = min(k, len(y) - same)
    if m > 0:
        for s in _parts(len(x), len(y)):
            d = _squares(x[s], y)
            if same:
                d[np.arange(len(d)), np.arange(len(d)) + s.start] = np.inf
            near = np.argpartition(d, m - 1, axis=1)[:, :m]
            rows = np.repeat(np.arange(len(d)), m)
            out[s, :m] = np.sort(_exact(x[s][rows], y[near.ravel()]).reshape(-1, m), axis=1)
    return out


def _to_boxes(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distances of rows to boxes, a little less than they are."""
    d = np.zeros((len(x), len(low)))
    for k in range(x.shape[1]):
        d += np.maximum(np.maximum(low[None, :, k] - x[:, k, None], x[:, k, None] - high[None, :, k]), 0) ** 2
    return np.sqrt(d) * NEAR


def _blocks(points: DataFrame, k: int, block: int) -> DataFrame:
    """(id, v, block, near): each row's block, and its k least distances there."""
    n = points.count()
    most = max(block, -(-n // MOST))
    cells = min(-(-n // (CELL * most)), SAMPLE // 16)
    planes = None
    if cells > 1:
        share = min(1.0, SAMPLE / 2 / n)
        some = points.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").limit(SAMPLE).toPandas()
        planes = _halved(_stack(some["v"]), cells) if len(some) else None

    def celled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                out = np.zeros(len(b), np.int64)
                _leaf(_stack(b["v"]), planes, np.arange(len(b)), out, 0)
                yield b.assign(cell=out)

    def cut(g: pd.DataFrame) -> pd.DataFrame:
        x, out = _stack(g["v"]), np.zeros(len(g), np.int64)
        _cut(x, np.arange(len(g)), most, out, 0)
        near = np.empty(len(g), object)
        for c in range(out.max() + 1):
            rows = np.flatnonzero(out == c)
            near[rows] = list(_least(x[rows], x[rows], k, same=True))
        return pd.DataFrame({"id": g["id"], "v": g["v"], "block": g["cell"].to_numpy() * 2**40 + g["part"].to_numpy() * 2**16 + out, "near": near})

    t = points.select("id", "v")
    t = t.mapInPandas(celled, "id long, v array<double>, cell long") if planes else t.withColumn("cell", F.lit(0).cast("long"))
    parts = F.ceil(F.count("*") / (WIDE * most))
    sizes = t.groupBy("cell").agg(parts.alias("parts"))
    t = t.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))  # a row a cell
    return written(t.select("id", "v", "cell", "part").groupBy("cell", "part").applyInPandas(cut, "id long, v array<double>, block long, near array<double>"), "density-blocks")


class Boxes:
    """Of all blocks: their names in order, and least and largest coordinates."""

    def __init__(self, blocks: DataFrame):
        def box(g: pd.DataFrame) -> pd.DataFrame:
            x = _stack(g["v"])
            return pd.DataFrame({"block": [g["block"].iloc[0]], "low": [x.min(axis=0)], "high": [x.max(axis=0)]})

        t = blocks.select("block", "v").groupBy("block").applyInPandas(box, "block long, low array<double>, high array<double>").toPandas().sort_values("block")
        self.names = t["block"].to_numpy(np.int64)
        self.low, self.high = (_stack(t[c]) if len(t) else np.zeros((0, 1)) for c in ("low", "high"))

    def within(self, x: np.ndarray, own: np.ndarray, reach: np.ndarray, strict: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, boxes) with each box but its own that a row reaches; ``reach`` is a number a row, or one for each row and box."""
        for s in _parts(len(x), len(self.names)):
            d = _to_boxes(x[s], self.low, self.high)
            far = reach[s] if reach.ndim == 2 else reach[s, None]
            ok = (d < far) if strict else (d <= far)
            ok[np.arange(len(d)), own[s]] = False
            row, box = np.nonzero(ok)
            yield row + s.start, box


def cores(points: DataFrame, k: int, block: int) -> tuple[DataFrame, Boxes]:
    """(id, v, block, core), written, and the blocks' boxes. With fewer than k others the farthest counts; alone, 0."""
    blocks = _blocks(points, k, block)
    boxes = Boxes(blocks)

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                own = np.searchsorted(boxes.names, b["block"].to_numpy())
                reach = _stack(b["near"])[:, -1]
                for row, box in boxes.within(_stack(b["v"]), own, reach, True):
                    yield pd.DataFrame({"id": b["id"].to_numpy()[row], "v": b["v"].to_numpy()[row], "block": boxes.names[box]})

    def met(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        near = list(_least(_stack(a["v"]), _stack(b["v"]), k)) if len(a) and len(b) else []
        return pd.DataFrame({"id": a["id"].to_numpy()[: len(near)], "near": pd.Series(near, dtype=object)})

    found = blocks.select("id", "near")
    if len(boxes.names) > 1:
        asked = blocks.mapInPandas(visits, "id long, v array<double>, block long")
        found = found.unionByName(asked.groupBy("block").cogroup(blocks.select("id", "v", "block").groupBy("block")).applyInPandas(met, "id long, near array<double>"))
    near = F.slice(F.sort_array(F.filter(F.flatten(F.collect_list("near")), lambda d: d < float("inf"))), 1, k)
    core = found.groupBy("id").agg(F.coalesce(F.array_max(near), F.lit(0.0)).alias("core"))
    out = written(blocks.select("id", "v", "block").join(core, "id"), "density-cores")
    dropped(blocks)
    return out, boxes


def grown(x: np.ndarray, core: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(hub, other, w, up): the spanning tree of rows in order of their ids, from the row of the least core: each row's edge towards it, and the heaviest on its way.

    Edges are in order of (weight, smaller id, larger id), so that the tree is one.
    """
    n = len(x)
    at = hub = int(np.argmin(core))
    left, best, source = np.ones(n, bool), np.full(n, np.inf), np.full(n, -1)
    w_of, up = np.zeros(n), np.zeros(n)
    for _ in range(n - 1):
        left[at] = False
        w = np.maximum(np.maximum(np.sqrt(((x - x[at]) ** 2).sum(axis=1)), core), core[at])
        better = left & (w < best)
        tie = np.flatnonzero(left & (w == best))
        better[tie] = np.minimum(at, tie) * n + np.maximum(at, tie) < np.minimum(source[tie], tie) * n + np.maximum(source[tie], tie)
        best[better], source[better] = w[better], at
        open_ = np.where(left, best, np.inf)
        near = np.flatnonzero(left & (open_ == open_.min()))
        at = int(near[np.argmin(np.minimum(source[near], near) * n + np.maximum(source[near], near))])
        w_of[at], up[at] = best[at], max(up[source[at]], best[at])
    return hub, source, w_of, up


def forest(a: np.ndarray, b: np.ndarray, w: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Which edges between rows a and b are in the forest of least weight, in order of (w, first, second)."""
    order = np.lexsort((second, first, w))
    a, b = a[order], b[order]
    of, kept, live = np.arange(max(a.max(), b.max()) + 1) if len(a) else np.zeros(0, int), [], np.arange(len(a))
    while len(live):
        ca, cb = of[a[live]], of[b[live]]
        open_ = ca != cb
        live, ca, cb = live[open_], ca[open_], cb[open_]
        if not len(live):
            break
        best = np.full(len(of), len(a))
        np.minimum.at(best, ca, live)
        np.minimum.at(best, cb, live)
        chosen = np.unique(best[best < len(a)])
        kept.append(chosen)
        x, y = of[a[chosen]], of[b[chosen]]
        to = np.arange(len(of))
        while True:  # components joined by the chosen edges get their least number
            low = np.minimum(to[x], to[y])
            if (to[x] == low).all() and (to[y] == low).all():
                break
            for c in (to[x], to[y], x, y):
                np.minimum.at(to, c, low)
            to = to[to]
        of = to[of]
    return order[np.concatenate(kept)] if kept else np.zeros(0, int)


class Ways:
    """The heaviest step on the best way between blocks' hubs: a tree of hubs by links and by their own distances."""

    def __init__(self, v: np.ndarray, core: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray):
        m = len(core)
        order = np.argsort(i, kind="stable")
        i, j, w = i[order], j[order], w[order]
        start = np.searchsorted(i, np.arange(m + 1))
        left, best, source = np.ones(m, bool), np.full(m, np.inf), np.zeros(m, int)
        self.order, self.parent, self.w, at = [0], np.zeros(m, int), np.zeros(m), 0
        for _ in range(m - 1):
            left[at] = False
            d = np.maximum(np.maximum(_exact(v, v[at]), core), core[at])
            own = slice(start[at], start[at + 1])
            np.minimum.at(d, j[own], w[own])
            better = left & (d < best)
            best[better], source[better] = d[better], at
            at = int(np.argmin(np.where(left, best, np.inf)))
            self.parent[at], self.w[at] = source[at], best[at]
            self.order.append(at)

    def from_(self, i: int) -> np.ndarray:
        """H of one block to all: up the tree, then down."""
        out = np.full(len(self.w), -1.0)
        out[i], at = 0.0, i
        while at != self.order[0]:
            up = self.parent[at]
            out[up], at = max(out[at], self.w[at]), up
        for c in self.order[1:]:
            if out[c] < 0:
                out[c] = max(out[self.parent[c]], self.w[c])
        return out


def edges(points: DataFrame, boxes: Boxes) -> DataFrame:
    """(a, b, w), written: every edge of the spanning tree of (id, v, block, core), and few others."""

    def tree(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id").reset_index(drop=True)
        hub, other, w, up = grown(_stack(g["v"]), g["core"].to_numpy(float))
        return g.assign(up=up, hub=np.arange(len(g)) == hub, other=g["id"].to_numpy()[other], w=w)

    kinds = "id long, v array<double>, block long, core double"
    t = written(points.select("id", "v", "block", "core").groupBy("block").applyInPandas(tree, f"{kinds}, up double, hub boolean, other long, w double"), "density-trees")
    own = t.where("not hub").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "w")
    if len(boxes.names) < 2:
        out = written(own, "density-edges")
        dropped(t)
        return out
    hubs = t.where("hub").select("block", "v", "core").toPandas().sort_values("block")  # a row a block
    hub_v, hub_core = _stack(hubs["v"]), hubs["core"].to_numpy(float)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                at = np.searchsorted(boxes.names, b["block"].to_numpy())
                for row, box in boxes.within(_stack(b["v"]), at, b["core"].to_numpy(float), False):
                    yield pd.DataFrame({"v": b["v"].to_numpy()[row], "core": b["core"].to_numpy()[row], "up": b["up"].to_numpy()[row], "i": at[row], "block": boxes.names[box]})

    def linked(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"i": [], "j": [], "w": []})
        x, y, i = _stack(a["v"]), _stack(b["v"]), a["i"].to_numpy()
        p, q = np.maximum(a["core"], a["up"]).to_numpy(), np.maximum(b["core"], b["up"]).to_numpy()
        least = np.empty(len(x))
        for s in _parts(len(x), len(y)):
            least[s] = np.maximum(np.sqrt(_squares(x[s], y)) / NEAR, np.maximum(p[s, None], q[None, :])).min(axis=1)
        return pd.DataFrame({"i": i, "j": np.searchsorted(boxes.names, b["block"].iloc[0]), "w": least}).groupby(["i", "j"], as_index=False).min()

    visits = t.mapInPandas(near, "v array<double>, core double, up double, i long, block long")
    links = visits.groupBy("block").cogroup(t.select("block", "v", "core", "up").groupBy("block")).applyInPandas(linked, "i long, j long, w double").toPandas()  # some a block
    i, j, w = links["i"].to_numpy(np.int64), links["j"].to_numpy(np.int64), links["w"].to_numpy(float)
    ways = Ways(hub_v, hub_core, np.r_[i, j], np.r_[j, i], np.r_[w, w])

    def sent(g: pd.DataFrame) -> pd.DataFrame:
        at = int(np.searchsorted(boxes.names, g["block"].iloc[0]))
        x, core, h = _stack(g["v"]), g["core"].to_numpy(float), ways.from_(at)
        out = [pd.DataFrame({"id": g["id"][:0], "v": g["v"][:0], "core": g["core"][:0], "most": g["core"][:0], "block": g["block"][:0]})]
        up = g["up"].to_numpy(float)
        for s in _parts(len(x), len(h)):
            most = np.maximum(up[s, None], h[None, :])
            reach = np.where(np.maximum(core[s, None], hub_core[None, :]) <= most, most, -1.0)  # no core of a block is below its hub's
            for row, box in boxes.within(x[s], np.full(len(reach), at), reach, False):
                r = row + s.start
                out.append(pd.DataFrame({"id": g["id"].to_numpy()[r], "v": g["v"].to_numpy()[r], "core": core[r], "most": most[row, box], "block": boxes.names[box]}))
        return pd.concat(out)

    def met(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "w": np.zeros(0)})
        if not len(a) or not len(b):
            return none
        x, y, p, q, most = _stack(a["v"]), _stack(b["v"]), a["core"].to_numpy(float), b["core"].to_numpy(float), a["most"].to_numpy(float)
        ids = np.r_[b["id"].to_numpy(np.int64), a["id"].to_numpy(np.int64)]
        inside = b[~b["hub"]]
        place = pd.Series(np.arange(len(b)), index=b["id"].to_numpy())
        tree_ = (place[inside["id"]].to_numpy(), place[inside["other"]].to_numpy(), inside["w"].to_numpy(float))
        held = tuple(np.asarray(c, k) for c, k in zip(tree_, (np.int64, np.int64, float), strict=True))
        for s in _parts(len(x), len(y)):
            row, col = np.nonzero(np.sqrt(_squares(x[s], y)) * NEAR <= most[s, None])
            row = row + s.start
            row, col = (c[np.maximum(p[row], q[col]) <= most[row]] for c in (row, col))
            w = np.maximum(np.maximum(_exact(x[row], y[col]), p[row]), q[col])
            ok = w <= most[row]
            held = tuple(np.r_[u, v] for u, v in zip(held, (row[ok] + len(b), col[ok], w[ok]), strict=True))
            if len(held[0]) > HELD:
                keep = _thin(*held, ids)
                held = tuple(c[keep] for c in held)
        keep = _thin(*held, ids)
        u, v, w = (c[keep] for c in held)
        out = (u >= len(b)) | (v >= len(b))
        u, v, w = ids[u[out]], ids[v[out]], w[out]
        return pd.DataFrame({"a": np.minimum(u, v), "b": np.maximum(u, v), "w": w})

    asked = t.groupBy("block").applyInPandas(sent, "id long, v array<double>, core double, most double, block long")
    between = asked.groupBy("block").cogroup(t.select("id", "v", "block", "core", "hub", "other", "w").groupBy("block")).applyInPandas(met, "a long, b long, w double")
    out = written(own.unionByName(between.distinct()), "density-edges")
    dropped(t)
    return out


def _thin(u: np.ndarray, v: np.ndarray, w: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return forest(u, v, w, np.minimum(ids[u], ids[v]), np.maximum(ids[u], ids[v]))
