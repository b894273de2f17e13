"""Approximate nearest neighbours by inner product: an adaptive dimension scan of inverted lists.

Vectors are kept as directions (unit vectors, rotated at random) and norms. An
inner product with a query is the query's norm times the row's norm times the
directions' cosine, and a cosine is a distance of unit vectors: so whatever the
norms in a table, all distances lie between 0 and 2. Rows go by norm into bands
(norms within a factor of 2**BAND), and in a band that is large enough into the
list of the nearest centre; small bands are one list each.

A query first scans the PROBE lists of the best outlook. From then on it knows
its 20th best, and scans every other list that may hold a better one (an exact
bound from the list's centre, radius and norms) and that is among the nearest
``probed`` of its band. How many that are is measured: on the sample, the least
number of lists that hold TARGET of the true neighbours. Within a list, partial
distances over column blocks are scaled up to estimates of whole ones, and a
candidate is dropped as soon as a hypothesis test at EPSILON says that it is
beyond the query's 20th best so far. What is left is scored in double precision
on the original vectors.

Fitting uses a bounded sample (SAMPLE rows and SAMPLE_BYTES, those with the
smallest hash of their id); every row is indexed. Small lists share a cell, which a query is sent
to once; a list above BLOCK rows is a cell of its own and is cut into blocks, and
the queries of a cell into blocks too, so that a hot list is many tasks.

Values: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components, take no part. A score beyond
the doubles' range is infinite, as the plain sum is; one that is no number comes
last. Equal scores go by smaller id; rows that repeat an id are candidates each,
but not for a query with that id. An empty table gives an empty one. Of other
columns nothing is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import temporary, written

SAMPLE, SAMPLE_BYTES, ROUNDS = 20_000, 64 << 20, 12
#: Centres grow with the square root of the rows, up to LISTS; a query probes PROBE lists before bounds rule lists out.
LISTS, PROBE = 4096, 24
#: Share of the sample's true neighbours that the lists of a band which a query may open must hold; sample queries that measure it.
TARGET, TRIALS = 0.985, 400
#: Powers of two in a band of norms; the sample's median is in the middle of one.
BAND = 5
#: Rows of a cell at most; cells that a small table is cut into, about.
BLOCK, QUERY_BLOCK, CELLS = 20_000, 20_000, 48
COLUMNS, EPSILON = 16, 2.1
#: Allowance for rounding, for unit vectors.
SLACK = 1e-11
HUGE = np.finfo(np.float64).max


def usable(vec: Column) -> Column:
    """True for vectors that take part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, fine) & F.exists(vec, lambda x: x != 0)


def parted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(direction, f, e): unit vectors, and norms as f * 2**e with f from 1/2 to 1, which no finite component can overflow."""
    x = x.astype(np.float64)
    e = np.frexp(np.abs(x).max(axis=1))[1].astype(np.int64)
    y = np.ldexp(x, -e[:, None])
    n = np.sqrt((y * y).sum(axis=1))
    f, more = np.frexp(n)
    return y / n[:, None], f, e + more


class Index:
    """Rotation, centres, and how many lists of a band to open at most."""

    def __init__(self, sample: np.ndarray, centres: int, k: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.turn = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0]
        x, f, e = parted(sample)
        x, self.mid = x @ self.turn, int(np.median(e))
        c = x[rng.choice(len(x), centres, replace=False)]
        for _ in range(ROUNDS):
            own = self.order(x, c, 1)[:, 0]
            for j in range(centres):
                if len(at := np.flatnonzero(own == j)):
                    c[j] = x[at].mean(axis=0)
        self.centres = c
        self.probed = self._measured(x, np.ldexp(f, e - e.max()), self.order(x, c, 1)[:, 0], k, rng)

    def directions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y, f, e = parted(x)
        return y @ self.turn, f, e

    @staticmethod
    def order(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
        """The n nearest centres of each row."""
        d = (centres * centres).sum(axis=1) - 2 * x @ centres.T
        return np.argsort(d, axis=1, kind="stable")[:, :n] if n > 1 else d.argmin(axis=1)[:, None]

    def _measured(self, x: np.ndarray, norm: np.ndarray, own: np.ndarray, k: int, rng: np.random.Generator) -> int:
        """The least number of nearest centres whose lists hold TARGET of the sample's true neighbours.

        Neighbours in a sample are farther away than those in the whole table, and
        so are spread over more lists: the number errs to the safe side.
        """
        asked = rng.choice(len(x), min(TRIALS, len(x)), replace=False)
        score = (x[asked] @ x.T) * norm
        score[np.arange(len(asked)), asked] = -np.inf
        n = min(k, len(x) - 1)
        if n < 1:
            return len(self.centres)
        near = np.argpartition(-score, n - 1, axis=1)[:, :n]
        place = np.argsort(self.order(x[asked], self.centres, len(self.centres)), axis=1) if len(self.centres) > 1 else np.zeros((len(asked), 1), int)
        at = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
        return int(at[min(len(at) - 1, int(np.ceil(TARGET * len(at))) - 1)]) + 1


def scan(x: np.ndarray, w: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, best: np.ndarray, cap: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, reach) of one list: those that may be among each query's best.

    x and q are directions, w the rows' norms. ``best`` has what each query's best so
    far reach at least (norm times cosine), largest first, and is brought up to date;
    above ``cap`` a query's scores are infinite, and so equal.
    """
    k, dim, lead = best.shape[1], x.shape[1], min(COLUMNS, x.shape[1])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(64, min(512, 2_000_000 // max(1, len(q))))
    q_norm, q_lead = (q * q).sum(axis=1), (q[:, :lead] ** 2).sum(axis=1)
    for at in range(0, len(x), step):
        part, own, norm = x[at : at + step], ids[at : at + step], np.maximum(w[at : at + step], 1e-290)
        kth = np.clip(best[:, -1], -4.0, cap)  # no reach is below -1
        # a candidate's squared distance must be at most this
        most = 2 + SLACK - 2 * kth[:, None] * (1 / norm)[None, :]
        wide = lambda d: dim / d / (1 if d == dim else (1 + epsilon / np.sqrt(d)) ** 2)
        fresh = bool(len(best)) and np.isinf(best[:, -1]).all()  # nothing to test against yet: whole distances at once
        d, norms, some = (dim, q_norm, part) if fresh else (lead, q_lead, part[:, :lead])
        dense = norms[:, None] + (some * some).sum(axis=1)[None, :] - 2 * (q[:, :d] @ some.T)  # the first columns of all pairs
        live = (qids[:, None] != own[None, :]) & (dense * wide(d) <= most)
        while d < dim and 8 * np.count_nonzero(live) > live.size:  # many are left: the next columns of all pairs too
            to = min(d + COLUMNS, dim)
            a, b = q[:, d:to], part[:, d:to]
            dense += (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
            d = to
            live &= dense * wide(d) <= most
        row, col = np.nonzero(live)
        far = dense[row, col]
        while d < dim and len(row):
            to = min(d + COLUMNS, dim)
            diff = q[row, d:to] - part[col, d:to]
            far += np.einsum("ij,ij->i", diff, diff)
            d = to
            keep = far * wide(d) <= most[row, col]  # abandoned: the estimate is over the bound by more than chance allows
            row, col, far = row[keep], col[keep], far[keep]
        if len(row):
            reach = norm[col] * (1 - far / 2)
            found.append((row, col + at, reach + SLACK * norm[col]))
            sure = reach - SLACK * norm[col]
            order = np.lexsort((-sure, row))  # the k best of each query
            r, s = row[order], sure[order]
            place = _place(r)
            r, s, place = r[place < k], s[place < k], place[place < k]
            new = np.full_like(best, -np.inf)
            new[r, place] = s
            best[:] = -np.sort(-np.c_[best, new], axis=1)[:, :k]
    return tuple(np.concatenate(a) for a in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _place(row: np.ndarray) -> np.ndarray:
    """Each entry's place among those of its row, which lie together."""
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
    return np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))


def scan_cell(own: np.ndarray, ids: np.ndarray, x: np.ndarray, w: np.ndarray, raw: np.ndarray, opened: np.ndarray, qids: np.ndarray, q: np.ndarray, qraw: np.ndarray, kth: np.ndarray, cap: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best candidates of each query in a cell: own is each row's list (by place in the cell), opened tells which lists a query scans."""
    best = np.repeat(kth[:, None], k, axis=1)
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    for j in np.unique(own):
        at, ask = np.flatnonzero(own == j), np.flatnonzero(opened[:, j])
        if len(ask):
            near = best[ask]
            row, col, reach = scan(x[at], w[at], ids[at], q[ask], qids[ask], near, cap[ask])
            best[ask] = near
            found.append((ask[row], at[col], reach))
    row, col, reach = (np.concatenate(a) for a in zip(*found, strict=True))
    live = reach >= np.minimum(best[row, -1], cap[row])
    row, col = row[live], col[live]
    with np.errstate(over="ignore", invalid="ignore"):
        score = np.fromiter((float(a @ b) for a, b in zip(qraw[row], raw[col], strict=True)), np.float64, len(row))
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    top = _place(row) < k
    return qids[row[top]], ids[col[top]], score[top]


def cells_of(held: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, place in it) of each list: lists share a cell up to so many rows."""
    cell, place, at, rows, n = np.zeros(len(held), int), np.zeros(len(held), int), 0, 0, 0
    for j, h in enumerate(held.tolist()):
        if n and rows + h > most:
            at, rows, n = at + 1, 0, 0
        cell[j], place[j], rows, n = at, n, rows + h, n + 1
    return cell, place


class Lists:
    """The lists of a table: (band, centre), or a small band as a whole (centre -1)."""

    def __init__(self, index: Index, band: np.ndarray, centre: np.ndarray, held: np.ndarray, radius: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.index, self.band, self.centre, self.held, self.radius = index, band, centre, held, radius
        self.low, self.high, self.k = low, high, k  # smallest and largest norm in each list, in units of 2**unit
        self.c = np.where(centre[:, None] >= 0, index.centres[np.maximum(centre, 0)], 0.0)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """What a row of each list can reach at most."""
        gap = np.maximum(0, np.sqrt(np.maximum(0, 1 + (self.c * self.c).sum(axis=1)[None, :] - 2 * q @ self.c.T)) - self.radius - 1e-7)
        cos = np.where(self.centre >= 0, np.minimum(1, 1 - gap * gap / 2), 1.0)
        return np.where(cos > 0, cos * self.high, cos * self.low)

    def first(self, q: np.ndarray) -> np.ndarray:
        """Which lists to scan first: those of the best outlook, PROBE and as many as hold k candidates at least."""
        cos = np.where(self.centre >= 0, q @ self.c.T, 0.3)
        order = np.argsort(-np.where(cos > 0, cos * self.high, cos * self.low), axis=1, kind="stable")
        full = np.cumsum(self.held[order], axis=1)
        n = np.maximum(min(PROBE, len(self.held)), (full < self.k + 1).sum(axis=1) + 1)
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, np.arange(order.shape[1])[None, :] < n[:, None], axis=1)
        return out

    def rest(self, q: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Which other lists to scan, once something is known that the best reach."""
        place = np.argsort(self.index.order(q, self.index.centres, len(self.index.centres)), axis=1) if len(self.index.centres) > 1 else np.zeros((len(q), 1), int)
        near = np.where(self.centre >= 0, place[:, np.maximum(self.centre, 0)] < self.index.probed, True)
        near |= np.isneginf(kth)[:, None]  # fewer than k are known
        return near & (self.bounds(q) >= kth[:, None]) & ~self.first(q)


def search(df: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vec: str = "embedding", seed: int = 1) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, by largest inner product. The result is a written table; those on the way are deleted."""
    with temporary():
        return written(_searched(df, is_query, k, vec_id, vec, seed), "ann-found", keep=True)


def _searched(df: DataFrame, is_query: Column, k: int, vec_id: str, vec: str, seed: int) -> DataFrame:
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"), is_query.alias("q")).where(usable(F.col("v")) & F.col("id").isNotNull())
    sizes = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).collect()  # a row a length
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total, width = max((r.n, r.width) for r in sizes)
    rows = rows.where(F.size("v") == width)
    most = max(256, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    head = rows.select("v", F.xxhash64("id", F.lit(seed)).alias("h")).orderBy("h").limit(most).select("v").toArrow()
    sample = np.stack(head.column(0).combine_chunks().to_numpy(zero_copy_only=False))
    index = Index(sample, int(max(1, min(LISTS, len(sample) // 8, round(total**0.5 / 2)))), k, seed)
    share = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                p = b.slice(at, 4096)
                i = share.value
                x, f, e = i.directions(np.stack(p.column(1).to_numpy(zero_copy_only=False)))
                own = i.order(x, i.centres, 1)[:, 0]
                off = np.sqrt(((x - i.centres[own]) ** 2).sum(axis=1))
                band = (e - i.mid + BAND // 2) // BAND
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), p.column(2), pa.array(own.astype(np.int32)), pa.array(off), pa.array(band.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(f)], ["id", "v", "q", "centre", "off", "band", "e", "f"])

    indexed = written(rows.mapInArrow(assign, "id long, v array<double>, q boolean, centre int, off double, band int, e int, f double"), "ann-index")
    low, high = F.min(F.struct("e", "f")), F.max(F.struct("e", "f"))
    stats = indexed.groupBy("band", "centre").agg(F.count("*").alias("n"), F.max("off").alias("off"), low.alias("low"), high.alias("high"))
    stats = stats.select("band", "centre", "n", "off", "low.*", F.col("high.e").alias("e2"), F.col("high.f").alias("f2")).toPandas()  # LISTS rows a band at most
    unit = int(stats["e2"].max())
    stats["low"], stats["high"] = np.ldexp(stats["f"], stats["e"] - unit), np.ldexp(stats["f2"], stats["e2"] - unit)
    small = stats.groupby("band")["n"].transform("sum") < total / 16
    stats["centre"] = stats["centre"].where(~small, -1)  # a small band is one list
    stats = stats.groupby(["band", "centre"], as_index=False).agg({"n": "sum", "off": "max", "low": "min", "high": "max"}).sort_values(["band", "centre"], ascending=[False, True])
    held = stats["n"].to_numpy(np.int64)
    lists = Lists(index, stats["band"].to_numpy(), stats["centre"].to_numpy(), held, stats["off"].to_numpy(), stats["low"].to_numpy(), stats["high"].to_numpy(), k)
    known = spark.sparkContext.broadcast(lists)
    whole = sorted(int(e) for e, c in zip(lists.band, lists.centre, strict=True) if c < 0)
    cell, place = cells_of(held, min(BLOCK, -(-total // CELLS)))
    n_cells = int(cell[-1]) + 1
    members = [np.flatnonzero(cell == c) for c in range(n_cells)]
    cuts = np.array([max(1, -(-int(held[m].sum()) // BLOCK)) for m in members])
    slot = {(int(e), int(c)): j for j, (e, c) in enumerate(zip(lists.band, lists.centre, strict=True))}
    asked = written(indexed.where("q").groupBy("id").agg(F.min("v").alias("v")), "ann-queries")
    n_asked = asked.count()

    def dealt(queries: DataFrame, rest: bool) -> DataFrame:
        """(id, v, kth, cell, opened) of (id, v, score): each cell where a query scans lists, as bits; kth is what its k best reach."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = known.value
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    p = b.slice(at, 1024)
                    raw = np.stack(p.column(1).to_numpy(zero_copy_only=False))
                    q, f, e = own.index.directions(raw)
                    kth = np.full(p.num_rows, -np.inf)
                    if rest:
                        score = p.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                        got = ~np.isnan(score)  # else fewer than k found
                        with np.errstate(over="ignore"):
                            kth[got] = np.ldexp(np.clip(score[got], -HUGE, HUGE) / 2 / f[got], 1 - e[got] - unit)
                        kth -= SLACK * np.abs(np.where(got, kth, 0)) + 1e-300
                    named = own.rest(q, kth) if rest else own.first(q)
                    for c, m in enumerate(members):
                        if len(to := np.flatnonzero(named[:, m].any(axis=1))):
                            bits = [x.tobytes() for x in np.packbits(named[to][:, m], axis=1)]
                            yield pa.RecordBatch.from_arrays([p.column(0).take(pa.array(to)), p.column(1).take(pa.array(to)), pa.array(kth[to]), pa.array(np.full(len(to), c, np.int32)), pa.array(bits, pa.binary())], ["id", "v", "kth", "cell", "opened"])

        return queries.mapInArrow(run, "id long, v array<double>, kth double, cell int, opened binary")

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        i, raw, qraw = share.value, np.stack(a["v"]), np.stack(b["v"])
        opened = np.unpackbits(np.stack([np.frombuffer(x, np.uint8) for x in b["opened"]]), axis=1).astype(bool)
        x, f, e = i.directions(raw)
        q, fq, eq = i.directions(qraw)
        with np.errstate(over="ignore"):
            cap = np.ldexp(HUGE / 2 / fq * (1 - 1e-9), 1 - eq - unit)
        got = scan_cell(place[a["list"].to_numpy()], a["id"].to_numpy(), x, np.ldexp(f, e - unit), raw, opened, b["id"].to_numpy(), q, qraw, b["kth"].to_numpy(), cap, k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), got, strict=True)))

    at = lambda a, c="cell": F.element_at(F.array(*(F.lit(int(n)) for n in a)), F.col(c) + 1)
    blocks = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    split = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")
    on = ["cell", "block", "q_block"]
    centre = F.when(F.col("band").isin(whole), -1).otherwise(F.col("centre"))
    names = spark.createDataFrame([(e, c, j) for (e, c), j in slot.items()], "own int, at int, list int")
    placed = indexed.withColumn("centre", centre).join(F.broadcast(names), (F.col("band") == F.col("own")) & (F.col("centre") == F.col("at"))).select("id", "v", "list")

    def found(queries: DataFrame, rest: bool) -> DataFrame:
        sent, q_cuts = dealt(queries, rest), np.ones(n_cells, int)
        if n_asked > QUERY_BLOCK:
            for r in sent.groupBy("cell").agg(F.count("*").alias("n")).collect():
                q_cuts[r.cell] = max(1, -(-r.n // QUERY_BLOCK))
        left = placed.select("id", "v", "list", at(cell, "list").alias("cell")).select("id", "v", "list", "cell", split(at(cuts), seed + 1).alias("block"), blocks(at(q_cuts)).alias("q_block"))
        right = sent.select("id", "v", "kth", "cell", "opened", blocks(at(cuts)).alias("block"), split(at(q_cuts), seed + 2).alias("q_block"))
        return left.groupBy(on).cogroup(right.groupBy(on)).applyInPandas(one, "query_id long, vec_id long, score double")

    number = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(number.desc(), F.isnan("score"), "vec_id"))
    top = lambda df: df.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    best = top(found(asked.withColumn("score", F.lit(None).cast("double")), False))
    if len(held) <= PROBE:
        return best
    best = written(best, "ann-first")
    kth = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), "score")
    more = found(asked.join(kth, "id", "left").select("id", "v", "score"), True)
    return top(best.drop("rank").unionByName(more))
