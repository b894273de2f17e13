"""Resampling of clips with shared weights, generators of outcomes, agreement beyond chance, matching, silhouettes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .metrics import contingency, gains
from .ranks import running


def uniform(*on: Column) -> Column:
    """A number in [0, 1) from 13 hexadecimal digits of an MD5, as any engine can make it."""
    text = F.concat_ws("|", *(c.cast("string") for c in on))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


# -- paired clip bootstrap


def clip_weights(df: DataFrame, draws: int, seed: int = 1) -> DataFrame:
    """(draw, clip, w): each draw takes as many clips as there are, with replacement, by a hash of (seed, draw, place).

    A draw's places are rows, and so are spread over tasks; the weights of a draw
    serve all arms, so that differences are paired.
    """
    clips = df.select("clip").where("clip is not null").distinct().withColumn("one", F.lit(1))
    named = running(clips.withColumn("h", F.conv(F.substring(F.md5(F.col("clip").cast("string").cast("binary")), 1, 13), 16, 10).cast("long")), [], "h", "one")
    named = named.select("clip", F.col("from__").alias("place"), F.col("all__").alias("n"))
    every = named.select("place", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    taken = every.select("draw", F.floor(uniform(F.lit(seed), F.col("draw"), F.col("place")) * F.col("n")).cast("long").alias("taken"))
    w = taken.groupBy("draw", "taken").agg(F.count("*").alias("w"))
    return w.join(named.select("clip", "place"), F.col("taken") == F.col("place")).select("draw", "clip", "w")


def drawn_gains(df: DataFrame, by: Sequence[str], draws: int, seed: int = 1) -> DataFrame:
    """(by, draw, x): the weighted mean gain of each arm in each draw; draw -1 is the point estimate. Rows without a clip take no part in either."""
    blocks = gains(df).where("clip is not null").groupBy(*by, "clip").agg(F.count("*").alias("n"), F.sum("gain").alias("g"))
    w = clip_weights(df, draws, seed)
    out = blocks.join(w, "clip").groupBy(*by, "draw").agg((F.sum(F.col("w") * F.col("g")) / F.sum(F.col("w") * F.col("n"))).alias("x"))
    point = blocks.groupBy(*by).agg((F.sum("g") / F.sum("n")).alias("x")).select(*by, F.lit(-1).alias("draw"), "x")
    return point.unionByName(out)


def intervals(drawn: DataFrame, by: Sequence[str], x: str = "x") -> DataFrame:
    """(by, point, low, high, draws, above): the 95 % range of the draws that have a value, and the share of them above 0."""
    d = F.col("draw") >= 0
    v = F.when(d, F.col(x))
    return drawn.groupBy(*by).agg(F.max(F.when(~d, F.col(x))).alias("point"), F.percentile(v, F.lit(0.025)).alias("low"), F.percentile(v, F.lit(0.975)).alias("high"), F.count(v).alias("draws"), F.avg((v > 0).cast("double")).alias("above"))


def paired_changes(drawn: DataFrame, by: Sequence[str], arm: str, base: str) -> DataFrame:
    """(by, arm, draw, x): each arm's value less the base arm's in the same draw."""
    b = drawn.where(F.col(arm) == base).select(*(F.col(c).alias(f"{c}_b") for c in by), F.col("draw").alias("draw_b"), F.col("x").alias("x_b"))
    on = F.col("draw") == F.col("draw_b")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_b"))
    return drawn.where(F.col(arm) != base).join(b, on).select(*by, arm, "draw", (F.col("x") - F.col("x_b")).alias("x"))


# -- agreement beyond chance


def expected_information(cells: DataFrame) -> DataFrame:
    """Adds ``emi`` to (na, nb, total): what a pair of groups adds to the mutual information of random groupings.

    The overlap of two groups is hypergeometric. Its weights come by their ratios from
    a start below the mode, and are divided by their sum; what lies 12 standard
    deviations away is below the last digit.
    """
    a, b, n = (F.col(c).cast("double") for c in ("na", "nb", "total"))
    sd = F.sqrt(a * b / n * (n - a) / n * (n - b) / F.greatest(n - 1, F.lit(1.0)))
    low = F.greatest(F.lit(0.0), a + b - n, F.floor(a * b / n - 12 * sd - 20)).cast("long")
    high = F.least(a, b, F.ceil(a * b / n + 12 * sd + 20)).cast("long")
    t = cells.withColumns({"a_": a, "b_": b, "n_": n, "low_": low, "high_": high})
    term = lambda k: F.when(k > 0, k / F.col("n_") * F.log(F.col("n_") * k / (F.col("a_") * F.col("b_")))).otherwise(0.0)

    def step(s: Column, k: Column) -> Column:
        k = k.cast("double")
        w = s["w"] * (F.col("a_") - k + 1) * (F.col("b_") - k + 1) / (k * (F.col("n_") - F.col("a_") - F.col("b_") + k))
        scale = F.when(w > 1e200, F.lit(1e-200)).otherwise(1.0)
        return F.struct((w * scale).alias("w"), ((s["all"] + w) * scale).alias("all"), ((s["sum"] + w * term(k)) * scale).alias("sum"))

    first = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("all"), term(F.col("low_").cast("double")).alias("sum"))
    steps = F.when(F.col("high_") > F.col("low_"), F.sequence(F.col("low_") + 1, F.col("high_"))).otherwise(F.array().cast("array<bigint>"))
    return t.withColumn("emi", F.aggregate(steps, first, step, lambda s: s["sum"] / s["all"])).drop("a_", "b_", "n_", "low_", "high_")


def adjusted_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mutual information, its expectation, and the adjusted one (mean of entropies as upper bound). Pairs of groups, not of rows, are looked at."""
    c = contingency(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b)
    ra, rb = c.groupBy("a").agg(F.sum("n").alias("na")), c.groupBy("b").agg(F.sum("n").alias("nb"))
    total = c.agg(F.sum("n").alias("total"))
    ra, rb = ra.join(F.broadcast(total)), rb.withColumn("one", F.lit(1))
    mi = c.join(ra, "a").join(rb.drop("one"), "b").agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("mi"))
    h = lambda t, m: t.agg((-F.sum(F.col(m) / F.col("total") * F.log(F.col(m) / F.col("total")))).alias(f"h_{m}"))
    sizes = ra.groupBy("na", "total").agg(F.count("*").alias("ka")).withColumn("one", F.lit(1)).join(rb.groupBy("nb").agg(F.count("*").alias("kb")).withColumn("one", F.lit(1)), "one")  # pairs of sizes
    emi = expected_information(sizes).agg(F.sum(F.col("emi") * F.col("ka") * F.col("kb")).alias("emi"))
    one = mi.join(F.broadcast(emi)).join(F.broadcast(h(ra, "na"))).join(F.broadcast(h(rb.join(F.broadcast(total)), "nb")))  # one row each
    return one.select("mi", "emi", ratio(F.col("mi") - F.col("emi"), (F.col("h_na") + F.col("h_nb")) / 2 - F.col("emi")).alias("ami"))


def matched(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n): the one-to-one matching of groups that keeps most rows. The table of counts, a row a pair of groups, goes to the driver: groups must be few."""
    c = [(r.a, r.b, r.n) for r in contingency(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b).limit(MOST_CELLS + 1).collect()]
    if len(c) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} pairs of groups")
    rows, cols = sorted({x[0] for x in c}), sorted({x[1] for x in c})
    n = {(x, y): k for x, y, k in c}
    table = [[n.get((x, y), 0) for y in cols] for x in rows]
    pairs = assignment(table)
    kinds = dict(df.dtypes)
    return df.sparkSession.createDataFrame([(rows[i], cols[j], int(table[i][j])) for i, j in pairs], f"a {kinds[a]}, b {kinds[b]}, n long")


#: Pairs of groups that a matching takes at most.
MOST_CELLS = 250_000


def assignment(gain: Sequence[Sequence[float]]) -> list[tuple[int, int]]:
    """The largest sum with one cell a row and column at most, by augmenting paths of least reduced cost."""
    import numpy as np

    g = np.array(gain, float)
    if not g.size:
        return []
    flip = g.shape[0] > g.shape[1]
    cost = -(g.T if flip else g)
    rows, cols = cost.shape
    of_row, of_col = np.zeros(rows), np.zeros(cols)
    owner = np.full(cols, -1)
    for start in range(rows):
        reach, came, done = np.full(cols, np.inf), np.full(cols, -1), np.zeros(cols, bool)
        row, at, last, low = start, -1, -1, 0.0
        while True:
            slack = low + cost[row] - of_row[row] - of_col
            better = ~done & (slack < reach)
            reach[better], came[better] = slack[better], last
            at = int(np.where(done, np.inf, reach).argmin())
            low = reach[at]
            done[at] = True
            if owner[at] < 0:
                break
            row, last = int(owner[at]), at
        seen = done & (reach <= low)
        of_row[start] += low
        for j in np.flatnonzero(seen):
            if owner[j] >= 0:
                of_row[owner[j]] += low - reach[j]
            of_col[j] -= low - reach[j]
        while at >= 0:  # turn the path
            before = int(came[at])
            owner[at] = start if before < 0 else owner[before]
            at = before
    out = [(int(i), j) for j, i in enumerate(owner) if i >= 0]
    return sorted((j, i) if flip else (i, j) for i, j in out)


#: Rows of a block of :func:`silhouettes`, at least and at most, and blocks where that allows; distances that are held at once.
LEAST, LARGEST, BLOCKS, HELD = 4096, 1 << 15, 16, 1 << 20


def block_rows(n: int) -> int:
    """A row is shuffled once for each block, and once more for its own: blocks grow with the table, until a task's memory is what counts."""
    return min(LARGEST, max(LEAST, -(-n // BLOCKS)))


def silhouettes(df: DataFrame, group: str, v: str = "v", noise: int | None = None, block: int | None = None) -> DataFrame:
    """(id, group, s): each row's silhouette by Euclidean distance; 0 for a group's only row.

    Exact: pairs of blocks give each row the sum of its distances to every group, and
    Spark adds the sums up. A pair of blocks is met once, for the rows of both. The work
    is half of rows times rows; no task holds more than two blocks.
    """
    import numpy as np
    import pandas as pd

    t = df.select("id", F.col(group).alias("g"), F.col(v).alias("v")).where("g is not null")
    if noise is not None:
        t = t.where(F.col("g") != noise)
    n = t.count()
    parts = max(1, -(-n // (block or block_rows(n))))
    side = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    later, earlier = F.explode(F.sequence(side, F.lit(parts - 1))), F.explode(F.sequence(F.lit(0), side))

    def rows(a: pd.DataFrame, names: np.ndarray, far: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"id": np.repeat(a["id"].to_numpy(), len(names)), "g": np.repeat(a["g"].to_numpy(), len(names)), "other": np.tile(names, len(a)), "far": far.ravel()})

    def members(a: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        names, at = np.unique(a["g"].to_numpy(), return_inverse=True)
        return names, (at[:, None] == np.arange(len(names))[None, :]).astype(float)

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "g": [], "other": [], "far": []})
        x, y = np.stack(a["v"]).astype(float), np.stack(b["v"]).astype(float)
        (a_names, a_member), (b_names, b_member) = members(a), members(b)
        out, back, same = np.zeros((len(x), len(b_names))), np.zeros((len(y), len(a_names))), a["i"].iloc[0] == a["j"].iloc[0]
        x2, y2 = (x * x).sum(axis=1), (y * y).sum(axis=1)
        step = max(1, HELD // len(y))
        for k in range(0, len(x), step):
            some, size = x[k : k + step], x2[k : k + step, None] + y2[None, :]
            d = size - 2 * some @ y.T
            row, col = np.nonzero(d < 1e-3 * size)  # close rows: a difference of products would lose digits
            for c in range(0, len(row), 20_000):
                r, q = row[c : c + 20_000], col[c : c + 20_000]
                d[r, q] = ((some[r] - y[q]) ** 2).sum(axis=1)
            d = np.sqrt(np.maximum(d, 0))
            out[k : k + step] = d @ b_member
            if not same:
                back += d.T @ a_member[k : k + step]
        there = rows(a, b_names, out)
        return there if same else pd.concat([there, rows(b, a_names, back)])

    kind = dict(t.dtypes)["g"]
    left, right = t.select("*", side.alias("i"), later.alias("j")), t.select("*", side.alias("j"), earlier.alias("i"))
    sums = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(one, f"id long, g {kind}, other {kind}, far double").groupBy("id", "g", "other").agg(F.sum("far").alias("far"))
    sizes = t.groupBy(F.col("g").alias("name")).agg(F.count("*").alias("n"))
    j = sums.join(F.broadcast(sizes), F.col("other") == F.col("name"))  # a row a group
    own = F.col("g") == F.col("other")
    g = j.groupBy("id", "g").agg(F.max(F.when(own, F.col("n"))).alias("n"), F.max(F.when(own, F.col("far"))).alias("in_"), F.min(F.when(~own, F.col("far") / F.col("n"))).alias("out_"))
    inside = ratio(F.col("in_"), F.col("n") - 1)
    return g.select("id", F.col("g").alias(group), F.when(F.col("n") <= 1, 0.0).otherwise((F.col("out_") - inside) / F.greatest("out_", inside)).alias("s"))


# -- generators of outcomes


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def zscored(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns less their mean, over their population sd (1 where that is tiny)."""
    one = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = {c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 1e-12, F.col(f"s_{c}")).otherwise(1.0) for c in columns}
    return df.join(F.broadcast(one)).withColumns(z).select(*df.columns)  # one row


def intercept(df: DataFrame, score: str, rate: float, rounds: int = 8, points: int = 16) -> float:
    """What to add to the scores so that expit of them has a mean of ``rate``: a round sums at 15 points within the bounds, in one pass over all rows."""
    t = df.select(F.col(score).cast("double").alias("s"))
    low, high = -50.0, 50.0
    for _ in range(rounds):
        at = [low + (high - low) * k / points for k in range(1, points)]
        got = t.agg(*(F.avg(expit(F.col("s") + F.lit(x))).alias(f"m{k}") for k, x in enumerate(at))).first()
        above = next((k for k, m in enumerate(got) if m is not None and m >= rate), len(at))
        low, high = ([low, *at][above], [*at, high][above])
    return (low + high) / 2


#: Scenarios of the generator, as weights of (linear, square, product, clip's state).
SCENARIOS = {"null": (0.0, 0.0, 0.0, 0.5), "linear": (0.8, 0.0, 0.0, 0.5), "curved": (0.0, 0.6, 0.0, 0.5), "joint": (0.4, 0.0, 0.6, 0.5)}


def normal(*on: Column) -> Column:
    """A normal number from two uniform ones of a key."""
    u = F.greatest(uniform(F.lit("u"), *on), F.lit(1e-12))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(F.lit("v"), *on))


def scores(df: DataFrame, a: str, b: str, weights: Sequence[float], seed: int) -> DataFrame:
    """Adds ``score``: linear and other effects of two covariates, and a state that a clip's rows share."""
    linear, square, product, state = weights
    x, y = F.col(a), F.col(b)
    s = linear * x + square * (x * x - 1) + product * x * y + state * normal(F.lit(seed), F.lit("clip"), F.col("clip"))
    return df.withColumn("score", s)


def generated(df: DataFrame, a: str, b: str, rates: dict[str, float], seed: int = 1, scenarios: dict[str, Sequence[float]] | None = None) -> DataFrame:
    """(df's columns, scenario, target, p, y): outcomes whose mean probability is each target's rate.

    Uniform numbers come from hashes of (seed, scenario, target, call), so that rows
    can be made in any order and again.
    """
    out = None
    for name, weights in (scenarios or SCENARIOS).items():
        t = scores(df, a, b, weights, seed)
        for target, rate in rates.items():
            p = expit(F.col("score") + F.lit(intercept(t, "score", rate)))
            u = uniform(F.lit(seed), F.lit(name), F.lit(target), F.col("call_id"))
            part = t.select(*df.columns, F.lit(name).alias("scenario"), F.lit(target).alias("target"), p.alias("p"), (u < p).cast("int").alias("y"))
            out = part if out is None else out.unionByName(part)
    return out


def one_sided(df: DataFrame, a: str, b: str, rate: float, seed: int = 1) -> DataFrame:
    """An asymmetric pair: for ``post`` the outcome has nothing to do with ``a``; for ``pre`` it is linear in it."""
    post = generated(df, a, b, {"post": rate}, seed, {"asymmetric": SCENARIOS["null"]})
    return post.unionByName(generated(df, a, b, {"pre": rate}, seed, {"asymmetric": SCENARIOS["linear"]}))


def materialised(design: DataFrame, packet: DataFrame, marks: Sequence[str], drop: Sequence[str] = ("y",)) -> DataFrame:
    """A design with the packet's columns in place of its own, and without its real targets."""
    kept = [c for c in design.columns if c not in {*marks, *drop}]
    return design.select(*kept).join(packet, "call_id")
