"""Fuzzy c-means as a loop of aggregates: only the centres, a few vectors, ever reach the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import distance


def _constant(v: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def _weights(centres: Sequence[Sequence[float]], m: float) -> tuple[Column, Column]:
    """The memberships of ``v`` in all centres, and its distances to them."""
    d = F.array(*(F.greatest(distance(F.col("v"), _constant(c)), F.lit(1e-12)) for c in centres))
    return F.transform("inv__", lambda x: x / F.aggregate("inv__", F.lit(0.0), lambda s, y: s + y)), d


def assigned(df: DataFrame, centres: Sequence[Sequence[float]], m: float = 2.0) -> DataFrame:
    """Adds ``u``, the memberships, and ``d``, the distances, in order of the centres."""
    u, d = _weights(centres, m)
    t = df.withColumn("d", d).withColumn("inv__", F.transform("d", lambda x: F.pow(x, F.lit(-2.0 / (m - 1)))))
    return t.withColumn("u", u).drop("inv__")


def step(df: DataFrame, centres: Sequence[Sequence[float]], m: float = 2.0) -> tuple[list[list[float]], float]:
    """New centres, and the objective of the old: one pass over the rows.

    A row's part of a centre is added up by dimension with partial sums before
    the shuffle, so that what is shuffled is centres x dimensions numbers a task.
    """
    t = assigned(df, centres, m)
    w = F.transform("u", lambda x: F.pow(x, F.lit(m)))
    each = t.select("v", F.posexplode(F.arrays_zip(w.alias("w"), F.col("d"))).alias("c", "p"))
    each = each.select("c", F.col("p.w").alias("w"), (F.col("p.w") * F.col("p.d") * F.col("p.d")).alias("o"), F.posexplode("v").alias("k", "x"))
    rows = each.groupBy("c", "k").agg(F.sum(F.col("w") * F.col("x")).alias("wx"), F.sum("w").alias("w"), F.sum("o").alias("o")).collect()  # centres x dimensions
    out = [[0.0] * len(c) for c in centres]
    for r in rows:
        out[r["c"]][r["k"]] = r["wx"] / max(r["w"], 1e-12)
    return out, sum(r["o"] for r in rows if r["k"] == 0)


def fit(df: DataFrame, start: Sequence[Sequence[float]], m: float = 2.0, rounds: int = 50, tolerance: float = 1e-4) -> tuple[list[list[float]], list[dict]]:
    """The centres from a first guess, and the trace: each round's objective and the largest move of a centre.

    Rounds end when no centre's coordinate moves by ``tolerance``. Rows whose
    vector is null take no part. Without rows the centres stay.
    """
    if m <= 1:
        raise ValueError("m must be above 1")
    rows, centres, trace = df.where("v is not null"), [list(map(float, c)) for c in start], []
    for k in range(rounds):
        new, objective = step(rows, centres, m)
        if objective == 0 and not any(any(c) for c in new):
            break
        moved = max(abs(a - b) for old, now in zip(centres, new, strict=True) for a, b in zip(old, now, strict=True))
        trace.append({"round": k, "objective": objective, "moved": moved})
        centres = new
        if moved < tolerance:
            break
    return centres, trace


def first_centres(df: DataFrame, by: str = "cluster") -> list[list[float]]:
    """The centroids of a few named groups, in order of their names: a start that any engine can repeat."""
    from .geometry import centroids

    return [r["centre"] for r in centroids(df, by).orderBy(by).collect()]


def best(df: DataFrame, starts: Sequence[Sequence[Sequence[float]]], m: float = 2.0, rounds: int = 50) -> tuple[list[list[float]], list[dict]]:
    """The fit with the least objective at its end; of equals the first."""
    return min((fit(df, s, m, rounds) for s in starts), key=lambda f: f[1][-1]["objective"] if f[1] else float("inf"))
