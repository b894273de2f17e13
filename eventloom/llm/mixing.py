"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is a number of words. Documents are counted by exact length
(source, length); what the target leaves after whole passes over the source is
the budget. Each length first gives the same share of its documents, so that the
mix has the source's lengths; a bounded-knapsack table over all documents still
free then fits what the share leaves. Where it can't be met exactly the share is
cut back and the table grows, up to the whole budget: the sum is the largest
that any choice of documents reaches (within TABLE_BITS). Which documents of a
length are taken is by a seeded hash of id and text, so reruns agree.

Scale. The planning step sees lengths, not documents: at most as many rows as a
source has distinct lengths. Documents of one (source, length) are ranked in
parts by hash (SPLITS, or more of PART_ROWS documents), with the parts' counts as
offsets, so that no task needs all documents of a hot source or length.

Values: a null text, or one without words, has size 0 and is taken at 0 words;
null sources are one source, after all others; a source of no words has target
0. Rows that repeat are separate documents. Extra columns go through; the added
columns replace columns of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import free_name, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: Parts in which the documents of one (source, length) are ranked at least, and documents for each part where there are more.
SPLITS, PART_ROWS = 64, 4_000_000
#: Words of the budget that the first knapsack table fits.
TABLE = 1 << 16
#: Documents of a short length that the table may always choose or leave.
EACH = 8
#: Bits of all tables held at once (256 MB). A budget that no smaller table meets gets one of its full size up to here, for
#: instance 10 million words in 2,500 steps of the table, or 200 million in 30. Beyond that the sum is the best of the largest
#: window allowed; with more documents than that the window nearly always meets the budget.
TABLE_BITS = 1 << 31


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size), one row a source.

    Sharing by weight, stopping at the cap and sharing the excess again ends at
    min(cap, level * weight) for one level. In order of cap / weight the sources
    at their cap come first, so running sums give the level in closed form. This
    works on the table of sources, which has a row for each source and no more.
    """
    w = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*(F.lit(float(x)) for x in weights))
    t = sizes.withColumn("weight", F.element_at(cycle, (F.row_number().over(w) - 1) % len(weights) + 1))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    t = t.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    t = t.withColumn("capped", F.sum("cap").over(up) - F.col("cap")).withColumn("before", F.sum("weight").over(up) - F.col("weight"))
    t = t.withColumn("level", (F.col("total") - F.col("capped")) / (F.sum("weight").over(every) - F.col("before")))
    # the first source whose cap isn't reached at the level that holds there fixes the level; of equal ratios the first has the largest
    level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", (-F.col("level")).alias("minus")))).over(every)["minus"]
    return t.withColumn("at", -level).withColumn("target", F.least("cap", F.coalesce(F.col("at") * F.col("weight"), F.col("cap")))).select("source", "source_size", "target")


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest to the budget from below.

    A share of each length goes first, the same for all, and leaves a window of the
    budget to a bounded-knapsack table over all documents still free. The window
    doubles until the table meets the budget, or is the whole budget, so
    that no better choice exists. Only where the table would need more than
    TABLE_BITS does the nearest sum so far stand (see :data:`TABLE_BITS`).
    """
    order = np.argsort(-lengths)
    size, free = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    total = int((size * free).sum())
    best = np.zeros(len(size), np.int64)
    if budget >= total:
        best = free.copy()
    elif total and budget > 0:
        step = int(np.gcd.reduce(size[(size > 0) & (free > 0)]))  # all sums are multiples of it
        small, goal = size // step, budget // step
        window = min(TABLE, goal)
        while True:
            take = _shared(small, free - _reserve(small, free, window), goal - window)
            left = goal - int((small * take).sum())
            take = take + _knapsack(small, free - take, left)
            if int((small * take).sum()) > int((small * best).sum()):
                best = take
            if window == goal or int((small * best).sum()) == goal or table_bits(small, free, min(2 * window, goal)) > TABLE_BITS:
                break
            window = min(2 * window, goal)
    out = np.empty(len(size), np.int64)
    out[order] = best
    return out


def _reserve(size: np.ndarray, free: np.ndarray, words: int) -> np.ndarray:
    """The shortest documents, up to EACH of a length, of so many words: they stay free for the table."""
    some = np.minimum(free, EACH)
    upto = np.cumsum((size * some)[::-1])[::-1]  # lengths come in falling order
    return np.where(upto <= words, some, 0)


def _shared(size: np.ndarray, free: np.ndarray, words: int) -> np.ndarray:
    """About the same share of each length, ``words`` or less by at most the longest document in sum."""
    take, total, ideal, held = np.zeros(len(size), np.int64), int((size * free).sum()), 0, 0
    if words > 0:
        for k, (s, n) in enumerate(zip(size.tolist(), free.tolist(), strict=True)):
            ideal += s * n * words  # in parts of total
            if s:
                take[k] = max(0, min(n, (ideal // total - held) // s))
                held += int(take[k]) * s
    return take


def _parts(size: np.ndarray, free: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """(length's place, documents at once): counts in powers of two, as far as the budget can use them."""
    out = []
    for k, (s, n) in enumerate(zip(size.tolist(), free.tolist(), strict=True)):
        n, part = min(n, budget // s if s else 0), 1
        while n > 0:
            out.append((k, min(part, n)))
            n, part = n - part, part * 2
    return out


def table_bits(size: np.ndarray, free: np.ndarray, budget: int) -> int:
    """Bits of the tables that :func:`_knapsack` keeps at once."""
    return 2 * (budget + int(size.max())) * (math.isqrt(len(_parts(size, free, budget))) + 1)


def _knapsack(size: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack over lengths: the largest reachable sum up to the budget, as counts by length.

    A table is the bits of one whole number. Every so many steps one is kept; the
    tables between two of them are made again on the way back.
    """
    take = np.zeros(len(size), np.int64)
    parts, mask = _parts(size, free, budget), (1 << budget + 1) - 1
    grown = lambda reach, k, m: (reach | reach << m * int(size[k])) & mask
    every = math.isqrt(len(parts)) + 1
    reach, kept, done = 1, [], 0
    for k, m in parts:
        if reach >> budget & 1:
            break
        if done % every == 0:
            kept.append(reach)
        reach, done = grown(reach, k, m), done + 1
    at = reach.bit_length() - 1
    for block in range(len(kept) - 1, -1, -1):
        own = parts[block * every : min(done, (block + 1) * every)]
        tables = [kept.pop()]
        for k, m in own[:-1]:
            tables.append(grown(tables[-1], k, m))
        for (k, m), before in zip(reversed(own), reversed(tables), strict=True):
            if not before >> at & 1:
                take[k] += m
                at -= m * int(size[k])
    return take


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 1, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds size, source_size, target, copies, and taken (words the mix takes of the document: copies * size)."""
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    key, part, draw, rank = (free_name(docs, x) for x in ("mix_key", "mix_part", "mix_draw", "mix_rank"))
    splits = max(SPLITS, -(-docs.count() // PART_ROWS))
    base = docs.withColumns({
        "size": word_count(F.col(text)),
        key: F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")),  # "" stands for null
        part: F.pmod(F.xxhash64(F.col(doc_id), F.col(text), F.lit(seed + 1)), F.lit(splits)).cast("int"),
        draw: F.xxhash64(F.col(doc_id), F.col(text), F.lit(seed)),
    })
    counts = written(base.groupBy(F.col(key).alias("key"), "size", F.col(part).alias("part")).agg(F.count("*").alias("n")), "mix-counts")
    hist = counts.groupBy("key", "size").agg(F.sum("n").alias("n"))
    sums = hist.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    named = sums.withColumn("source", F.when(F.col("key") != "", F.expr("substring(key, 2)")))
    goal = targets(named.select("source", "source_size"), weights, share, most)
    goal = goal.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).drop("source")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("passes", passes).withColumn("budget", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    goal = written(goal, "mix-targets")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        take = fit(pdf["size"].to_numpy(), pdf["n"].to_numpy(), int(pdf["budget"].iloc[0]))
        return pd.DataFrame({"key": pdf["key"], "size": pdf["size"], "take": take})

    planned = hist.join(goal.select("key", "budget"), "key").groupBy("key").applyInPandas(plan, "key string, size long, take long")
    # parts in order of their number: a part's first rank is what the parts before it hold
    upto = Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = counts.withColumn("before", F.sum("n").over(upto) - F.col("n"))
    quota = before.join(planned, ["key", "size"]).join(goal, "key")
    quota = quota.select("key", "size", "part", F.greatest(F.lit(0), F.least("n", F.col("take") - F.col("before"))).alias("quota"), "source_size", "target", "passes")
    order = Window.partitionBy(key, "size", part).orderBy(draw, F.col(doc_id))
    a, b = base.withColumn(rank, F.row_number().over(order)).alias("a"), quota.alias("b")
    on = (F.col(f"a.{key}") == F.col("b.key")) & (F.col("a.size") == F.col("b.size")) & (F.col(f"a.{part}") == F.col("b.part"))
    copies = (F.col("b.passes") + F.when(F.col(f"a.{rank}") <= F.col("b.quota"), 1).otherwise(0)).cast("long")
    out = a.join(b, on).select(*(F.col(f"a.`{c}`") for c in docs.columns), "a.size", "b.source_size", "b.target", copies.alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def repeated(mixed: DataFrame, columns: list[str], copies: str = "copies") -> DataFrame:
    """The mix itself: each document as many times as it is taken."""
    return mixed.where(F.col(copies) > 0).select(*columns, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias("mix_copy__")).drop("mix_copy__")
