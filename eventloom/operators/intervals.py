"""Joins and windows on intervals inside clips: as-of, overlap, union length, history, edges.

A clip may hold a large share of all rows. No operator needs a clip's rows in
one task: time is cut into buckets, rows meet by (clip, bucket), and what must
cross a bucket's bound comes from a table with one row a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio

#: Seconds that a bucket covers, and rows of a clip above which buckets of an as-of join get smaller.
BUCKET, BUCKET_ROWS = 86_400.0, 200_000


def bucket_of(times: DataFrame, by: str = "by__", t: str = "t__") -> float:
    """Seconds a bucket may cover so that the densest clip has BUCKET_ROWS rows in one, about; BUCKET at most."""
    g = times.where(F.col(by).isNotNull() & F.col(t).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), (F.max(t) - F.min(t)).alias("extent"))
    dense = g.agg(F.max(F.col("n") / F.greatest(F.col("extent"), F.lit(1e-6)))).first()[0] or 0.0  # rows a second
    return min(BUCKET, max(BUCKET_ROWS / dense, 1e-6)) if dense else BUCKET


def asof(left: DataFrame, right: DataFrame, left_time: str, right_time: str, keep: Sequence[str], forward: bool, by: str = "clip", tie: str = "call_id", bucket: float | None = None, name: str = "found") -> DataFrame:
    """Adds to each left row a struct of the nearest right row's ``keep``: at or after its time, or at or before it.

    Equal times match. Of right rows at one time the one with the smallest tie
    value is nearest forward, the largest backward. Null where there is none;
    rows with a null clip or time find nothing.
    """
    way = -1.0 if forward else 1.0  # forward is backward in reversed time
    lcols = F.struct(*(F.col(c) for c in left.columns))
    payload = F.struct((F.col(right_time) * way).alias("t__"), (F.col(tie) * int(way)).alias("tie__"), *(F.col(c) for c in keep))
    a = left.select(F.col(by).alias("by__"), (F.col(left_time) * way).alias("t__"), F.lit(1).alias("side__"), F.lit(None).cast("long").alias("o__"), lcols.alias("row__"))
    b = right.where(F.col(by).isNotNull() & F.col(right_time).isNotNull()).select(F.col(by).alias("by__"), (F.col(right_time) * way).alias("t__"), F.lit(0).alias("side__"), (F.col(tie) * int(way)).cast("long").alias("o__"), payload.alias("hit__"))
    both = a.unionByName(b, allowMissingColumns=True)
    bucket = bucket_of(both.select("by__", "t__")) if bucket is None else bucket
    both = both.withColumn("b__", F.floor(F.col("t__") / bucket))
    # across buckets: the last hit of all earlier ones, from a row for each (clip, bucket)
    before = Window.partitionBy("by__").orderBy("b__").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("by__", "b__").agg(F.max("hit__").alias("last__")).withColumn("carry__", F.last("last__", ignorenulls=True).over(before)).drop("last__")
    here = Window.partitionBy("by__", "b__").orderBy("t__", "side__", "o__").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = both.withColumn("own__", F.last("hit__", ignorenulls=True).over(here)).where("side__ = 1")
    x, c = own.alias("x"), carried.alias("c")
    out = x.join(c, (F.col("x.by__") == F.col("c.by__")) & (F.col("x.b__") == F.col("c.b__")), "left")
    hit = F.when(F.col("x.t__").isNotNull(), F.coalesce("x.own__", "c.carry__"))
    return out.select("x.row__.*", F.struct(*(hit[k].alias(k) for k in keep)).alias(name))


def neighbours(events: DataFrame, bucket: float | None = None) -> DataFrame:
    """Focal events with next_start (nonfocal, at or after the end) and prev_end (nonfocal, at or before the start)."""
    bucket = bucket_of(events, "clip", "start_s") if bucket is None else bucket
    focal, other = events.where("focal"), events.where("not focal").select("clip", "call_id", "start_s", "end_s")
    out = asof(focal, other, "end_s", "start_s", ["start_s"], True, bucket=bucket, name="n")
    out = asof(out.select(*focal.columns, F.col("n.start_s").alias("next_start")), other, "start_s", "end_s", ["end_s"], False, bucket=bucket, name="p")
    return out.select(*focal.columns, "next_start", F.col("p.end_s").alias("prev_end"))


def outcomes(near: DataFrame, windows: Sequence[float], span: float) -> DataFrame:
    """A row for each event and window: censoring at the clip's ends, and whether a neighbour lies within the window.

    A censored outcome is false, and eligibility leaves it out.
    """
    t = near.withColumn("tau", F.explode(F.array(*(F.lit(float(w)) for w in windows))))
    t = t.withColumn("post_censored", F.col("end_s") > F.lit(float(span)) - F.col("tau")).withColumn("pre_censored", F.col("start_s") < F.col("tau"))
    post = F.coalesce(F.col("next_start") - F.col("end_s") <= F.col("tau"), F.lit(False)) & ~F.col("post_censored")
    pre = F.coalesce(F.col("start_s") - F.col("prev_end") <= F.col("tau"), F.lit(False)) & ~F.col("pre_censored")
    return t.withColumn("nf_post", post).withColumn("nf_pre", pre)


def rates(outcome: DataFrame) -> DataFrame:
    """By label and window: rows, censored rows, eligible rows, positives and rates on both sides, and their difference."""
    n = lambda c: F.count_if(c)
    g = outcome.groupBy("label", "tau").agg(
        F.count("*").alias("n"),
        n(F.col("post_censored")).alias("post_censored_n"), n(F.col("pre_censored")).alias("pre_censored_n"),
        n(F.col("nf_post")).alias("post_n"), n(F.col("nf_pre")).alias("pre_n"),
    )
    g = g.withColumn("post_rate", ratio(F.col("post_n"), F.col("n") - F.col("post_censored_n"))).withColumn("pre_rate", ratio(F.col("pre_n"), F.col("n") - F.col("pre_censored_n")))
    return g.withColumn("post_minus_pre", F.col("post_rate") - F.col("pre_rate"))


def range_pairs(left: DataFrame, right: DataFrame, low: Column, high: Column, at_low: Column, at_high: Column, bucket: float, by: str = "clip") -> DataFrame:
    """Pairs (l, r) of one clip whose closed ranges meet; each pair comes once.

    Both sides are put in every bucket that their range touches; a pair counts
    in the bucket where its common part begins.
    """
    buckets = lambda a, b: F.explode(F.sequence(F.floor(a / bucket), F.floor(b / bucket)))
    a = left.select(F.struct(*left.columns).alias("l"), F.col(by).alias("by__"), low.alias("a0"), high.alias("a1")).where("a0 <= a1").withColumn("b__", buckets(F.col("a0"), F.col("a1")))
    b = right.select(F.struct(*right.columns).alias("r"), F.col(by).alias("by__"), at_low.alias("b0"), at_high.alias("b1")).where("b0 <= b1").withColumn("b__", buckets(F.col("b0"), F.col("b1")))
    meets = (F.col("a0") <= F.col("b1")) & (F.col("b0") <= F.col("a1")) & (F.floor(F.greatest("a0", "b0") / bucket) == F.col("b__"))
    return a.join(b, ["by__", "b__"]).where(meets).select("l", "r")


def running_sums(rows: DataFrame, by: Sequence[str], columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds to each row {c}_own, the sum of c over its bucket b__ up to the row, and {c}_before, that of all earlier buckets.

    ``order`` sorts a bucket's rows. The earlier buckets come from a table with one row a bucket.
    """
    key = [*by, "b__"]
    before = Window.partitionBy(*by).orderBy("b__").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*key).agg(*(F.sum(c).alias(c) for c in columns))
    totals = totals.select(*(F.col(c).alias(f"{c}_k") for c in key), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in columns))
    here = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.withColumns({f"{c}_own": F.sum(c).over(here) for c in columns})
    on = F.lit(True)
    for c in key:
        on = on & (F.col(c) == F.col(f"{c}_k"))
    return own.join(totals, on).drop(*(f"{c}_k" for c in key))


#: Kinds of events (label and focal) that :func:`history` counts in columns of their own, at most.
KINDS = 500


def history(base: DataFrame, every: DataFrame, windows: Sequence[float], bucket: float | None = None) -> DataFrame:
    """(call_id, tau, side, all_n, focal_n, nonfocal_n, same_label_n, labels_n): what ends in [start - tau, start], or starts in [end, end + tau].

    Bounds are inclusive, so an event of no length counts itself. No pairs are made: a
    count over a range is a difference of two running counts, one for each kind of event,
    read at the range's two bounds; the work is that of sorting the bounds.
    """
    kinds = [tuple(r) for r in every.select("label", "focal").distinct().limit(KINDS + 1).collect()]
    if len(kinds) > KINDS:
        raise ValueError(f"more than {KINDS} kinds of events")
    kinds = sorted(kinds, key=repr)
    columns = [f"k{k}__" for k in range(len(kinds))]
    taus = F.array(*(F.lit(float(w)) for w in windows))
    own = base.select("clip", "call_id", "label", "start_s", "end_s")
    frame = own.select("call_id", "label", F.explode(taus).alias("tau")).withColumn("side", F.explode(F.array(F.lit("pre"), F.lit("post"))))
    if not kinds:
        return frame.select("call_id", "tau", "side", *(F.lit(0).cast("long").alias(c) for c in ("all_n", "focal_n", "nonfocal_n", "same_label_n", "labels_n")))
    # of rows at one time, lower bounds come before points and upper bounds after them
    is_kind = {c: (F.col("label").eqNullSafe(F.lit(x)) & F.col("focal").eqNullSafe(F.lit(f))).cast("long") for c, (x, f) in zip(columns, kinds, strict=True)}
    at = F.explode(F.array(F.struct(F.lit("pre").alias("side"), F.col("end_s").alias("t__")), F.struct(F.lit("post").alias("side"), F.col("start_s").alias("t__")))).alias("x")
    points = every.where("start_s <= end_s").select("clip", at, *(x.alias(c) for c, x in is_kind.items())).select("clip", "x.*", F.lit(1).alias("o__"), *columns)
    bound = lambda side, t, o, tau, sign: F.struct(F.lit(side).alias("side"), t.alias("t__"), F.lit(o).alias("o__"), F.array(*(F.lit(float(w)) for w in tau)).alias("taus"), F.lit(sign).alias("sign"))
    s, e = F.col("start_s"), F.col("end_s")
    bounds = [bound("pre", s, 2, windows, 1), bound("post", e, 0, windows, -1)]
    bounds += [x for w in windows for x in (bound("pre", s - float(w), 0, [w], -1), bound("post", e + float(w), 2, [w], 1))]
    probes = own.select("clip", "call_id", F.explode(F.array(*bounds)).alias("x")).select("clip", "call_id", "x.*", *(F.lit(0).cast("long").alias(c) for c in columns))
    rows = points.unionByName(probes, allowMissingColumns=True).where("clip is not null and t__ is not null").withColumnRenamed("clip", "by__")
    bucket = bucket_of(rows) if bucket is None else bucket
    rows = running_sums(rows.withColumn("b__", F.floor(F.col("t__") / bucket)), ["by__", "side"], columns, ["t__", "o__"])
    read = rows.where("call_id is not null and sign is not null").withColumn("tau", F.explode("taus"))
    found = read.groupBy("call_id", "tau", "side").agg(*(F.sum(F.col("sign") * (F.col(f"{c}_own") + F.col(f"{c}_before"))).alias(c) for c in columns))
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in columns}
    total = lambda keep: sum((n[c] for c, k in zip(columns, kinds, strict=True) if keep(k)), F.lit(0)).cast("long")
    labels = sorted({x for x, _ in kinds if x is not None}, key=repr)
    of_label = {x: total(lambda k, x=x: k[0] == x) for x in labels}
    same = sum((F.when(F.col("label") == F.lit(x), c).otherwise(0) for x, c in of_label.items()), F.lit(0)).cast("long")
    some = sum(((c > 0).cast("long") for c in of_label.values()), F.lit(0)).cast("long")
    counts = {"all_n": total(lambda k: True), "focal_n": total(lambda k: k[1] is True), "nonfocal_n": total(lambda k: k[1] is False), "same_label_n": same, "labels_n": some}
    return frame.join(found, ["call_id", "tau", "side"], "left").select("call_id", "tau", "side", *(c.alias(x) for x, c in counts.items()))


def overlap_shares(focal: DataFrame, every: DataFrame, bucket: float | None = None) -> DataFrame:
    """(call_id, n_overlaps, overlap_fraction, nonfocal_fraction): how much of an event others of its clip cover.

    Strict overlap, without the event itself (ids tell events apart); the covered length is
    that of the intervals' union, clipped to the event. No pairs are made: of all events
    of a clip those that overlap one are its starts before the end less its ends up to the
    start, and what is covered is the time for which the depth of intervals, a running sum
    over all bounds, is at least 1, or 2 where the event itself is among them.
    """
    own = focal.select("clip", "call_id", "start_s", "end_s").where("clip is not null and start_s <= end_s")
    fine = every.select("clip", "call_id", "start_s", "end_s", "focal").where("clip is not null and start_s <= end_s")
    itself = fine.select("call_id", F.lit(1).alias("in__"), F.coalesce(~F.col("focal"), F.lit(False)).cast("int").alias("other__"))
    own = own.join(itself, "call_id", "left").fillna(0, ["in__", "other__"])
    other, point = F.coalesce(~F.col("focal"), F.lit(False)).cast("long"), F.col("start_s") == F.col("end_s")
    mark = lambda t, o, depth, begun=0, ended=0: F.struct(t.alias("t__"), o.alias("o__"), F.lit(depth).alias("depth"), (other * depth).alias("others"), F.lit(begun).alias("begun"), F.lit(ended).alias("ended"))
    order = ["t__", "o__", "u__"]  # the same in all windows, as each row's depth lasts to the next one
    # at one time: upper bounds, ends, lower bounds of points, ends of points, lower bounds, starts
    bounds = F.array(mark(F.col("start_s"), F.lit(5), 1, begun=1), mark(F.col("end_s"), F.when(point, 3).otherwise(1), -1, ended=1))
    marks = fine.select("clip", F.col("call_id").alias("u__"), F.explode(bounds).alias("x")).select("clip", "u__", "x.*")
    ask = F.array(F.struct(F.col("start_s").alias("t__"), F.when(point, 2).otherwise(4).alias("o__"), F.lit(-1).alias("sign")), F.struct(F.col("end_s").alias("t__"), F.lit(0).alias("o__"), F.lit(1).alias("sign")))
    probes = own.select("clip", "call_id", "in__", "other__", F.explode(ask).alias("x")).select("clip", "call_id", F.col("call_id").alias("u__"), "in__", "other__", "x.*", *(F.lit(0).alias(c) for c in ("depth", "others", "begun", "ended")))
    rows = marks.unionByName(probes, allowMissingColumns=True).withColumnRenamed("clip", "by__")
    bucket = bucket_of(rows) if bucket is None else bucket
    rows = running_sums(rows.withColumn("b__", F.floor(F.col("t__") / bucket)), ["by__"], ["depth", "others", "begun", "ended"], order)
    rows = rows.select("by__", "b__", *order, "call_id", "in__", "other__", "sign", *((F.col(f"{c}_own") + F.col(f"{c}_before")).alias(c) for c in ("depth", "others", "begun", "ended")))
    # a row's depth lasts to the next row, which may lie in a later bucket
    firsts = rows.groupBy("by__", "b__").agg(F.min("t__").alias("first__")).withColumn("later__", F.lead("first__").over(Window.partitionBy("by__").orderBy("b__")))
    firsts = firsts.select(F.col("by__").alias("by_f"), F.col("b__").alias("b_f"), "later__")
    to = F.lead("t__").over(Window.partitionBy("by__", "b__").orderBy(*order))
    rows = rows.withColumn("to__", to).join(firsts, (F.col("by__") == F.col("by_f")) & (F.col("b__") == F.col("b_f"))).drop("by_f", "b_f")
    length = F.coalesce(F.coalesce("to__", "later__") - F.col("t__"), F.lit(0.0))
    deep = {f"{c}{n}": F.when(F.col(c) >= n, length).otherwise(0.0) for c in ("depth", "others") for n in (1, 2)}
    rows = rows.withColumns({f"{k}__": x for k, x in deep.items()})
    sums = running_sums(rows, ["by__"], [f"{k}__" for k in deep], order).where("sign is not null")
    # up to a row, without what follows it
    part = lambda k, end: F.sum(F.col("sign") * (F.col(f"{k}___{end}") - (F.col(f"{k}__") if end == "own" else F.lit(0.0))))
    covered = lambda c, self: F.when(F.max(self) > 0, part(f"{c}2", "own") + part(f"{c}2", "before")).otherwise(part(f"{c}1", "own") + part(f"{c}1", "before"))
    g = sums.groupBy("call_id").agg(
        (F.sum(F.when(F.col("sign") > 0, F.col("begun")).otherwise(-F.col("ended")))).alias("n"), F.max("in__").alias("in__"),
        covered("depth", "in__").alias("covered"), covered("others", "other__").alias("other_covered"),
    )
    out = focal.select("call_id", "start_s", "end_s").join(g, "call_id", "left")
    n = F.coalesce(F.col("n") - F.when(F.col("start_s") < F.col("end_s"), F.col("in__")).otherwise(0), F.lit(0)).cast("long")
    share = lambda c: F.coalesce(F.least(F.greatest(ratio(F.col(c), F.col("end_s") - F.col("start_s")), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return out.select("call_id", n.alias("n_overlaps"), share("covered").alias("overlap_fraction"), share("other_covered").alias("nonfocal_fraction"))


def union_length(spans: DataFrame, by: str = "clip", bucket: float = BUCKET) -> DataFrame:
    """(by, covered): the length of the union of each group's intervals; intervals are cut at bucket bounds."""
    t = spans.where("start_s <= end_s").withColumn("b__", F.explode(F.sequence(F.floor(F.col("start_s") / bucket), F.floor(F.col("end_s") / bucket))))
    t = t.select(by, "b__", F.greatest("start_s", F.col("b__") * bucket).alias("a"), F.least("end_s", (F.col("b__") + 1) * bucket).alias("b"))
    reach = F.max("b").over(Window.partitionBy(by, "b__").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    gain = F.greatest(F.lit(0.0), F.col("b") - F.greatest("a", F.coalesce(reach, F.col("a"))))
    return t.withColumn("gain", gain).groupBy(by).agg(F.sum("gain").alias("covered"))


def mapped(segments: DataFrame, annotations: DataFrame, least: float = 0.5, floor: float = 1e-9, bucket: float = BUCKET) -> DataFrame:
    """(call_id, n_hits, status, best_id, best_overlap): each segment's annotation in the same clip.

    A hit overlaps at least ``least`` of the segment or holds its centre.
    ``unique`` reports the one hit, ``multiple`` the largest overlap of all
    candidates (the smallest id of equals), ``zero`` none. Segments of clips
    without annotations are left out.
    """
    noted = annotations.select("clip").distinct()
    own = segments.join(noted, "clip", "left_semi").select("clip", "call_id", "start_s", "end_s")
    notes = annotations.select("clip", F.col("call_id").alias("note_id"), "start_s", "end_s")
    p = range_pairs(own, notes, F.col("start_s"), F.col("end_s"), F.col("start_s"), F.col("end_s"), bucket)
    length = F.greatest(F.col("l.end_s") - F.col("l.start_s"), F.lit(floor))
    part = F.greatest(F.lit(0.0), F.least("l.end_s", "r.end_s") - F.greatest("l.start_s", "r.start_s")) / length
    middle = (F.col("l.start_s") + F.col("l.end_s")) / 2
    p = p.select("l.call_id", "r.note_id", part.alias("part"), ((part >= least) | ((middle >= F.col("r.start_s")) & (middle <= F.col("r.end_s")))).alias("hit"))
    g = p.groupBy("call_id").agg(F.count_if("hit").alias("n_hits"), F.max(F.struct("part", (-F.col("note_id")).alias("m"))).alias("top"), F.max(F.when(F.col("hit"), F.struct("part", (-F.col("note_id")).alias("m")))).alias("only"))
    out = own.select("call_id").join(g, "call_id", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)).cast("long"))
    status = F.when(F.col("n_hits") == 0, "zero").when(F.col("n_hits") == 1, "unique").otherwise("multiple")
    best = F.when(F.col("n_hits") == 1, F.col("only")).when(F.col("n_hits") > 1, F.col("top"))
    return out.select("call_id", "n_hits", status.alias("status"), (-best["m"]).alias("best_id"), F.coalesce(best["part"], F.lit(0.0)).alias("best_overlap"))


def edges(events: DataFrame, carry: Sequence[str], bucket: float | None = None) -> DataFrame:
    """(clip, call_i, call_j, delta_s, and x_i, x_j of ``carry``): each event and the next of its clip by start, end and id.

    The next event of a bucket's last one is the first event of a later bucket.
    """
    order = ["start_s", "end_s", "call_id"]
    own = F.struct(*order, *(c for c in carry))
    bucket = bucket_of(events, "clip", "start_s") if bucket is None else bucket
    t = events.withColumn("b__", F.floor(F.col("start_s") / bucket)).withColumn("own__", own)
    later = Window.partitionBy("clip").orderBy("b__")
    firsts = t.groupBy("clip", "b__").agg(F.min("own__").alias("first__")).withColumn("after__", F.lead("first__").over(later)).select("clip", "b__", "after__")
    here = F.lead("own__").over(Window.partitionBy("clip", "b__").orderBy(*order))
    j = t.withColumn("next__", here).join(firsts, ["clip", "b__"]).withColumn("j", F.coalesce("next__", "after__")).where("j is not null")
    return j.select("clip", F.col("call_id").alias("call_i"), F.col("j.call_id").alias("call_j"), (F.col("j.start_s") - F.col("end_s")).alias("delta_s"), *(x for c in carry for x in (F.col(c).alias(f"{c}_i"), F.col(f"j.{c}").alias(f"{c}_j"))))


def gaps(events: DataFrame, bucket: float | None = None) -> DataFrame:
    """Focal events with the gap to the next event of any kind that starts at or after their end, and whether it has their label."""
    other = events.select("clip", "call_id", "start_s", F.col("label").alias("next_label"))
    out = asof(events.where("focal"), other, "end_s", "start_s", ["start_s", "next_label"], True, bucket=bucket, name="n")
    return out.select("call_id", (F.col("n.start_s") - F.col("end_s")).alias("gap_s"), F.coalesce(F.col("n.next_label") == F.col("label"), F.lit(False)).alias("same_label"))
