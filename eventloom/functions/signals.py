"""Arrays of samples as column expressions: levels, scaling, windows that look at no future sample, pooling of frames.

All are higher-order functions inside generated code or the JVM's interpreter;
none needs a Python worker. A null array gives null, an empty one gives null
levels and an empty scaled array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this level a signal counts as silent (fixed value).
SILENT = 1e-10
#: Parts of a window that may be looked at (fixed names).
MODES = ("call_only", "past_context", "context_only")


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of x, with x worked out once: inside the lambda of another array it would be worked out for each sample."""
    return F.transform(F.array(x), use)[0]


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def mean(x: Column) -> Column:
    return F.when(F.size(x) > 0, total(x) / F.size(x))


def finite(x: Column) -> Column:
    """The array without null, NaN and infinite values."""
    return F.filter(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def rms(x: Column) -> Column:
    return F.sqrt(mean(F.transform(x, lambda v: v * v)))


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def clipped(x: Column, at: float = 0.999) -> Column:
    """The share of samples at full scale."""
    return mean(F.transform(x, lambda v: (F.abs(v) >= at).cast("double")))


def levels(x: Column, at: float = 0.999) -> Column:
    """(rms, peak, crest, clipped); no crest for silence."""
    r, p = rms(x), peak(x)
    return F.struct(r.alias("rms"), p.alias("peak"), F.when(r > SILENT, p / r).alias("crest"), clipped(x, at).alias("clipped"))


def stats(x: Column) -> Column:
    """(mean, sd, least, most) over finite values, with the population sd; all null if there is none."""

    def about(f: Column, m: Column) -> Column:
        return F.struct(m.alias("mean"), F.sqrt(mean(F.transform(f, lambda v: (v - m) * (v - m)))).alias("sd"), F.array_min(f).alias("least"), F.array_max(f).alias("most"))

    return bound(finite(x), lambda f: bound(mean(f), lambda m: about(f, m)))


def levelled(x: Column, dbfs: float = -25.0, most: float = 0.99) -> Column:
    """(samples, gain_db, limited): at the wanted level, or at less where the peak would pass ``most``; silence stays."""
    want = F.lit(10.0 ** (dbfs / 20.0))

    def plan(l: Column) -> Column:
        sound = F.coalesce(l["r"] > SILENT, F.lit(False))
        limited = sound & (l["p"] * want > most * l["r"])
        gain = F.when(limited, most / F.greatest(l["p"], F.lit(SILENT))).when(sound, want / l["r"])
        return F.struct(gain.alias("gain"), limited.alias("limited"))

    def put(g: Column) -> Column:
        scaled = F.transform(x, lambda v: v * F.coalesce(g["gain"], F.lit(1.0)))
        return F.struct(scaled.alias("samples"), F.when(g["gain"].isNull(), 0.0).otherwise(20 * F.log10(F.greatest(g["gain"], F.lit(SILENT)))).alias("gain_db"), g["limited"].alias("limited"))

    return bound(F.struct(rms(x).alias("r"), peak(x).alias("p")), lambda l: bound(plan(l), put))


def standard(x: Column) -> Column:
    """Samples less their mean, over their population sd; zeros where that is none."""
    return bound(stats(x), lambda s: F.transform(x, lambda v: F.when(s["sd"] > SILENT, (v - s["mean"]) / s["sd"]).otherwise(0.0)))


def spectral_entropy(power: Column) -> Column:
    """Of a power spectrum, in bits, over the most that so many bins can have; null without power."""
    bits = lambda t: F.aggregate(power, F.lit(0.0), lambda s, v: s - v / t * F.log2(v / t + SILENT))
    return bound(total(power), lambda t: F.when(t > SILENT, bits(t) / F.log2(F.greatest(F.size(power), F.lit(2)).cast("double"))))


def whole(x: Column) -> Column:
    """The nearest whole number; halves go to the even one."""
    return F.rint(x).cast("long")


def support_plan(start_s: Column, end_s: Column, rate: Column, samples: Column, least_ms: float = 500.0) -> Column:
    """Which samples a window that ends with the call may read: none after it.

    Short calls get earlier samples until the window has ``least_ms``, and zeros
    where the recording has not begun. Null where the call does not lie
    within the recording: a call is never cut.
    """
    a, b = whole(start_s * rate), whole(end_s * rate)
    first = F.least(a, b - whole(F.lit(least_ms) * rate / 1000.0))
    zero = F.lit(0).cast("long")
    plan = F.struct(
        first.alias("window_start"), b.alias("window_end"), F.greatest(zero, first).alias("source_start"), b.alias("source_end"),
        F.greatest(zero, -first).alias("left_pad"), (b - first).alias("n_samples"), (a - first).alias("focal_start"), (b - first).alias("focal_end"),
    )
    return F.when((a >= 0) & (a < b) & (b <= samples), plan)


def centred_leak(start_s: Column, end_s: Column, rate: Column, samples: Column, width_ms: float = 500.0) -> Column:
    """(future_ms, truncates): what a window of fixed width about the call's middle reads after the call, and whether it cuts the call."""
    a, b, width = whole(start_s * rate), whole(end_s * rate), whole(F.lit(width_ms) * rate / 1000.0)
    first = F.floor((a + b) / 2).cast("long") - F.floor(width / 2).cast("long")
    after = F.greatest(F.lit(0).cast("long"), F.least(first + width, samples) - b)
    return F.struct((after * 1000.0 / rate).alias("future_ms"), ((first > a) | (first + width < b)).alias("truncates"))


def read_window(x: Column, plan: Column) -> Column:
    """The samples of a plan, zeros first where the recording has not begun."""
    part = F.slice(x, (plan["source_start"] + 1).cast("int"), (plan["source_end"] - plan["source_start"]).cast("int"))
    return F.concat(F.array_repeat(F.lit(0.0), plan["left_pad"].cast("int")), part)


def masked_standard(window: Column, plan: Column, mode: str) -> Column:
    """(samples, informative, masked): the allowed part of a window scaled by its own mean and sd; all else is exactly zero."""
    if mode not in MODES:
        raise ValueError(mode)

    def allowed(k: Column) -> Column:
        focal = (k >= plan["focal_start"]) & (k < plan["focal_end"])
        if mode == "call_only":
            return focal
        late = k >= plan["left_pad"]
        return late & ~focal if mode == "context_only" else late

    def put(s: Column) -> Column:
        told = F.coalesce(s["sd"] > 1e-8, F.lit(False))
        masked = mean(F.transform(window, lambda v, k: F.when(allowed(k), 0.0).otherwise(1.0)))
        return F.struct(F.transform(window, lambda v, k: F.when(told & allowed(k), (v - s["mean"]) / s["sd"]).otherwise(0.0)).alias("samples"), told.alias("informative"), masked.alias("masked"))

    return bound(stats(F.filter(window, lambda v, k: allowed(k))), put)


def focal_frames(focal_start: Column, focal_end: Column, samples: Column, frames: Column) -> Column:
    """(first, last): the frames [first, last) that lie, in proportion, over the call; at least one."""
    n = F.greatest(samples, F.lit(1))
    first = F.greatest(F.lit(0), F.least(frames - 1, F.floor(focal_start / n * frames).cast("int")))
    last = F.greatest(first + 1, F.least(frames, F.ceil(focal_end / n * frames).cast("int")))
    return F.struct(first.alias("first"), last.alias("last"))


def pooled(frames: Column, span: Column, how: str = "mean") -> Column:
    """One vector from the frames of a span: their mean, or each dimension's largest value."""
    if how not in ("mean", "max"):
        raise ValueError(how)
    part = F.slice(frames, span["first"] + 1, span["last"] - span["first"])
    join = (lambda s, v: F.zip_with(s, v, lambda a, b: a + b)) if how == "mean" else (lambda s, v: F.zip_with(s, v, lambda a, b: F.greatest(a, b)))
    every = F.aggregate(F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0))), F.element_at(part, 1), join)
    return bound(F.size(part), lambda n: F.transform(every, lambda a: a / n)) if how == "mean" else every


def segment(x: Column, start_s: Column, end_s: Column, rate: Column, margin_s: Column) -> Column:
    """(first, last, segment, context): samples from the rounded start up to the rounded end, and those within a margin before and after."""
    n = F.size(x).cast("long")
    first = F.least(n, F.greatest(F.lit(0).cast("long"), whole(start_s * rate)))
    last = F.greatest(first, F.least(n, whole(end_s * rate)))
    margin = whole(margin_s * rate)
    cut = lambda a, b: F.slice(x, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    before, after = F.greatest(F.lit(0), first - margin), F.least(n, last + margin)
    return F.struct(first.alias("first"), last.alias("last"), cut(first, last).alias("segment"), F.concat(cut(before, first), cut(last, after)).alias("context"))


def context_window(x: Column, first: Column, last: Column, samples: int, anchor: str = "centre") -> Column:
    """(left_pad, right_pad, samples): a window about the middle of [first, last), or from its first sample on, zeros where there is no signal."""
    if anchor not in ("centre", "start"):
        raise ValueError(anchor)
    n, zero = F.size(x).cast("long"), F.lit(0).cast("long")
    a = first.cast("long") if anchor == "start" else F.floor((first + last) / 2) - samples // 2
    left, right = F.least(F.greatest(zero, -a), F.lit(samples)), F.least(F.greatest(zero, a + samples - n), F.lit(samples))
    at, to = F.least(n, F.greatest(zero, a)), F.greatest(zero, F.least(n, a + samples))
    held = F.slice(x, (at + 1).cast("int"), F.greatest(to - at, zero).cast("int"))
    pad = lambda k: F.array_repeat(F.lit(0.0), k.cast("int"))
    return F.struct(left.alias("left_pad"), right.alias("right_pad"), F.concat(pad(left), held, pad(right)).alias("samples"))
