"""Column expressions: tolerant casts, identifiers, losses, bins. All stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The three sets of strings that count as true (fixed values).
TRUE_WIDE = ("true", "1", "yes", "y", "t")
TRUE_YES = ("true", "1", "yes")
TRUE_SHORT = ("true", "1")


def number(x: Column) -> Column:
    """A double; null for what is no number, NaN or infinite."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def truth(x: Column, names: Sequence[str] = TRUE_WIDE) -> Column:
    """True for one of ``names`` in any case; false for all else, null too."""
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin(*names), F.lit(False))


def clean_id(x: Column) -> Column:
    """Numbers as whole numbers without a fraction, other values as they are, null as an empty string."""
    d = x.cast("string").try_cast("double")
    return F.coalesce(d.try_cast("bigint").cast("string"), x.cast("string"), F.lit(""))


def unsigned_id(x: Column) -> Column:
    """An identifier without its sign."""
    return F.regexp_replace(clean_id(x), "^-+", "")


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def log_loss(y: Column, p: Column, floor: float = 1e-15) -> Column:
    q = F.least(F.greatest(p, F.lit(floor)), F.lit(1 - floor))
    return -y.cast("double") * F.log(q) - (1 - y.cast("double")) * F.log1p(-q)


def brier(y: Column, p: Column) -> Column:
    return (p - y.cast("double")) * (p - y.cast("double"))


def binned(x: Column, edges: Sequence[float]) -> Column:
    """The number of the bin [edge, next edge); the last edge belongs to the last bin, what is outside is null."""
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 1):
        last = k == len(edges) - 2
        out = F.when((x >= edges[k]) & ((x <= edges[k + 1]) if last else (x < edges[k + 1])), F.lit(k)).otherwise(out)
    return out


def decibels(x: Column, floor: float = 1e-10) -> Column:
    return 20 * F.log10(F.greatest(x, F.lit(floor)))


def same_pair(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Do {a, b} and {c, d} hold the same two names? False if one is blank."""
    named = F.array(a, b, c, d)
    whole = F.forall(named, lambda x: F.coalesce(x, F.lit("")) != "")
    return whole & (F.array_sort(F.array(a, b)) == F.array_sort(F.array(c, d)))


def entropy(p: Column) -> Column:
    """Of an array of shares, in nats."""
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - x * F.log(F.greatest(x, F.lit(1e-12))))


def seeded(seed: int, *on: Column) -> Column:
    """An order that looks random and that any engine can repeat: SHA-256 of the seed and the key."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(c.cast("string") for c in on)), 256)


def window_shape(n: Column) -> Column:
    """(n_fft, hop, n_mels) for a segment of n samples."""
    power = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(n, F.lit(64)).cast("double")))).cast("int")
    n_fft = F.least(F.greatest(power, F.lit(64)), F.lit(512))
    hop = F.greatest(F.lit(16), F.floor(n_fft / 4).cast("int"))
    return F.struct(n_fft.alias("n_fft"), hop.alias("hop"), F.least(F.greatest(F.floor(n_fft / 4).cast("int"), F.lit(8)), F.lit(32)).alias("n_mels"))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """(low, high): Wilson's interval for k of n; null without n."""
    p, m = ratio(k, n), n.cast("double")
    middle, half = p + F.try_divide(F.lit(z * z), 2 * m), z * F.sqrt(F.try_divide(p * (1 - p), m) + F.try_divide(F.lit(z * z), 4 * m * m))
    scale = 1 + F.try_divide(F.lit(z * z), m)
    return F.struct(((middle - half) / scale).alias("low"), ((middle + half) / scale).alias("high"))
