"""URL filtering against dated lists: a temporal join.

List entries say from when a key is blocked, allowed or lifted (no longer
listed). Each key's entries become validity intervals, from an entry to the
next one of its key. A capture is looked up under all keys that cover its URL
(the host and its parent domains, and the host with each leading part of the
path), as of its fetch time; the longest key that is listed then decides. Keys are made only in the shapes (number
of labels, depth of path) that the list's keys have, so that a long URL has few.

The join is by key and salt, with the interval as a range condition; a key has
at most one interval at a time, so a capture gets at most one row a key. The
salt spreads a key with very many captures over SALTS tasks.

Values: a null URL, or one without a host, matches nothing and is kept; a null
fetch time matches nothing; entries with a null key or date are void; of
entries with one key and date the one whose action comes last by name counts,
and repeated entries count once. Repeated captures are kept as they are. Extra
columns go through; the added columns replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, ALLOW, LIFT = "block", "allow", "lift"
SALTS = 16


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and a last dot (an IPv6 address with its brackets); empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)", 1)), r"\.$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def shape(entries: DataFrame) -> tuple[list[int], list[int]]:
    """(numbers of labels, numbers of path segments) that the list's keys have: only keys of such a shape can match."""
    host, slashes = F.split_part("key", F.lit("/"), F.lit(1)), F.regexp_count("key", F.lit("/"))
    labels = F.size(F.split(host, r"\.", -1))
    found = entries.where("key is not null").agg(F.collect_set(F.when(slashes == 0, labels)).alias("labels"), F.collect_set(F.when(slashes > 0, slashes)).alias("depths")).first()
    return sorted(found.labels), sorted(found.depths)


def lookup_keys(url: Column, labels_of_keys: list[int], depths: list[int]) -> Column:
    """The keys of the given shapes that cover a URL: ``a.b.org``, ``b.org`` and ``a.b.org/x``, ``a.b.org/x/y``, ..."""
    host = host_of(url)
    labels = F.split(host, r"\.", -1)
    steps = F.filter(F.split(path_of(url), "/", -1), lambda s: s != "")
    keys = []
    for n in labels_of_keys:  # a last label alone covers only a host of one label
        fits = (F.size(labels) == 1) if n == 1 else (F.size(labels) >= n)
        keys.append(F.when(fits & (host != ""), F.array_join(F.slice(labels, F.greatest(F.size(labels) - (n - 1), F.lit(1)), n), ".")))
    for n in depths:
        keys.append(F.when((F.size(steps) >= n) & (host != ""), F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, n), "/"))))
    return F.array_distinct(F.array_compact(F.array(*keys))) if keys else F.array().cast("array<string>")


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, since, until) from dated entries (key, action, dated); ``until`` is null for what still holds."""
    one = entries.where("key is not null and dated is not null").groupBy("key", "dated").agg(F.max("action").alias("action"))
    until = F.lead("dated").over(Window.partitionBy("key").orderBy("dated"))
    held = one.withColumn("until", until).where(F.col("action") != LIFT)
    return held.select("key", "action", F.col("dated").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at", salts: int = SALTS) -> DataFrame:
    """Adds list_key, list_action, listed_since and blocked, as of each capture's fetch time."""
    kept = [c for c in captures.columns if c.lower() not in ("list_key", "list_action", "listed_since", "blocked")]
    looked = captures.select(F.col(url).alias("u"), F.col(fetched).alias("t")).where("u is not null and t is not null").distinct()
    keyed = looked.withColumn("salt", F.pmod(F.xxhash64("u", "t"), F.lit(salts))).withColumn("key", F.explode(lookup_keys(F.col("u"), *shape(entries))))
    listed = intervals(entries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("salt", F.col("salt").cast("long"))
    held = (F.col("t") >= F.col("since")) & (F.col("until").isNull() | (F.col("t") < F.col("until")))
    hits = keyed.join(listed, ["key", "salt"]).where(held)
    best = hits.groupBy("u", "t").agg(F.max(F.struct(F.length("key").alias("n"), "key", "action", "since")).alias("x"))
    best = best.select("u", "t", F.col("x.key").alias("list_key"), F.col("x.action").alias("list_action"), F.col("x.since").alias("listed_since"))
    a, b = captures.alias("a"), best.alias("b")
    out = a.join(b, (F.col(f"a.`{url}`") == F.col("b.u")) & (F.col(f"a.`{fetched}`") == F.col("b.t")), "left")
    return out.select(*(F.col(f"a.`{c}`") for c in kept), "b.list_key", "b.list_action", "b.listed_since", F.coalesce(F.col("b.list_action") == BLOCK, F.lit(False)).alias("blocked"))
