"""Queries on recordings: vectors of ``embeddings`` are written as PCM files, 64 to a file, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signals
from ..operators import spectra
from ..sources import shared, sound
from ..sources import tables as T
from .common import VE, register
from .event_queries import six

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)
RATE, TOGETHER = 8000, 64

#: What the files hold, as SQL sees it: every second recording has a second channel at half the level.
PCM = f"""{VE}, s0 AS (SELECT id, id // 64 AS rec, v, sum(len(v)) OVER (PARTITION BY id // 64 ORDER BY id) - len(v) AS pos FROM ve),
s1 AS (SELECT id, rec, pos, unnest(v) AS x, unnest(range(len(v))) AS i FROM s0),
s2 AS (SELECT id, rec, pos + i AS p, greatest(-32768, least(32767, round_even(x * 32768, 0))) / 32768 AS a, greatest(-32768, least(32767, round_even(x / 2 * 32768, 0))) / 32768 AS b FROM s1),
pcm AS (SELECT id, rec, p, CASE WHEN rec % 2 = 0 THEN a ELSE (a + b) / 2 END AS y FROM s2)"""


def _recordings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(rec, name, path) of the files, and (id, label, rec, at, n): where in its file each vector lies."""
    v = T.vectors(spark, d).withColumn("rec", F.floor(F.col("id") / TOGETHER))
    g = v.groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("id", "label", "v"))).alias("g")).withColumn("channels", 1 + F.col("rec") % 2)
    x = F.flatten(F.transform("g", lambda r: r["v"]))
    both = F.flatten(F.transform(x, lambda s: F.array(s, s / 2)))
    folder = shared.new_folder(spark, "pcm")
    files = g.select("rec", "channels", F.concat(F.lit("rec-"), "rec", F.lit(".wav")).alias("name"), F.when(F.col("channels") == 1, x).otherwise(both).alias("samples"))
    done = sound.pcm(files, folder, "name", "samples", RATE)
    n = F.transform("g", lambda r: F.size(r["v"]).cast("long"))
    places = g.select("rec", F.posexplode("g").alias("k", "r"), n.alias("n"))
    before = F.aggregate(F.slice("n", 1, F.col("k")), F.lit(0).cast("long"), lambda a, b: a + b)
    rec = F.regexp_extract("name", r"(\d+)", 1).cast("long")
    return done.select(rec.alias("rec"), "name", "path"), places.select("rec", "r.id", "r.label", before.alias("at"), F.element_at("n", F.col("k") + 1).alias("n"))


@query(f"WITH {PCM} SELECT rec, 1 + rec % 2 AS channels, CAST({RATE} AS BIGINT) AS rate, count(*) AS frames, round(sqrt(avg(y * y)), 6) AS rms, round(max(abs(y)), 6) AS peak FROM pcm GROUP BY rec")
def src13_recordings(spark: SparkSession, d: str) -> DataFrame:
    """Whole recordings by blocks of 1,000 frames, channels averaged: their form and levels."""
    files, _ = _recordings(spark, d)
    heads = sound.headers(files.select("rec", "path")).select("rec", "path", "channels", "frames")
    blocks = sound.windows(sound.in_blocks(heads.withColumnRenamed("frames", "held"), "held", 1000))
    return six(sound.level(blocks, ("rec", "channels", "rate")), "rms", "peak")


@query()
def src14_resampled(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's part of its recording at 5 kHz."""
    files, places = _recordings(spark, d)
    t = places.join(files, "rec").select("id", "path", (F.col("at") / RATE).alias("start_s"), ((F.col("at") + F.col("n")) / RATE).alias("end_s"))
    t = sound.resampled(t, 5000)
    return t.select("id", "rate", F.transform("samples", lambda x: F.round(x, 6) + F.lit(0.0)).alias("samples"))


@query(f"""WITH {PCM}, c AS (SELECT id, rec, CAST(pos AS BIGINT) + 4 + id % 40 AS a, CAST(pos AS BIGINT) + 14 + id % 40 AS b FROM s0), w AS (SELECT id, rec, a, b, least(a, b - 100) AS w FROM c)
SELECT w.id, b - w AS n, greatest(0, -w) AS left_pad, CAST((b - greatest(0, w)) * 2 * (1 + any_value(w.rec) % 2) AS BIGINT) AS bytes_read, round(sqrt(sum(y * y) / (b - w)), 6) AS rms
FROM w JOIN pcm ON pcm.rec = w.rec AND p >= greatest(0, w) AND p < b GROUP BY w.id, b, w""")
def src15_bounded_reads(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 100 samples that end with a call: bytes that were read, and levels; none lies after the call."""
    files, places = _recordings(spark, d)
    t = sound.headers(places.join(files.select("rec", "path"), "rec")).select("id", "path", "at", "frames")
    a = (F.col("at") + 4 + F.col("id") % 40).cast("double")
    t = sound.allowed(t.withColumn("p", signals.support_plan(a, a + 10, F.lit(1.0), F.col("frames"), 100_000.0)), "p")
    return six(t.select("id", F.size("samples").cast("long").alias("n"), "p.left_pad", "bytes_read", signals.rms(F.col("samples")).alias("rms")), "rms")


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """A manifest of each vector's part of its recording: relative paths, one in three has a duration and no end, one in fifty a file that isn't there."""
    files, places = _recordings(spark, d)
    t = places.join(files, "rec")
    start, seconds, whole = F.col("at") / RATE, F.col("n") / RATE, F.col("id") % 3 != 0
    name = F.when(F.col("id") % 50 == 9, "absent.wav").otherwise(F.col("name"))
    rows = t.select("id", "label", name.alias("WAV_path"), start.alias("onset_s"), F.when(whole, start + seconds).alias("offset_s"), F.when(~whole, seconds).alias("dur_s"))
    root = files.agg(F.min(F.regexp_extract("path", r"^(.*)/", 1))).first()[0] or ""
    return sound.manifest(rows, root)


@query(f"""WITH {PCM}, g AS (SELECT id, count(*) AS n, sqrt(avg(y * y)) AS rms FROM pcm GROUP BY id)
SELECT id, id % 50 <> 9 AS found, round(pos / {RATE}, 6) AS start_s, round((pos + len(v)) / {RATE}, 6) AS end_s, CASE WHEN id % 50 <> 9 THEN n END AS n, CASE WHEN id % 50 <> 9 THEN round(rms, 6) END AS rms FROM s0 JOIN g USING (id)""")
def src25_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Files and bounds from a manifest's columns, whatever they are called, and the level of what is read."""
    t = sound.resampled(_calls(spark, d), RATE)
    return six(t.select("id", F.col("error").isNull().alias("found"), "start_s", "end_s", F.when(F.col("samples").isNotNull(), F.size("samples").cast("long")).alias("n"), signals.rms(F.col("samples")).alias("rms")), "start_s", "end_s", "rms")


@query()
def src26_vectors_of_calls(spark: SparkSession, d: str) -> DataFrame:
    """Log-mel spectra in decibels below the loudest cell of every call in a manifest; calls without a file have their reason."""
    calls = sound.resampled(_calls(spark, d), RATE).withColumnRenamed("error", "reason")
    t = spectra.spectra(calls.where("reason is null"), float(RATE), 64, 16, 16, 12, "ref", keep=("id", "label"), v="samples")
    t = t.select("id", "label", "padded", "cells", "error").unionByName(calls.where("reason is not null").select("id", "label", F.col("reason").alias("error")), allowMissingColumns=True)
    return t.select("id", "label", "error", F.round("padded", 6).alias("padded"), F.transform("cells", lambda x: F.round(x, 6) + F.lit(0.0)).alias("cells"))
