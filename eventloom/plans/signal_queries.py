"""Queries on arrays of samples (the vectors of ``embeddings``) and on the windows that calls may read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import signals
from ..operators import audits, spectra
from ..sources import tables as T
from .common import EV, VE, register
from .event_queries import six

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)
RATE, SAMPLES = 8.0, 2_592_000 * 8
MEAN = lambda x: f"list_sum({x}) / len(v)"


def _unpacked(df: DataFrame, c: str, *columns: str) -> DataFrame:
    return six(df.select("id", *(F.col(f"{c}.{x}").alias(x) for x in columns)), *columns)


@query(f"""WITH {VE}, l AS (SELECT id, sqrt({MEAN('[x * x for x in v]')}) AS rms, list_max([abs(x) for x in v]) AS peak, {MEAN('[CAST(abs(x) >= 0.2 AS INTEGER) for x in v]')} AS clipped FROM ve)
SELECT id, round(rms, 6) AS rms, round(peak, 6) AS peak, round(CASE WHEN rms > 1e-10 THEN peak / rms END, 6) AS crest, round(clipped, 6) AS clipped FROM l""")
def dsp2_levels(spark: SparkSession, d: str) -> DataFrame:
    return _unpacked(T.vectors(spark, d).select("id", signals.levels(F.col("v"), 0.2).alias("l")), "l", "rms", "peak", "crest", "clipped")


@query(f"""WITH {VE}, l AS (SELECT id, v, sqrt({MEAN('[x * x for x in v]')}) AS rms, list_max([abs(x) for x in v]) AS peak FROM ve),
g AS (SELECT id, v, peak * (10 ** (-12.0 / 20)) / rms > 0.99 AS limited, CASE WHEN peak * (10 ** (-12.0 / 20)) / rms > 0.99 THEN 0.99 / peak ELSE (10 ** (-12.0 / 20)) / rms END AS gain FROM l WHERE rms > 1e-10)
SELECT id, round(20 * log10(gain), 6) AS gain_db, limited, round(list_sum([x * gain * x * gain for x in v]), 6) AS energy FROM g""")
def dsp3_levelled(spark: SparkSession, d: str) -> DataFrame:
    t = T.vectors(spark, d).where(signals.rms(F.col("v")) > signals.SILENT).select("id", signals.levelled(F.col("v"), -12.0).alias("l"))
    return six(t.select("id", "l.gain_db", "l.limited", signals.total(F.transform("l.samples", lambda x: x * x)).alias("energy")), "gain_db", "energy")


@query(f"""WITH {VE}, m AS (SELECT id, v, {MEAN('v')} AS mean FROM ve)
SELECT id, round(mean, 6) AS mean, round(sqrt({MEAN('[(x - mean) * (x - mean) for x in v]')}), 6) AS sd, round(list_min(v), 6) AS least, round(list_max(v), 6) AS most FROM m""")
def dsp4_stats(spark: SparkSession, d: str) -> DataFrame:
    return _unpacked(T.vectors(spark, d).select("id", signals.stats(F.col("v")).alias("s")), "s", "mean", "sd", "least", "most")


@query(f"""WITH {VE}, p AS (SELECT id, [x * x for x in v] AS p, list_sum([x * x for x in v]) AS t FROM ve)
SELECT id, round(CASE WHEN t > 1e-10 THEN -list_sum([x / t * log2(x / t + 1e-10) for x in p]) / log2(greatest(len(p), 2)) END, 6) AS entropy FROM p""")
def dsp5_spectral_entropy(spark: SparkSession, d: str) -> DataFrame:
    return six(T.vectors(spark, d).select("id", signals.spectral_entropy(F.transform("v", lambda x: x * x)).alias("entropy")), "entropy")


@query(f"""WITH {VE}, m AS (SELECT id, v, {MEAN('v')} AS mean FROM ve), s AS (SELECT id, v, mean, sqrt({MEAN('[(x - mean) * (x - mean) for x in v]')}) AS sd FROM m)
SELECT id, [round(CASE WHEN sd > 1e-10 THEN (x - mean) / sd ELSE 0 END, 6) + 0.0 for x in v] AS z FROM s""")
def dsp12_standard(spark: SparkSession, d: str) -> DataFrame:
    return T.vectors(spark, d).select("id", F.transform(signals.standard(F.col("v")), lambda x: F.round(x, 6) + F.lit(0.0)).alias("z"))


PLAN = """pb AS (SELECT call_id, CAST(round_even(start_s * 8.0, 0) AS BIGINT) AS a, CAST(round_even(end_s * 8.0, 0) AS BIGINT) AS b FROM ev),
pn AS (SELECT call_id, a, b, least(a, b - 240) AS w FROM pb WHERE 0 <= a AND a < b AND b <= 20736000)"""


def _planned(spark: SparkSession, d: str) -> DataFrame:
    p = signals.support_plan(F.col("start_s"), F.col("end_s"), F.lit(RATE), F.lit(SAMPLES), 30_000.0)
    return T.events(spark, d).select("call_id", p.alias("p")).where("p is not null")


@query(f"""WITH {EV}, {PLAN} SELECT call_id, w AS window_start, b AS window_end, greatest(0, w) AS source_start, greatest(0, -w) AS left_pad, b - w AS n_samples, a - w AS focal_start, b - w AS focal_end FROM pn""")
def dsp15_support_plan(spark: SparkSession, d: str) -> DataFrame:
    return _planned(spark, d).select("call_id", *(f"p.{c}" for c in ("window_start", "window_end", "source_start", "left_pad", "n_samples", "focal_start", "focal_end")))


@query(f"""WITH {EV}, {PLAN}, c AS (SELECT a, b, CAST(floor((a + b) / 2) AS BIGINT) - 120 AS s FROM pn), e AS (SELECT greatest(0, least(s + 240, 20736000) - b) * 1000.0 / 8 AS future_ms, s > a OR s + 240 < b AS truncates FROM c)
SELECT count(*) AS n, count_if(future_ms > 0) AS exposed, round(quantile_cont(future_ms, 0.5), 6) AS median_ms, count_if(truncates) AS truncated FROM e""")
def dsp17_future_leak(spark: SparkSession, d: str) -> DataFrame:
    leak = signals.centred_leak(F.col("start_s"), F.col("end_s"), F.lit(RATE), F.lit(SAMPLES), 30_000.0)
    p = signals.support_plan(F.col("start_s"), F.col("end_s"), F.lit(RATE), F.lit(SAMPLES), 30_000.0)
    t = T.events(spark, d).where(p.isNotNull()).select(leak.alias("l")).select("l.*")
    return six(t.agg(F.count("*").alias("n"), F.count_if(F.col("future_ms") > 0).alias("exposed"), F.percentile("future_ms", F.lit(0.5)).alias("median_ms"), F.count_if("truncates").alias("truncated")), "median_ms")


#: A call of 10 samples from sample 4 + id mod 40 on, in windows of at least 32 samples.
CALL = f"""{VE}, cw AS (SELECT id, v, least(4 + id % 40, 14 + id % 40 - 32) AS w, 4 + id % 40 AS a, 14 + id % 40 AS b FROM ve),
wn AS (SELECT id, list_concat([0.0::DOUBLE for i in range(greatest(0, -w))], v[greatest(0, w) + 1:b]) AS x, greatest(0, -w) AS pad, a - w AS fs, b - w AS fe FROM cw),
al AS (SELECT id, x, [i - 1 >= pad AND NOT (i - 1 >= fs AND i - 1 < fe) for i in range(1, len(x) + 1)] AS ok FROM wn),
kp AS (SELECT id, x, ok, list_where(x, ok) AS k FROM al), mm AS (SELECT *, list_avg(k) AS m FROM kp), ms AS (SELECT *, sqrt(list_avg([(y - m) * (y - m) for y in k])) AS s FROM mm)"""


@query(f"""WITH {CALL} SELECT id, len(x) AS n, coalesce(s > 1e-8, false) AS informative, round(1 - len(k) / len(x), 6) AS masked, round(coalesce(CASE WHEN s > 1e-8 THEN list_sum([abs(y - m) / s for y in k]) END, 0.0), 6) AS size FROM ms""")
def dsp16_masked_standard(spark: SparkSession, d: str) -> DataFrame:
    first = (4 + F.col("id") % 40).cast("double")
    p = signals.support_plan(first, first + 10, F.lit(1.0), F.lit(64), 32_000.0)
    t = T.vectors(spark, d).select("id", "v", p.alias("p")).select("id", signals.read_window(F.col("v"), F.col("p")).alias("w"), "p")
    t = t.select("id", F.size("w").cast("long").alias("n"), signals.masked_standard(F.col("w"), F.col("p"), "context_only").alias("s"))
    return six(t.select("id", "n", "s.informative", "s.masked", signals.total(F.transform("s.samples", F.abs)).alias("size")), "masked", "size")


@query(f"""WITH {VE}, sp AS (SELECT id, v, greatest(0, least(15, CAST(floor((id % 50) / 64.0 * 16) AS INTEGER))) AS f, id % 50 AS a FROM ve), sq AS (SELECT id, v, f, greatest(f + 1, least(16, CAST(ceil((a + 9) / 64.0 * 16) AS INTEGER))) AS l FROM sp)
SELECT id, f AS first, l AS last, [round(list_avg([v[4 * i + k] for i in range(f, l)]), 6) + 0.0 for k in range(1, 5)] AS pooled FROM sq""")
def dsp14_pooled_frames(spark: SparkSession, d: str) -> DataFrame:
    frames = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("v", 4 * i + 1, 4))
    a = F.col("id") % 50
    t = T.vectors(spark, d).select("id", frames.alias("f"), signals.focal_frames(a, a + 9, F.lit(64.0), F.lit(16)).alias("s"))
    return t.select("id", "s.first", "s.last", F.transform(signals.pooled(F.col("f"), F.col("s")), lambda x: F.round(x, 6) + F.lit(0.0)).alias("pooled"))


# -- frames and segments


@query()
def dsp6_frame_features(spark: SparkSession, d: str) -> DataFrame:
    """All features of each vector taken as a signal of 8 kHz."""
    t = spectra.features(T.vectors(spark, d).select("id", "v"), 8000.0)
    return six(t, *spectra.NAMES)


@query()
def dsp7_quality_rows(spark: SparkSession, d: str) -> DataFrame:
    """Raw and levelled variants of each vector, a few without a signal: rows with their reason where features can't be made."""
    v = T.vectors(spark, d).select("id", F.when(F.col("id") % 50 != 7, F.col("v")).alias("v"))
    levelled = v.select("id", F.lit("levelled").alias("variant"), signals.levelled(F.col("v"), -25.0)["samples"].alias("v"))
    both = v.select("id", F.lit("raw").alias("variant"), "v").unionByName(levelled)
    t = spectra.features(both, 8000.0, ("id", "variant"))
    return six(t.groupBy("variant", F.coalesce("error", F.lit("")).alias("error")).agg(F.count("*").alias("n"), F.avg("rms_dbfs").alias("rms_dbfs"), F.avg("centroid_mean").alias("centroid")), "rms_dbfs", "centroid")


@query()
def dsp9_log_mel(spark: SparkSession, d: str) -> DataFrame:
    """Log-mel spectra stretched to 8 frames of 16 bands, and padded ones of zero mean and unit sd: cells of each."""
    v = T.vectors(spark, d).select("id", "v")
    stretched = spectra.spectra(v, 8000.0, 64, 16, 16, 8).withColumn("kind", F.lit("resize"))
    padded = spectra.spectra(v, 8000.0, 64, 16, 16, 12, "pad", standard=True).withColumn("kind", F.lit("pad"))
    t = stretched.unionByName(padded)
    return t.select("id", "kind", F.round("padded", 6).alias("padded"), F.transform("cells", lambda x: F.round(x, 6) + F.lit(0.0)).alias("cells"))


@query()
def dsp10_relative_log_mel(spark: SparkSession, d: str) -> DataFrame:
    """Log-mel spectra in decibels below the loudest cell, padded with the least value, by label: how loud bands are and how much is padding."""
    v = T.vectors(spark, d).select("id", "label", "v")
    t = spectra.spectra(v, 8000.0, 64, 16, 16, 12, "ref", keep=("id", "label"))
    g = t.groupBy("label").agg(F.count("*").alias("n"), F.avg("padded").alias("padded"), F.avg(F.aggregate("cells", F.lit(0.0), lambda a, x: a + x) / F.size("cells")).alias("level"))
    return six(g, "padded", "level")


@query(f"""WITH {VE}, b AS (SELECT id, v, greatest(0, CAST(round_even(id % 40 / 8.0 * 8, 0) AS BIGINT)) AS a, least(64, CAST(round_even((id % 40 + 9.5) / 8.0 * 8, 0) AS BIGINT)) AS z FROM ve)
SELECT id, a AS first, z AS last, [round(x, 6) + 0.0 for x in v[a + 1:z]] AS segment, [round(x, 6) + 0.0 for x in list_concat(v[greatest(0, a - 4) + 1:a], v[z + 1:least(64, z + 4)])] AS context FROM b""")
def dsp1_segments(spark: SparkSession, d: str) -> DataFrame:
    """A call's samples by its rounded bounds, and those within half a second around it."""
    start = (F.col("id") % 40) / F.lit(8.0)
    s = signals.segment(F.col("v"), start, start + F.lit(9.5 / 8), F.lit(RATE), F.lit(0.5))
    rounded = lambda c: F.transform(c, lambda x: F.round(x, 6) + F.lit(0.0))
    return T.vectors(spark, d).select("id", s.alias("s")).select("id", "s.first", "s.last", rounded("s.segment").alias("segment"), rounded("s.context").alias("context"))


@query(f"""WITH {VE}, c AS (SELECT id, v, anchor, CASE anchor WHEN 'start' THEN id % 60 ELSE CAST(floor((2 * (id % 60) + 9) / 2) AS BIGINT) - 10 END AS a FROM ve, (VALUES ('start'), ('centre')) t(anchor))
SELECT id, anchor, greatest(0, -a) AS left_pad, greatest(0, a + 20 - 64) AS right_pad, [round(x, 6) + 0.0 for x in list_concat(list_concat([0.0::DOUBLE for i in range(greatest(0, -a))], v[greatest(0, a) + 1:least(64, a + 20)]), [0.0::DOUBLE for i in range(greatest(0, a + 20 - 64))])] AS samples FROM c""")
def dsp11_context_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 20 samples about a call's centre, or from its start, with zeros where the signal has ended."""
    v, out = T.vectors(spark, d).select("id", "v"), None
    for anchor in ("start", "centre"):
        w = signals.context_window(F.col("v"), F.col("id") % 60, F.col("id") % 60 + 9, 20, anchor)
        part = v.select("id", F.lit(anchor).alias("anchor"), w.alias("w")).select("id", "anchor", "w.left_pad", "w.right_pad", F.transform("w.samples", lambda x: F.round(x, 6) + F.lit(0.0)).alias("samples"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {EV}, r AS (SELECT call_id, CAST(round_even(end_s * 8.0, 0) - round_even(start_s * 8.0, 0) AS BIGINT) + CASE WHEN call_id % 31 = 0 THEN 2 ELSE call_id % 2 END AS n, CAST(round_even(end_s * 8.0, 0) - round_even(start_s * 8.0, 0) AS BIGINT) AS bound, call_id % 17 = 0 AS silent FROM ev),
e AS (SELECT *, n < 4 OR silent AS early, least(512, greatest(64, CAST(2 ** floor(log2(greatest(n, 64))) AS INTEGER))) AS f FROM r),
c AS (SELECT *, CASE WHEN NOT early THEN CASE WHEN call_id % 13 = 0 THEN 2 * f ELSE f END END AS cached FROM e)
SELECT call_id, early, CASE WHEN NOT early THEN f END AS expected_n_fft, CASE WHEN NOT early THEN greatest(16, f // 4) END AS expected_hop, CASE WHEN NOT early THEN least(32, greatest(8, f // 4)) END AS expected_n_mels,
  cached IS NOT DISTINCT FROM CASE WHEN NOT early THEN f END AS formula_match, n - bound AS boundary_difference, abs(n - bound) <= 1 AS boundary_match, true AS duration_match FROM c""")
def dsp18_formula_audit(spark: SparkSession, d: str) -> DataFrame:
    """Cached window sizes against the formula, sample counts against rounded bounds; one call in 13 has a wrong size cached, one in 31 is two samples off."""
    e = T.events(spark, d)
    bound = (F.rint(F.col("end_s") * RATE) - F.rint(F.col("start_s") * RATE)).cast("long")
    n = bound + F.when(F.col("call_id") % 31 == 0, 2).otherwise(F.col("call_id") % 2)
    t = e.select("call_id", "start_s", "end_s", n.alias("n"), F.when(F.col("call_id") % 17 == 0, 0.0).otherwise(0.1).alias("rms"))
    f = S.window_shape(F.col("n"))
    wrong = F.when(F.col("call_id") % 13 == 0, 2).otherwise(1)
    early = (F.col("n") < 4) | (F.col("rms") <= signals.SILENT)
    t = t.withColumns({"n_fft": F.when(~early, f["n_fft"] * wrong), "hop": F.when(~early, f["hop"]), "n_mels": F.when(~early, f["n_mels"]), "duration": F.col("n") / RATE})
    return audits.formula_audit(t, RATE)
