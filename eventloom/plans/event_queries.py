"""Queries on events as intervals: as-of joins, rates, overlaps, history, edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audits, cohort, intervals
from ..sources import tables as T
from .common import EV, register

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)
HOUR = 3600.0
TAUS = (6 * HOUR, 12 * HOUR, 24 * HOUR)
TAU_SQL = "(VALUES (21600.0::DOUBLE), (43200.0::DOUBLE), (86400.0::DOUBLE)) tau(tau)"


def six(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to 6 digits: sums that come in another order differ in the last bits."""
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


FO = "fo AS (SELECT * FROM ev WHERE focal), nf AS (SELECT * FROM ev WHERE NOT focal)"
NEAR = f"""{EV}, {FO}, near AS (
  SELECT f.*, a.start_s AS next_start, b.end_s AS prev_end FROM fo f
  ASOF LEFT JOIN nf a ON f.clip = a.clip AND f.end_s <= a.start_s
  ASOF LEFT JOIN (SELECT clip, end_s FROM nf) b ON f.clip = b.clip AND f.start_s >= b.end_s)"""
OUT = f"""{NEAR}, oc AS (
  SELECT *, coalesce(next_start - end_s <= tau, false) AND NOT post_censored AS nf_post, coalesce(start_s - prev_end <= tau, false) AND NOT pre_censored AS nf_pre
  FROM (SELECT near.*, tau, end_s > 2592000.0 - tau AS post_censored, start_s < tau AS pre_censored FROM near CROSS JOIN {TAU_SQL}))"""


@query(f"WITH {NEAR} SELECT call_id, next_start FROM near")
def jon1_asof_forward(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d)
    return intervals.asof(e.where("focal"), e.where("not focal"), "end_s", "start_s", ["start_s"], True).select("call_id", F.col("found.start_s").alias("next_start"))


@query(f"WITH {NEAR} SELECT call_id, prev_end FROM near")
def jon2_asof_backward(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d)
    return intervals.asof(e.where("focal"), e.where("not focal"), "start_s", "end_s", ["end_s"], False).select("call_id", F.col("found.end_s").alias("prev_end"))


@query(f"WITH {NEAR} SELECT call_id, clip, label, next_start, prev_end, start_s AS start_margin, 2592000.0 - end_s AS end_margin FROM near")
def asof_both(spark: SparkSession, d: str) -> DataFrame:
    n = intervals.neighbours(T.events(spark, d))
    return n.select("call_id", "clip", "label", "next_start", "prev_end", F.col("start_s").alias("start_margin"), (F.lit(T.SPAN) - F.col("end_s")).alias("end_margin"))


@query(f"WITH {OUT} SELECT call_id, tau, post_censored, pre_censored, nf_post, nf_pre FROM oc")
def win4_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return intervals.outcomes(intervals.neighbours(T.events(spark, d)), TAUS, T.SPAN).select("call_id", "tau", "post_censored", "pre_censored", "nf_post", "nf_pre")


@query(f"""WITH {OUT}, g AS (SELECT label, tau, count(*) AS n, count_if(post_censored) AS post_censored_n, count_if(pre_censored) AS pre_censored_n, count_if(nf_post) AS post_n, count_if(nf_pre) AS pre_n FROM oc GROUP BY label, tau)
SELECT *, round(post_n / nullif(n - post_censored_n, 0), 6) AS post_rate, round(pre_n / nullif(n - pre_censored_n, 0), 6) AS pre_rate, round(post_n / nullif(n - post_censored_n, 0) - pre_n / nullif(n - pre_censored_n, 0), 6) AS post_minus_pre FROM g""")
def agg3_rates(spark: SparkSession, d: str) -> DataFrame:
    return six(intervals.rates(intervals.outcomes(intervals.neighbours(T.events(spark, d)), TAUS, T.SPAN)), "post_rate", "pre_rate", "post_minus_pre")


@query(f"WITH {OUT} SELECT label, tau, count(*) AS n FROM oc WHERE NOT post_censored AND NOT pre_censored GROUP BY label, tau")
def flt4_eligible(spark: SparkSession, d: str) -> DataFrame:
    o = intervals.outcomes(intervals.neighbours(T.events(spark, d)), TAUS, T.SPAN)
    return o.where("not post_censored and not pre_censored").groupBy("label", "tau").agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT call_id, clip FROM ev WHERE focal AND start_s >= 86400 AND end_s <= 2592000.0 - 86400")
def flt5_common_cohort(spark: SparkSession, d: str) -> DataFrame:
    return T.events(spark, d).where(F.col("focal") & (F.col("start_s") >= 86400.0) & (F.col("end_s") <= T.SPAN - 86400.0)).select("call_id", "clip")


NOTES = """nt AS (SELECT clip, call_id AS note_id, start_s - 3600 AS start_s, start_s + 3600 AS end_s FROM ev WHERE label = 'purchase'),
sg AS (SELECT * FROM ev WHERE label <> 'purchase' AND clip IN (SELECT clip FROM nt)),
jj AS (SELECT s.call_id, n.note_id, greatest(0.0, least(s.end_s, n.end_s) - greatest(s.start_s, n.start_s)) / greatest(s.end_s - s.start_s, 1e-9) AS part, (s.start_s + s.end_s) / 2 BETWEEN n.start_s AND n.end_s AS mid
  FROM sg s JOIN nt n ON s.clip = n.clip AND s.start_s <= n.end_s AND n.start_s <= s.end_s),
gg AS (SELECT call_id, count_if(part >= 0.5 OR mid) AS n_hits, max({'p': part, 'm': -note_id}) AS top, max({'p': part, 'm': -note_id}) FILTER (WHERE part >= 0.5 OR mid) AS lone FROM jj GROUP BY call_id),
mp AS (SELECT call_id, coalesce(n_hits, 0) AS n_hits, CASE coalesce(n_hits, 0) WHEN 0 THEN 'zero' WHEN 1 THEN 'unique' ELSE 'multiple' END AS status,
  CASE WHEN n_hits = 1 THEN -lone.m WHEN n_hits > 1 THEN -top.m END AS best_id, coalesce(CASE WHEN n_hits = 1 THEN lone.p WHEN n_hits > 1 THEN top.p END, 0.0) AS best_overlap FROM sg LEFT JOIN gg USING (call_id))"""


def _mapped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = T.events(spark, d)
    notes = e.where("label = 'purchase'").select("clip", "call_id", (F.col("start_s") - 3600).alias("start_s"), (F.col("start_s") + 3600).alias("end_s"))
    segments = e.where("label <> 'purchase'")
    return segments, intervals.mapped(segments, notes)


@query(f"WITH {EV}, {NOTES} SELECT call_id, n_hits, status, best_id, round(best_overlap, 6) AS best_overlap FROM mp")
def jon5_interval_mapping(spark: SparkSession, d: str) -> DataFrame:
    return six(_mapped(spark, d)[1], "best_overlap")


@query(f"WITH {EV}, {NOTES} SELECT status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM mp GROUP BY status")
def agg6_mapping_status(spark: SparkSession, d: str) -> DataFrame:
    return six(cohort.frequency(_mapped(spark, d)[1], "status"), "fraction")


@query(f"WITH {EV}, {NOTES} SELECT clip, count(*) AS n, count_if(status = 'unique') AS n_unique, count_if(status = 'multiple') AS n_multiple, count_if(status = 'zero') AS n_zero, count_if(n_hits >= 2) > 0 AS any_multiple FROM mp JOIN (SELECT call_id, clip FROM ev) USING (call_id) GROUP BY clip")
def agg5_mapping_by_clip(spark: SparkSession, d: str) -> DataFrame:
    segments, m = _mapped(spark, d)
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return m.join(segments.select("call_id", "clip"), "call_id").groupBy("clip").agg(F.count("*").alias("n"), n("unique"), n("multiple"), n("zero"), (F.count_if(F.col("n_hits") >= 2) > 0).alias("any_multiple"))


#: Events are short against their distances; stretched a thousandfold, they overlap.
WIDE = "wd AS (SELECT clip, call_id, label, focal, start_s, start_s + 1000 * (end_s - start_s) AS end_s FROM ev)"


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return T.events(spark, d).withColumn("end_s", F.col("start_s") + 1000 * (F.col("end_s") - F.col("start_s")))


@query(f"""WITH {EV}, {WIDE}, pp AS (SELECT a.call_id, greatest(a.start_s, b.start_s) AS lo, least(a.end_s, b.end_s) AS hi, b.focal FROM wd a JOIN wd b ON a.clip = b.clip AND a.call_id <> b.call_id AND b.start_s < a.end_s AND b.end_s > a.start_s WHERE a.focal),
ss AS (SELECT *, max(hi) OVER (PARTITION BY call_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r, max(CASE WHEN NOT focal THEN hi END) OVER (PARTITION BY call_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r2 FROM pp),
u AS (SELECT call_id, count(*) AS n, sum(greatest(0, hi - greatest(lo, coalesce(r, lo)))) AS c, sum(CASE WHEN NOT focal THEN greatest(0, hi - greatest(lo, coalesce(r2, lo))) ELSE 0 END) AS c2 FROM ss GROUP BY call_id)
SELECT w.call_id, coalesce(n, 0) AS n_overlaps, round(coalesce(c / nullif(end_s - start_s, 0), 0.0), 6) AS overlap_fraction, round(coalesce(c2 / nullif(end_s - start_s, 0), 0.0), 6) AS nonfocal_fraction FROM wd w LEFT JOIN u USING (call_id) WHERE focal""")
def jon7_overlap_shares(spark: SparkSession, d: str) -> DataFrame:
    w = _wide(spark, d)
    return six(intervals.overlap_shares(w.where("focal"), w), "overlap_fraction", "nonfocal_fraction")


@query(f"""WITH {EV}, {WIDE}, ss AS (SELECT clip, start_s AS lo, end_s AS hi, max(end_s) OVER (PARTITION BY clip ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM wd)
SELECT clip, round(sum(greatest(0, hi - greatest(lo, coalesce(r, lo)))), 3) AS covered FROM ss GROUP BY clip""")
def agg14_union_length(spark: SparkSession, d: str) -> DataFrame:
    return intervals.union_length(_wide(spark, d)).select("clip", F.round("covered", 3).alias("covered"))


def _history_sql() -> str:
    side = lambda s, gap: f"SELECT f.call_id, tau, '{s}' AS side, f.label AS own, e.label, e.focal FROM fo f JOIN ev e USING (clip) CROSS JOIN {TAU_SQL} WHERE {gap} >= 0 AND {gap} <= tau"
    return f"""WITH {EV}, {FO}, hh AS ({side('pre', '(f.start_s - e.end_s)')} UNION ALL {side('post', '(e.start_s - f.end_s)')}),
    g AS (SELECT call_id, tau, side, count(*) AS all_n, count_if(focal) AS focal_n, count_if(NOT focal) AS nonfocal_n, count_if(own = label) AS same_label_n, count(DISTINCT label) AS labels_n FROM hh GROUP BY ALL)
    SELECT f.call_id, tau.tau, s.side, coalesce(all_n, 0) AS all_n, coalesce(focal_n, 0) AS focal_n, coalesce(nonfocal_n, 0) AS nonfocal_n, coalesce(same_label_n, 0) AS same_label_n, coalesce(labels_n, 0) AS labels_n
    FROM fo f CROSS JOIN {TAU_SQL} CROSS JOIN (VALUES ('pre'), ('post')) s(side) LEFT JOIN g ON g.call_id = f.call_id AND g.tau = tau.tau AND g.side = s.side"""


@query(_history_sql())
def win3_history(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d)
    return intervals.history(e.where("focal"), e, TAUS)


ED = """ed AS (SELECT * FROM (SELECT clip, call_id AS call_i, label AS label_i, k AS k_i, lead(call_id) OVER w AS call_j, lead(label) OVER w AS label_j, lead(k) OVER w AS k_j, lead(start_s) OVER w - end_s AS delta_s
  FROM ev WINDOW w AS (PARTITION BY clip ORDER BY start_s, end_s, call_id)) WHERE call_j IS NOT NULL)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return intervals.edges(T.events(spark, d), ["label", "k"])


@query(f"WITH {EV}, {ED} SELECT clip, call_i, call_j, delta_s, label_i, label_j, k_i, k_j FROM ed")
def win1_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@query("SELECT conv_id AS clip, call_i, call_j, role_i, role_j FROM (SELECT conv_id, turn AS call_i, lead(turn) OVER w AS call_j, role AS role_i, lead(role) OVER w AS role_j FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE call_j IS NOT NULL")
def win1_turn_edges(spark: SparkSession, d: str) -> DataFrame:
    c = T.table(spark, d, "conversations").select(F.col("conv_id").alias("clip"), F.col("turn").alias("call_id"), F.col("turn").cast("double").alias("start_s"), F.col("turn").cast("double").alias("end_s"), "role")
    return intervals.edges(c, ["role"], 1000.0).drop("delta_s")


EMIT = "k_i % 5 AS em_i, k_j % 5 AS em_j, k_i % 3 AS ad_i, k_j % 3 AS ad_j"


@query(f"""WITH {EV}, {ED}, x AS (SELECT *, {EMIT} FROM ed)
SELECT call_i, CASE WHEN (em_i = em_j AND ad_i = ad_j) OR (em_i = ad_j AND ad_i = em_j) THEN 'same_pair' WHEN label_i = label_j AND em_i = em_j THEN 'same_context_and_emitter' WHEN label_i = label_j THEN 'same_context' WHEN em_i = em_j THEN 'same_emitter' ELSE 'different' END AS relation FROM x""")
def fn_edge_relation(spark: SparkSession, d: str) -> DataFrame:
    s = lambda c, m: (F.col(c) % m).cast("string")
    dyad = S.same_pair(s("k_i", 5), s("k_i", 3), s("k_j", 5), s("k_j", 3))
    return _edges(spark, d).select("call_i", cohort.relation(F.col("label_i"), F.col("label_j"), s("k_i", 5), s("k_j", 5), dyad).alias("relation"))


REL = f"WITH {EV}, {ED}, x AS (SELECT label_i, delta_s, (k_i % 5) <> 0 AS known, label_i = label_j AS same FROM ed)"


@query(f"""{REL}, g AS (SELECT coalesce(label_i, 'ALL') AS context, tau, count_if(known) AS known_n, count_if(known AND delta_s <= tau) AS candidate_n, count_if(known AND same) AS same_n, count_if(known AND same AND delta_s <= tau) AS same_candidate_n
  FROM x CROSS JOIN {TAU_SQL} GROUP BY GROUPING SETS ((label_i, tau), (tau)))
SELECT *, round(same_candidate_n / nullif(candidate_n, 0), 6) AS precision, round(1 - same_candidate_n / nullif(candidate_n, 0), 6) AS false_link, round(candidate_n / nullif(known_n, 0), 6) AS coverage, round(same_candidate_n / nullif(same_n, 0), 6) AS recall FROM g""")
def agg4_reliability(spark: SparkSession, d: str) -> DataFrame:
    r = cohort.reliability(_edges(spark, d), TAUS, "label_i", known=(F.col("k_i") % 5) != 0, same=F.col("label_i") == F.col("label_j"))
    return six(r, "precision", "false_link", "coverage", "recall")


@query(f"WITH {EV}, {ED} SELECT label_j, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM ed GROUP BY label_j")
def agg7_next_labels(spark: SparkSession, d: str) -> DataFrame:
    return six(cohort.frequency(_edges(spark, d), "label_j"), "fraction")


@query(f"WITH {EV}, {ED} SELECT tau, label_j, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY tau), 6) AS fraction FROM ed CROSS JOIN {TAU_SQL} WHERE delta_s <= tau GROUP BY tau, label_j")
def agg8_next_labels_by_window(spark: SparkSession, d: str) -> DataFrame:
    return six(cohort.frequency(cohort.up_to(_edges(spark, d), "delta_s", TAUS), "label_j", ["tau"]), "fraction")


@query(f"WITH {EV}, {ED} SELECT label_i, round(avg(CAST(label_i = label_j AS INTEGER)), 6) AS same_rate FROM ed WHERE delta_s <= 43200 GROUP BY label_i")
def agg9_conditional_rates(spark: SparkSession, d: str) -> DataFrame:
    return six(_edges(spark, d).where(F.col("delta_s") <= 43200.0).groupBy("label_i").agg(F.avg((F.col("label_i") == F.col("label_j")).cast("int")).alias("same_rate")), "same_rate")


@query(f"""WITH {EV}, {FO}, o AS (SELECT clip, start_s, call_id, label AS nl FROM ev)
SELECT f.call_id, n.start_s - f.end_s AS gap_s, coalesce(n.nl = f.label, false) AS same_label FROM fo f ASOF LEFT JOIN o n ON f.clip = n.clip AND f.end_s <= n.start_s""")
def win2_gaps(spark: SparkSession, d: str) -> DataFrame:
    return intervals.gaps(T.events(spark, d))


@query(f"WITH {EV} SELECT label, focal, count(*) AS n FROM ev GROUP BY label, focal")
def agg1_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.events(spark, d).groupBy("label", "focal").agg(F.count("*").alias("n"))


@query("""SELECT event_type AS label, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, min(value) AS least, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS most FROM events GROUP BY event_type""")
def agg2_durations(spark: SparkSession, d: str) -> DataFrame:
    t = T.table(spark, d, "events").select(F.col("event_type").alias("label"), "value")
    return six(audits.described(t, ["label"], "value"), "mean", "sd", "p25", "median", "p75")


@query(f"WITH {EV} SELECT call_id, round(ln(1 + greatest(end_s - start_s, 0)), 6) AS log_duration, start_s AS start_margin, 2592000.0 - end_s AS end_margin, round((start_s + end_s) / 2, 6) AS centre FROM ev")
def prj16_interval_columns(spark: SparkSession, d: str) -> DataFrame:
    dur = F.greatest(F.col("end_s") - F.col("start_s"), F.lit(0.0))
    return six(T.events(spark, d).select("call_id", F.log1p(dur).alias("log_duration"), F.col("start_s").alias("start_margin"), (F.lit(T.SPAN) - F.col("end_s")).alias("end_margin"), ((F.col("start_s") + F.col("end_s")) / 2).alias("centre")), "log_duration", "centre")


@query(f"WITH {EV} SELECT call_id, clip, row_number() OVER (PARTITION BY clip ORDER BY start_s, call_id) - 1 AS event_index FROM ev")
def win5_event_index(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d).withColumn("b", F.floor(F.col("start_s") / intervals.BUCKET))
    counts = e.groupBy("clip", "b").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("clip").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("clip", "b").orderBy("start_s", "call_id"))
    return e.withColumn("own", own).join(counts.withColumn("before", before), ["clip", "b"]).select("call_id", "clip", (F.col("before") + F.col("own") - 1).cast("long").alias("event_index"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' ELSE event_type END AS name FROM events")
def prj8_code_book(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "events").select("event_id", T.when_map(F.col("event_type"), {"click": "c", "view": "v"}).alias("name"))


@query("SELECT event_id, CAST(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS VARCHAR) AS id, event_type IN ('click') AS flag, lower(event_type) IN ('true', '1', 'yes', 'y', 't') AS truth FROM events")
def prj6_clean_ids(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events")
    return e.select("event_id", S.clean_id(F.get_json_object("props", "$.k")).alias("id"), (F.col("event_type") == "click").alias("flag"), S.truth(F.col("event_type")).alias("truth"))


@query("""WITH t AS (SELECT doc_id, n_chars, least(greatest(CAST(pow(2, floor(log2(greatest(n_chars, 64)))) AS INTEGER), 64), 512) AS n_fft FROM documents)
SELECT doc_id, n_fft, greatest(16, n_fft // 4) AS hop, least(greatest(n_fft // 4, 8), 32) AS n_mels FROM t""")
def fn_window_shape(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "documents").select("doc_id", S.window_shape(F.col("n_chars")).alias("w")).select("doc_id", "w.*")
