"""Queries on predictions and vectors: losses, ranking, calibration, contrasts, agreement, geometry, bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import geometry, metrics
from ..sources import tables as T
from .common import LOSS, PR, VE, register
from .event_queries import six

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)
L0, L1 = LOSS("m0"), LOSS("m1")
ROLL = f"WITH {PR}, rl AS (SELECT *, unnest(['overall', label]) AS part FROM pr)"
VIEW = f"WITH {PR}, vw AS (SELECT *, unnest(CASE WHEN valid THEN ['all', 'valid'] ELSE ['all'] END) AS view FROM pr)"


def _losses_sql(table: str, *by: str) -> str:
    keys = ", ".join(by)
    return f"SELECT {keys}, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(avg({L0}), 6) AS loss0, round(avg({L1}), 6) AS loss1, round(avg((m0 - y) * (m0 - y)), 6) AS brier0, round(avg((m1 - y) * (m1 - y)), 6) AS brier1, round(avg({L0}) - avg({L1}), 6) AS delta FROM {table} GROUP BY {keys}"


def _losses(df: DataFrame, *by: str) -> DataFrame:
    return six(metrics.losses(df, by), "loss0", "loss1", "brier0", "brier1", "delta")


@query(f"{ROLL} {_losses_sql('rl', 'part', 'target')}")
def met1_log_loss(spark: SparkSession, d: str) -> DataFrame:
    return _losses(metrics.rolled(T.predictions(spark, d)), "part", "target")


@query(f"{VIEW} {_losses_sql('vw', 'view', 'target')}")
def met8_view_losses(spark: SparkSession, d: str) -> DataFrame:
    return _losses(metrics.views(T.predictions(spark, d)), "view", "target")


@query(f"WITH {PR} {_losses_sql('pr', 'fold', 'target')}")
def agg37_fold_losses(spark: SparkSession, d: str) -> DataFrame:
    return _losses(T.predictions(spark, d), "fold", "target")


RANK = """rk AS (SELECT part, target, y, m1, rank() OVER (PARTITION BY part, target ORDER BY m1) + (count(*) OVER (PARTITION BY part, target, m1) - 1) / 2.0 AS r FROM rl),
au AS (SELECT part, target, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0) AS auc FROM rk GROUP BY ALL),
sc AS (SELECT part, target, m1, sum(y) AS p, count(*) AS n FROM rl GROUP BY ALL),
cu AS (SELECT part, target, p, sum(p) OVER w AS tp, sum(n) OVER w AS nn FROM sc WINDOW w AS (PARTITION BY part, target ORDER BY m1 DESC)),
ap AS (SELECT part, target, sum(p * tp / nn) / nullif(sum(p), 0) AS ap FROM cu GROUP BY ALL)"""


@query(f"{ROLL}, {RANK} SELECT part, target, round(auc, 6) AS auc, round(ap, 6) AS ap FROM au JOIN ap USING (part, target)")
def met2_auc_and_ap(spark: SparkSession, d: str) -> DataFrame:
    return six(metrics.ranking(metrics.rolled(T.predictions(spark, d)), ["part", "target"], "m1"), "auc", "ap")


BIN_SQL = "CASE " + " ".join(f"WHEN m1 >= {a} AND m1 {'<=' if b == 1.0 else '<'} {b} THEN {k}" for k, (a, b) in enumerate(zip(metrics.EDGES, metrics.EDGES[1:], strict=False))) + " END"


@query(f"WITH {PR} SELECT target, {BIN_SQL} AS bin, count(*) AS n, round(avg(m1), 6) AS predicted, round(avg(y), 6) AS observed FROM pr GROUP BY 1, 2")
def bin2_reliability_bins(spark: SparkSession, d: str) -> DataFrame:
    return six(metrics.calibration_bins(T.predictions(spark, d), ["target"], "m1"), "predicted", "observed")


@query(f"""WITH {PR}, b AS (SELECT target, {BIN_SQL} AS bin, count(*) AS n, avg(m1) AS p, avg(y) AS o FROM pr GROUP BY 1, 2), e AS (SELECT target, sum(n * abs(p - o)) / sum(n) AS ece FROM b GROUP BY 1),
g AS (SELECT target, avg((m1 - y) * (m1 - y)) AS brier, avg(m1 - y) AS bias, count_if(abs(m1 - y) >= 0.9) AS wrong_n, coalesce(sum({L1}) FILTER (WHERE abs(m1 - y) >= 0.9), 0) / sum({L1}) AS wrong_share FROM pr GROUP BY 1)
SELECT target, round(brier, 6) AS brier, round(bias, 6) AS bias, wrong_n, round(ece, 6) AS ece, round(wrong_share, 6) AS wrong_share FROM g JOIN e USING (target)""")
def met5_calibration(spark: SparkSession, d: str) -> DataFrame:
    return six(metrics.calibration(T.predictions(spark, d), ["target"], "m1"), "brier", "bias", "ece", "wrong_share")


CLIPS = f"""WITH {PR}, cl AS (SELECT target, clip, count(*) AS n, sum({L0} - {L1}) AS gain_sum FROM pr GROUP BY 1, 2)"""


@query(f"{CLIPS} SELECT target, clip, n, round(gain_sum, 6) AS gain_sum, round((sum(gain_sum) OVER w - gain_sum) / nullif(sum(n) OVER w - n, 0), 6) AS without, round(abs(gain_sum) / nullif(sum(abs(gain_sum)) OVER w, 0), 6) AS share FROM cl WINDOW w AS (PARTITION BY target)")
def agg34_clip_totals(spark: SparkSession, d: str) -> DataFrame:
    return six(metrics.clip_totals(T.predictions(spark, d)), "gain_sum", "without", "share")


@query(f"""{CLIPS}, r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY abs(gain_sum) DESC, clip) AS r, count(*) OVER (PARTITION BY target) AS c FROM cl)
SELECT target, f AS fraction, count_if(r <= ceil(f * c)) AS top_n, round(coalesce(sum(abs(gain_sum)) FILTER (WHERE r <= ceil(f * c)), 0) / nullif(sum(abs(gain_sum)), 0), 6) AS top_share, round(sum(gain_sum) FILTER (WHERE r > ceil(f * c)) / sum(n) FILTER (WHERE r > ceil(f * c)), 6) AS delta_without
FROM r CROSS JOIN (VALUES (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE)) x(f) GROUP BY target, f""")
def agg35_concentration(spark: SparkSession, d: str) -> DataFrame:
    return six(metrics.concentration(metrics.clip_totals(T.predictions(spark, d)), (0.1, 0.25, 0.5)), "top_share", "delta_without")


PAIRED = f"""WITH {PR}, a AS (SELECT call_id, clip, label, {L0} - {L1} AS gain, target FROM pr)
SELECT p.call_id, p.clip, round(p.gain - q.gain, 6) AS post_minus_pre FROM a p JOIN a q USING (call_id) WHERE p.target = 'post' AND q.target = 'pre'"""


@query(PAIRED)
def jon16_post_pre(spark: SparkSession, d: str) -> DataFrame:
    g = metrics.gains(T.predictions(spark, d))
    side = lambda t: F.max(F.when(F.col("target") == t, F.col("gain")))
    p = g.groupBy("call_id", "clip").agg(side("post").alias("a"), side("pre").alias("b")).where("a is not null and b is not null")
    return six(p.select("call_id", "clip", (F.col("a") - F.col("b")).alias("post_minus_pre")), "post_minus_pre")


@query(f"""WITH {PR}, q AS (SELECT *, (m0 + m1) / 2 AS mc, 0.5 AS mr FROM pr), g AS (SELECT target, {L0} - {L1} AS total, {L0} - {LOSS('mc')} AS config, {LOSS('mc')} - {L1} AS remaining, {LOSS('mr')} - {L1} - {L0} + {LOSS('mc')} AS interaction FROM q)
SELECT target, round(avg(total), 6) AS total, round(avg(config), 6) AS config, round(avg(remaining), 6) AS remaining, round(avg(interaction), 6) AS interaction, max(abs(total - config - remaining)) < 1e-12 AS exact FROM g GROUP BY target""")
def met10_decomposition(spark: SparkSession, d: str) -> DataFrame:
    p = T.predictions(spark, d).withColumns({"mc": (F.col("m0") + F.col("m1")) / 2, "mr": F.lit(0.5)})
    g = metrics.decomposed(p).groupBy("target").agg(*(F.avg(c).alias(c) for c in ("total", "config", "remaining", "interaction")), (F.max("error") < 1e-12).alias("exact"))
    return six(g, "total", "config", "remaining", "interaction")


CAND = f"""WITH {PR}, s AS (SELECT target, CAST(c AS DOUBLE) AS c, fold AS inner_fold, count(*) AS n, sum(abs(y - m1) * c) AS loss_sum FROM pr CROSS JOIN (VALUES (1.0), (0.1), (10.0)) x(c) GROUP BY 1, 2, 3),
g AS (SELECT target, c, sum(loss_sum) / sum(n) AS loss FROM s GROUP BY 1, 2)"""


@query(f"{CAND} SELECT target, arg_min(c, loss) AS c, round(min(loss), 6) AS loss FROM g GROUP BY target")
def fit4_chosen_candidate(spark: SparkSession, d: str) -> DataFrame:
    s = T.predictions(spark, d).withColumn("c", F.explode(F.array(F.lit(1.0), F.lit(0.1), F.lit(10.0))))
    s = s.groupBy("target", "c", "fold").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("y") - F.col("m1")) * F.col("c")).alias("loss_sum"))
    return six(metrics.chosen(s, ["target"], (1.0, 0.1, 10.0)), "loss")


@query(f"""WITH {PR}, o AS (SELECT target, avg(m1 - m0) AS seen FROM pr GROUP BY 1), dr AS (SELECT target, fold, avg(m1 - m0) AS x FROM pr GROUP BY 1, 2)
SELECT target, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high, round((1 + count_if(x >= seen)) / (count(*) + 1), 6) AS p_value FROM dr JOIN o USING (target) GROUP BY target""")
def fit6_null_summary(spark: SparkSession, d: str) -> DataFrame:
    p = T.predictions(spark, d)
    mean = lambda *by: p.groupBy(*by).agg(F.avg(F.col("m1") - F.col("m0")).alias("x"))
    return six(metrics.null_summary(mean("target", "fold"), mean("target"), ["target"]), "mean", "sd", "low", "high", "p_value")


@query(f"""WITH {PR}, p AS (SELECT * FROM pr WHERE target = 'post'), a AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY call_id) AS r FROM p), b AS (SELECT label, m1 AS moved, row_number() OVER (PARTITION BY label ORDER BY sha256('1|' || call_id), call_id) AS r FROM p)
SELECT call_id, a.label, moved AS m1 FROM a JOIN b ON a.r = b.r AND a.label = b.label""")
def fit5_shuffled_within_label(spark: SparkSession, d: str) -> DataFrame:
    p = T.predictions(spark, d).where("target = 'post' and label is not null")
    return metrics.shuffled_within(p, "label", "call_id", ["m1"]).select("call_id", "label", "m1")


@query(f"""WITH {VE}, c AS (SELECT label AS a, cluster AS b, count(*) AS n FROM ve GROUP BY ALL), t AS (SELECT sum(n) AS t FROM c), ra AS (SELECT a, sum(n) AS na FROM c GROUP BY a), rb AS (SELECT b, sum(n) AS nb, max(n) AS top FROM c GROUP BY b),
x AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM c) AS bo, (SELECT sum(na * (na - 1) / 2.0) FROM ra) AS pa, (SELECT sum(nb * (nb - 1) / 2.0) FROM rb) AS pb, t * (t - 1) / 2.0 AS al, t, (SELECT sum(top) FROM rb) AS tops,
  (SELECT sum(n / t * ln(n * t / (na * nb))) FROM c JOIN ra USING (a) JOIN rb USING (b)) AS mi, (SELECT -sum(na / t * ln(na / t)) FROM ra) AS ha, (SELECT -sum(nb / t * ln(nb / t)) FROM rb) AS hb FROM t)
SELECT round((bo - pa * pb / al) / ((pa + pb) / 2 - pa * pb / al), 6) AS ari, round(mi / ((ha + hb) / 2), 6) AS nmi, round(tops / t, 6) AS purity, round((al - pa - pb + 2 * bo) / al, 6) AS pair_agreement, round(bo / pa, 6) AS same_kept FROM x""")
def met11_agreement(spark: SparkSession, d: str) -> DataFrame:
    return six(metrics.agreement(T.vectors(spark, d), "label", "cluster"), "ari", "nmi", "purity", "pair_agreement", "same_kept")


@query(f"""WITH {PR}, p AS (SELECT y AS a, CAST(m1 >= 0.5 AS INTEGER) AS b FROM pr WHERE target = 'post'), h AS (SELECT a, count(*) AS t, count_if(a = b) AS tp FROM p GROUP BY a), g AS (SELECT b, count(*) AS g FROM p GROUP BY b)
SELECT round(avg(tp / t), 6) AS balanced_accuracy, round(avg(2 * tp / (t + coalesce(g, 0))), 6) AS macro_f1 FROM h LEFT JOIN g ON h.a = g.b""")
def met4_confusion(spark: SparkSession, d: str) -> DataFrame:
    p = T.predictions(spark, d).where("target = 'post'").withColumn("guess", (F.col("m1") >= 0.5).cast("int"))
    return six(metrics.confusion_scores(p, "y", "guess"), "balanced_accuracy", "macro_f1")


DIST = "sqrt(list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
CEN = f"{VE}, lo AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS i FROM ve), ce AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM lo GROUP BY label, i) GROUP BY label)"


@query(f"WITH {CEN} SELECT a.label AS a, b.label AS b, round({DIST.format('a.c', 'b.c')}, 6) AS distance FROM ce a JOIN ce b ON a.label < b.label")
def met19_centroid_distances(spark: SparkSession, d: str) -> DataFrame:
    return six(geometry.centroid_distances(T.vectors(spark, d), "label"), "distance")


@query(f"""WITH {VE}, dd AS (SELECT a.id AS q, a.label AS own, b.id, b.label AS other, {DIST.format('a.v', 'b.v')} AS dist FROM ve a JOIN ve b ON a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(dist, 9), id) AS r FROM dd)
SELECT own AS label, count(*) AS n, round(avg(CAST(own = other AS INTEGER)), 6) AS purity FROM r WHERE r <= 15 GROUP BY own""")
def met15_neighbour_purity(spark: SparkSession, d: str) -> DataFrame:
    v = T.vectors(spark, d)
    return six(geometry.neighbour_purity(geometry.nearest(v, v, 15).select("query_id", "id"), v), "purity")


@query(f"""WITH {CEN}, e AS (SELECT (SELECT c FROM ce WHERE label = 0) AS a, (SELECT c FROM ce WHERE label = 1) AS b),
t AS (SELECT id, label, list_sum(list_transform(list_zip(v, a, b), lambda z: (z[1] - z[2]) * (z[3] - z[2]))) / list_sum(list_transform(list_zip(a, b), lambda z: (z[2] - z[1]) * (z[2] - z[1]))) AS t FROM ve CROSS JOIN e WHERE label IN (0, 1))
SELECT id, label, round(t, 6) AS t, CAST(least(greatest(floor(t * 10), 0), 9) AS INTEGER) AS bin FROM t""")
def met20_transition_axis(spark: SparkSession, d: str) -> DataFrame:
    return six(geometry.transition_axis(T.vectors(spark, d), 0, 1), "t")


@query(f"""WITH {CEN}, w AS (SELECT id, list(1 / pow(greatest({DIST.format('v', 'c')}, 1e-12), 2)) AS inv FROM ve CROSS JOIN ce GROUP BY id), u AS (SELECT list_transform(inv, lambda x: x / list_sum(inv)) AS u FROM w)
SELECT count(*) AS n, round(avg(list_max(u)), 6) AS mean_top, round(quantile_cont(list_max(u), 0.5), 6) AS median_top, round(avg(-list_sum(list_transform(u, lambda x: x * ln(greatest(x, 1e-12))))), 6) AS entropy, round(avg(list_sum(list_transform(u, lambda x: x * x))), 6) AS coefficient, max(list_max(u) - 1 / len(u)) < 1e-3 AS even FROM u""")
def clu11_membership(spark: SparkSession, d: str) -> DataFrame:
    v = T.vectors(spark, d)
    return six(geometry.membership_summary(geometry.memberships(v, geometry.centroids(v, "label").select("label", "centre"))), "mean_top", "median_top", "entropy", "coefficient")


@query(f"WITH {VE}, lo AS (SELECT id, unnest(v) AS x, unnest(range(len(v))) AS i FROM ve), s AS (SELECT id, i, (x - avg(x) OVER (PARTITION BY i)) / stddev_pop(x) OVER (PARTITION BY i) AS z FROM lo) SELECT id, round(sum(z * (i + 1)), 4) AS checksum FROM s GROUP BY id")
def mlt3_standardised(spark: SparkSession, d: str) -> DataFrame:
    s = geometry.standardised(T.vectors(spark, d))
    weigh = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return s.select("id", (F.round(weigh, 4) + F.lit(0.0)).alias("checksum"))


@query()
def inf2_clip_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return six(metrics.bootstrap(metrics.rolled(T.predictions(spark, d)), ["part", "target"]), "gain", "low", "high")


@query("""WITH g AS (SELECT lang, count(*) AS n, sum(quality) AS k FROM documents JOIN labels USING (doc_id) GROUP BY lang), w AS (SELECT *, 1.959963984540054 AS z, k / n AS p FROM g)
SELECT lang, n, round(((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) AS low, round(((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) AS high FROM w""")
def inf6_wilson(spark: SparkSession, d: str) -> DataFrame:
    j = T.table(spark, d, "documents").select("doc_id", "lang").join(T.table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("k"))
    return six(j.select("lang", "n", S.wilson(F.col("k"), F.col("n")).alias("w")).select("lang", "n", "w.*"), "low", "high")
