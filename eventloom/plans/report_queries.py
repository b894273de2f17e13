"""Queries behind reports: pairs of models, contrasts, curves, inclusion, purity, stability, samples, identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import fuzzy, geometry, metrics, reports
from ..sources import tables as T
from .common import LOSS, PR, VE, register
from .event_queries import six

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)
L0, L1 = LOSS("m0"), LOSS("m1")


# -- predictions


@query(f"""WITH {PR}, q AS (SELECT call_id, target, y, m0, m1, (m0 + m1) / 2 AS mc FROM pr),
x AS (SELECT 'all' AS comparison, y, m0 AS a, m1 AS b FROM q UNION ALL SELECT 'first', y, m0, mc FROM q UNION ALL SELECT 'second', y, mc, m1 FROM q)
SELECT comparison, count(*) AS n, round(avg({LOSS('a')} - {LOSS('b')}), 6) AS gain FROM x GROUP BY 1""")
def set8_model_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = T.predictions(spark, d).withColumn("mc", (F.col("m0") + F.col("m1")) / 2)
    t = reports.model_pairs(p, (("all", "m0", "m1"), ("first", "m0", "mc"), ("second", "mc", "m1")), ["y"])
    gain = S.log_loss(F.col("y"), F.col("left_p")) - S.log_loss(F.col("y"), F.col("right_p"))
    return six(t.groupBy("comparison").agg(F.count("*").alias("n"), F.avg(gain).alias("gain")), "gain")


FAM = "fm AS (SELECT call_id, target, y, 'base' AS family, m0, m1 FROM pr UNION ALL SELECT call_id, target, y, 'even', 0.5, (m0 + m1) / 2 FROM pr UNION ALL SELECT call_id, target, y, 'swap', m1, m0 FROM pr)"


def _families(spark: SparkSession, d: str) -> DataFrame:
    p = T.predictions(spark, d)
    each = F.array(
        F.struct(F.lit("base").alias("family"), F.col("m0").alias("a"), F.col("m1").alias("b")),
        F.struct(F.lit("even").alias("family"), F.lit(0.5).alias("a"), ((F.col("m0") + F.col("m1")) / 2).alias("b")),
        F.struct(F.lit("swap").alias("family"), F.col("m1").alias("a"), F.col("m0").alias("b")),
    )
    return p.select("call_id", "clip", "fold", "target", "y", F.explode(each).alias("x")).select("call_id", "clip", "fold", "target", "y", "x.family", F.col("x.a").alias("m0"), F.col("x.b").alias("m1"))


@query(f"""WITH {PR}, {FAM}, b AS (SELECT call_id, target, {L0} AS b0, {L1} AS b1 FROM fm WHERE family = 'base'), j AS (SELECT target, family, b0 - {L0} AS i0, b1 - {L1} AS i1 FROM fm JOIN b USING (call_id, target) WHERE family <> 'base')
SELECT target, family, count(*) AS n, round(avg(i0), 6) AS m0_improvement, round(avg(i1), 6) AS m1_improvement, round(avg(i1) - avg(i0), 6) AS delta_change FROM j GROUP BY 1, 2""")
def met9_contrasts(spark: SparkSession, d: str) -> DataFrame:
    return six(reports.contrasts(_families(spark, d), ["target"], "base"), "m0_improvement", "m1_improvement", "delta_change")


@query(f"""WITH {PR}, {FAM}, f AS (SELECT target, family, count(*) AS n, avg({L0} - {L1}) AS gain FROM fm GROUP BY 1, 2)
SELECT family, round(max(gain) FILTER (target = 'post'), 6) AS post, round(max(gain) FILTER (target = 'pre'), 6) AS pre, round(max(gain) FILTER (target = 'post') - max(gain) FILTER (target = 'pre'), 6) AS post_minus_pre FROM f GROUP BY 1""")
def set7_wide_models(spark: SparkSession, d: str) -> DataFrame:
    g = metrics.gains(_families(spark, d))
    side = lambda t: F.avg(F.when(F.col("target") == t, F.col("gain")))
    return six(g.groupBy("family").agg(side("post").alias("post"), side("pre").alias("pre"), (side("post") - side("pre")).alias("post_minus_pre")), "post", "pre", "post_minus_pre")


@query(f"""WITH {PR}, rl AS (SELECT *, unnest(['overall', label]) AS part FROM pr), s AS (SELECT part, target, m1, sum(y) AS p, count(*) AS n FROM rl GROUP BY ALL),
c AS (SELECT part, target, p, sum(p) OVER w AS tp, sum(n) OVER w AS nn FROM s WINDOW w AS (PARTITION BY part, target ORDER BY m1 DESC)), ap AS (SELECT part, target, sum(p * tp / nn) / nullif(sum(p), 0) AS ap FROM c GROUP BY ALL)
SELECT part, target, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, sum(y) < 20 AS sparse, round(avg({L0} - {L1}), 6) AS delta, round(any_value(ap), 6) AS ap FROM rl JOIN ap USING (part, target) GROUP BY 1, 2""")
def met7_point_metrics(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.rolled(T.predictions(spark, d))
    g = metrics.losses(r, ["part", "target"]).select("part", "target", "n", "positives", (F.col("positives") < 20).alias("sparse"), "delta")
    return six(g.join(metrics.ranking(r, ["part", "target"], "m1").select("part", "target", "ap"), ["part", "target"]), "delta", "ap")


@query(f"""WITH {PR}, f AS (SELECT target, fold, avg({L0} - {L1}) AS delta FROM pr GROUP BY 1, 2)
SELECT target, count(*) AS n, round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS sd, round(min(delta), 6) AS least, round(max(delta), 6) AS most FROM f GROUP BY 1""")
def agg21_fold_stability(spark: SparkSession, d: str) -> DataFrame:
    f = metrics.losses(T.predictions(spark, d), ["target", "fold"])
    return six(reports.stability(f, ["target"], "delta"), "mean", "sd", "least", "most")


@query(f"""WITH {PR}, f AS (SELECT target, fold, avg({L0} - {L1}) AS delta FROM pr GROUP BY 1, 2)
SELECT target, round(quantile_cont(delta, 0.5), 6) AS median, round(quantile_cont(delta, 0.75) - quantile_cont(delta, 0.25), 6) AS iqr FROM f GROUP BY 1""")
def agg42_middles(spark: SparkSession, d: str) -> DataFrame:
    return six(reports.middle(metrics.losses(T.predictions(spark, d), ["target", "fold"]), ["target"], "delta"), "median", "iqr")


@query(f"""WITH {PR}, c AS (SELECT target, clip, round(sum({L0} - {L1}), 9) AS g FROM pr GROUP BY 1, 2), r AS (SELECT *, greatest(g, 0) AS p, row_number() OVER (PARTITION BY target ORDER BY greatest(g, 0) DESC, clip) AS r FROM c)
SELECT target, count(*) AS clips, count_if(g > 0) AS positive_clips, round(sum(g), 6) AS net, round(sum(p), 6) AS positive_mass, {', '.join(f"round(coalesce(sum(p) FILTER (r <= {k}), 0) / nullif(sum(p), 0), 6) AS top{k}_share" for k in (1, 5, 10))} FROM r GROUP BY 1""")
def agg38_influence(spark: SparkSession, d: str) -> DataFrame:
    c = metrics.clip_blocks(T.predictions(spark, d), ["target"]).withColumn("gain_sum", F.round("gain_sum", 9))
    return six(reports.influence(c, ["target"], "gain_sum"), "net", "positive_mass", "top1_share", "top5_share", "top10_share")


@query(f"""WITH {PR}, c AS (SELECT target, clip, round(abs(sum({L0} - {L1})), 9) AS mass FROM pr GROUP BY 1, 2)
SELECT target, clip, round(row_number() OVER o / count(*) OVER w, 6) AS rows_share, round(sum(mass) OVER (o ROWS UNBOUNDED PRECEDING) / sum(mass) OVER w, 6) AS share FROM c WINDOW w AS (PARTITION BY target), o AS (PARTITION BY target ORDER BY mass DESC, clip)""")
def win8_lorenz(spark: SparkSession, d: str) -> DataFrame:
    c = metrics.clip_blocks(T.predictions(spark, d), ["target"]).select("target", "clip", F.round(F.abs("gain_sum"), 9).alias("mass"))
    return six(reports.lorenz(c, ["target"], "mass", "clip"), "rows_share", "share")


@query(f"""WITH {PR}, c AS (SELECT target, clip, sum({L0} - {L1}) AS g, count(*) AS n FROM pr GROUP BY 1, 2), t AS (SELECT a.clip, a.g AS p, b.g AS q FROM c a JOIN c b ON a.clip = b.clip AND a.target = 'post' AND b.target = 'pre')
SELECT clip, round(p - q, 6) AS direction, round((p - q) - sum(p - q) OVER () / count(*) OVER (), 6) AS against_mean FROM t""")
def agg36_directions(spark: SparkSession, d: str) -> DataFrame:
    c = metrics.clip_blocks(T.predictions(spark, d), ["target"])
    side = lambda t: F.max(F.when(F.col("target") == t, F.col("gain_sum")))
    t = c.groupBy("clip").agg((side("post") - side("pre")).alias("direction")).where("direction is not null")
    mean = t.agg(F.avg("direction").alias("m"))
    return six(t.join(F.broadcast(mean)).select("clip", "direction", (F.col("direction") - F.col("m")).alias("against_mean")), "direction", "against_mean")


@query(f"""WITH {PR} SELECT call_id, target, round(max(abs(m1 - y)), 6) AS wrong FROM pr GROUP BY call_id, target HAVING max(abs(m1 - y)) >= 0.9""")
def flt14_confident_errors(spark: SparkSession, d: str) -> DataFrame:
    wrong = F.abs(F.col("m1") - F.col("y"))
    return six(T.predictions(spark, d).where(wrong >= 0.9).select("call_id", "target", wrong.alias("wrong")), "wrong")


@query(f"""WITH {PR} SELECT 'repeated_keys' AS fault, count(*) AS n FROM (SELECT 1 FROM pr GROUP BY call_id, target HAVING count(*) > 1)
UNION ALL SELECT 'target_values', count_if(NOT coalesce(y IN (0, 1), false)) FROM pr UNION ALL SELECT 'probabilities', count_if(NOT coalesce(m0 BETWEEN 0 AND 1 AND m1 BETWEEN 0 AND 1, false)) FROM pr
UNION ALL SELECT 'clips_in_folds', count(*) FROM (SELECT 1 FROM pr GROUP BY clip HAVING count(DISTINCT fold) > 1) UNION ALL SELECT 'one_sided_calls', count(*) FROM (SELECT 1 FROM pr GROUP BY call_id HAVING count(DISTINCT target) < 2)""")
def wfl11_oof_faults(spark: SparkSession, d: str) -> DataFrame:
    return reports.oof_faults(T.predictions(spark, d))


# -- groups and clusters


@query("SELECT event_type, bin, n, round(n / sum(n) OVER (PARTITION BY event_type), 6) AS fraction FROM (SELECT event_type, user_id % 5 AS bin, count(*) AS n FROM events GROUP BY ALL)")
def agg23_coassignment(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events").select("event_type", (F.col("user_id") % 5).alias("bin"))
    return six(shared(e.groupBy("event_type", "bin").agg(F.count("*").alias("n")), "event_type"), "fraction")


def shared(df: DataFrame, by: str) -> DataFrame:
    """Adds each row's fraction of the counts under the same ``by``."""
    return df.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


NOISY = "nz AS (SELECT event_id, event_type AS label, CASE WHEN value < 20 THEN -1 ELSE user_id % 6 END AS cluster FROM events)"


def _noisy(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "events").select("event_id", F.col("event_type").alias("label"), F.when(F.col("value") < 20, -1).otherwise(F.col("user_id") % 6).cast("long").alias("cluster"))


@query(f"""WITH {NOISY}, c AS (SELECT label, cluster, count(*) AS n FROM nz GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label, cluster <> -1 ORDER BY n DESC, cluster) AS r FROM c)
SELECT label, CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (cluster <> -1), 0) AS BIGINT) AS clustered, count_if(cluster <> -1) AS clusters, CAST(coalesce(max(cluster) FILTER (cluster <> -1 AND r = 1), -1) AS BIGINT) AS largest,
coalesce(max(n) FILTER (cluster <> -1), 0) AS largest_n, round(coalesce(sum(n) FILTER (cluster <> -1), 0) / sum(n), 6) AS inclusion, round(coalesce(max(n) FILTER (cluster <> -1), 0) / sum(n), 6) AS largest_share FROM r GROUP BY label""")
def agg31_inclusion(spark: SparkSession, d: str) -> DataFrame:
    return six(reports.inclusion(_noisy(spark, d), "label", "cluster"), "inclusion", "largest_share")


@query(f"""WITH {NOISY}, c AS (SELECT cluster, label, count(*) AS n FROM nz WHERE cluster <> -1 GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY cluster) AS p FROM c),
a AS (SELECT cluster, sum(n) AS s, max(n) AS t, -sum(p * log2(p + 1e-12)) AS h FROM p GROUP BY 1), b AS (SELECT label, sum(n) AS s, max(n) AS t FROM c GROUP BY 1)
SELECT round(avg(t / s), 6) AS mean_purity, round(sum(t) / sum(s), 6) AS weighted_purity, round(sum(h * s) / sum(s), 6) AS label_entropy, (SELECT round(avg(t / s), 6) FROM b) AS mean_best_share FROM a""")
def met18_correspondence(spark: SparkSession, d: str) -> DataFrame:
    t = _noisy(spark, d).where("cluster <> -1")
    return six(reports.correspondence(t, "label", "cluster"), "mean_purity", "weighted_purity", "label_entropy", "mean_best_share")


@query("""WITH q AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT a.id AS query_id, b.id, row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.v, b.v), 9), b.id) AS r FROM q a JOIN q b ON a.id <> b.id AND a.id % 20 = 0),
c AS (SELECT a.label, b.label AS other, count(*) AS n FROM n JOIN q a ON a.id = query_id JOIN q b ON b.id = n.id WHERE r <= 10 GROUP BY ALL)
SELECT label, other, n, round(n / sum(n) OVER (PARTITION BY label), 6) AS fraction FROM c""")
def met16_mixing(spark: SparkSession, d: str) -> DataFrame:
    v = T.vectors(spark, d)
    return six(reports.mixing(geometry.nearest(v.where("id % 20 = 0"), v, 10), v.select("id", "label")), "fraction")


@query(f"WITH {NOISY} SELECT event_id, CASE WHEN cluster = -1 THEN -1 ELSE dense_rank() OVER (ORDER BY CASE WHEN cluster = -1 THEN NULL ELSE cluster END NULLS LAST) - 1 END AS cluster FROM (SELECT event_id, CASE WHEN cluster IN (1, 4) THEN -1 ELSE cluster END AS cluster FROM nz)")
def clu5_relabelled(spark: SparkSession, d: str) -> DataFrame:
    t = _noisy(spark, d).withColumn("cluster", F.when(F.col("cluster").isin(1, 4), -1).otherwise(F.col("cluster")))
    return reports.relabelled(t, "cluster").select("event_id", "cluster")


SOL = "so AS (SELECT k AS setting, event_id AS id, (user_id + CASE WHEN event_id % (k + 5) = 0 THEN 1 ELSE 0 END) % 4 AS cluster FROM events CROSS JOIN (VALUES (1), (2), (3)) x(k))"


@query(f"""WITH {SOL}, c AS (SELECT a.setting AS a, b.setting AS b, a.cluster AS ca, b.cluster AS cb, count(*) AS n FROM so a JOIN so b ON a.id = b.id AND a.setting < b.setting GROUP BY ALL),
x AS (SELECT a, b, CAST(sum(n) AS BIGINT) AS n, sum(n * (n - 1) / 2) AS o FROM c GROUP BY 1, 2), p AS (SELECT a, b, sum(m * (m - 1) / 2) AS p FROM (SELECT a, b, ca, sum(n) AS m FROM c GROUP BY ALL) GROUP BY 1, 2), q AS (SELECT a, b, sum(m * (m - 1) / 2) AS q FROM (SELECT a, b, cb, sum(n) AS m FROM c GROUP BY ALL) GROUP BY 1, 2)
SELECT a, b, n, round((o - p * q / (n * (n - 1) / 2)) / ((p + q) / 2 - p * q / (n * (n - 1) / 2)), 6) AS ari FROM x JOIN p USING (a, b) JOIN q USING (a, b)""")
def clu3_solution_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events").select("event_id", "user_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("setting"))
    t = e.select("setting", F.col("event_id").alias("id"), ((F.col("user_id") + F.when(F.col("event_id") % (F.col("setting") + 5) == 0, 1).otherwise(0)) % 4).alias("cluster"))
    return six(reports.solution_pairs(t), "ari")


def _fuzzy_start(v: DataFrame) -> list[list[float]]:
    return fuzzy.first_centres(v)


@query()
def clu9_fuzzy_fit(spark: SparkSession, d: str) -> DataFrame:
    v = T.vectors(spark, d)
    centres, _ = fuzzy.fit(v, _fuzzy_start(v), rounds=10)
    t = fuzzy.assigned(v, centres)
    return t.select("id", "label", (F.array_position("u", F.array_max("u")) - 1).alias("winner"), F.array_max("u").alias("top"))


@query()
def clu10_fuzzy_trace(spark: SparkSession, d: str) -> DataFrame:
    v = T.vectors(spark, d)
    _, trace = fuzzy.fit(v, _fuzzy_start(v), rounds=10)
    return spark.createDataFrame([(t["round"], t["objective"], t["moved"]) for t in trace], "round int, objective double, moved double")


@query(f"""WITH {VE}, u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM ve) SELECT label, CAST(k - 1 AS INTEGER) AS dim, round(avg(x), 6) AS mean FROM u GROUP BY 1, 2""")
def agg41_mean_by_label(spark: SparkSession, d: str) -> DataFrame:
    return six(T.vectors(spark, d).select("label", F.posexplode("v").alias("dim", "x")).groupBy("label", "dim").agg(F.avg("x").alias("mean")), "mean")


# -- samples, sets, joins, quality


@query("""WITH c AS (SELECT l_linestatus = 'O' AS side, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY n DESC, v) AS r FROM c)
SELECT side, CAST(sum(n) AS BIGINT) AS size, count(v) AS "values", max(v) FILTER (r = 1) AS top, round(max(n) / sum(n), 6) AS top_share, string_agg(v || ':' || n, ';' ORDER BY n DESC, v) FILTER (r <= 5) AS top5 FROM r GROUP BY side""")
def agg29_categories(spark: SparkSession, d: str) -> DataFrame:
    return six(reports.categories(T.table(spark, d, "lineitem"), F.col("l_linestatus") == "O", "l_returnflag"), "top_share")


@query("SELECT user_id % 3 AS g, event_type, count(*) AS n, count_if(value >= 10) AS valid, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2")
def agg17_quality(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events").groupBy((F.col("user_id") % 3).alias("g"), "event_type")
    return six(e.agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 10).alias("valid"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.min("value").alias("least"), F.max("value").alias("most")), "mean", "median")


@query("SELECT event_type, value >= 10 AS valid, count(*) AS n, round(avg(value), 6) AS mean, round(count(*) / sum(count(*)) OVER (PARTITION BY event_type), 6) AS fraction FROM events GROUP BY 1, 2")
def agg19_retention(spark: SparkSession, d: str) -> DataFrame:
    g = T.table(spark, d, "events").groupBy("event_type", (F.col("value") >= 10).alias("valid")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return six(shared(g, "event_type"), "mean", "fraction")


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY sha256('1|' || event_id), event_id) <= 25 AND value > 5 AS taken FROM events)
SELECT event_type, count(*) AS available, count_if(taken) AS selected, round(avg(value) FILTER (taken), 6) AS mean, min(value) FILTER (taken) AS least, max(value) FILTER (taken) AS most FROM s GROUP BY 1""")
def agg44_sample_summary(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events").select("event_id", "event_type", "value")
    s = reports.exact_sample(e, ["event_type"], 25, "event_id").where("value > 5").groupBy("event_type").agg(F.count("*").alias("selected"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    g = e.groupBy("event_type").agg(F.count("*").alias("available")).join(s, "event_type", "left")
    return six(g.na.fill(0, ["selected"]), "mean")


@query("SELECT event_id, fold FROM (SELECT event_id, user_id % 5 AS fold, row_number() OVER (PARTITION BY user_id % 5 ORDER BY sha256('3|' || event_id), event_id) AS r FROM events) WHERE r <= 40")
def smp2_exact_sample(spark: SparkSession, d: str) -> DataFrame:
    return reports.exact_sample(T.table(spark, d, "events").select("event_id", (F.col("user_id") % 5).alias("fold")), ["fold"], 40, "event_id", 3)


@query("SELECT event_id, event_type, CAST((row_number() OVER (PARTITION BY event_type ORDER BY sha256('1|' || event_id), event_id) - 1) % 5 + 1 AS INTEGER) AS fold FROM events")
def spl3_stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return reports.stratified_folds(T.table(spark, d, "events"), "event_type", "event_id", 5)


@query("WITH a AS (SELECT DISTINCT doc_id FROM documents), b AS (SELECT DISTINCT doc_id FROM labels) SELECT count_if(b.doc_id IS NULL) AS left_only, count_if(a.doc_id IS NULL) AS right_only, count_if(a.doc_id = b.doc_id) AS both FROM a FULL JOIN b ON a.doc_id = b.doc_id")
def set4_set_equality(spark: SparkSession, d: str) -> DataFrame:
    return reports.set_difference(T.table(spark, d, "documents"), T.table(spark, d, "labels"), "doc_id")


@query("""SELECT c.c_custkey AS id, count(DISTINCT o_orderpriority) AS shared FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY 1 HAVING count(*) >= 3""")
def srt8_distinct_values(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("shared")).where("n >= 3")
    return o.join(T.table(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id").select("id", "shared")


VALUES_SQL = "vl AS (SELECT DISTINCT CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN 'call' || event_id WHEN 2 THEN '/data/x/' || user_id || '.wav' ELSE 'none' END AS value FROM events)"


@query(f"""WITH {VALUES_SQL}, c AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS clip FROM events), a AS (SELECT DISTINCT 'call' || event_id AS call_id, CAST(user_id AS VARCHAR) AS clip FROM events)
SELECT value, clip, 'clip' AS how FROM vl JOIN c ON value = clip UNION ALL SELECT value, a.clip, 'call' FROM vl JOIN a ON value = call_id UNION ALL SELECT value, clip, 'path' FROM vl JOIN c ON value = '/data/x/' || clip || '.wav'""")
def jon15_identified(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("clip"))
    call = F.concat(F.lit("call"), F.col("event_id").cast("string"))
    m = F.col("event_id") % 4
    value = F.when(m == 0, F.col("clip")).when(m == 1, call).when(m == 2, F.concat(F.lit("/data/x/"), "clip", F.lit(".wav"))).otherwise("none")
    return reports.identified(e.select(value.alias("value")), e.select("clip"), e.select(call.alias("call_id"), "clip"))


@query(f"""WITH {PR}, g AS (SELECT fold, target, count(*) AS n_test, CAST(sum(call_id) AS BIGINT) AS ids FROM pr WHERE fold IS NOT NULL GROUP BY ALL)
SELECT 'fold' || fold || '/' || target AS path, fold, target, n_test, CAST(sum(n_test) OVER (PARTITION BY target) AS BIGINT) - n_test AS n_train, ids, row_number() OVER (ORDER BY target, fold) AS job FROM g""")
def wfl4_job_plan(spark: SparkSession, d: str) -> DataFrame:
    """A job for each fold and target of a table, with what it trains on and tests, and a sum of the tested ids."""
    p = T.predictions(spark, d).where("fold is not null")
    g = p.groupBy("fold", "target").agg(F.count("*").alias("n_test"), F.sum("call_id").alias("ids"))
    train = F.sum("n_test").over(Window.partitionBy("target")) - F.col("n_test")  # a row a job
    path = F.concat(F.lit("fold"), F.col("fold").cast("string"), F.lit("/"), "target")
    return g.select(path.alias("path"), "fold", "target", "n_test", train.alias("n_train"), "ids", F.row_number().over(Window.orderBy("target", "fold")).cast("long").alias("job"))


@query("WITH m AS (SELECT quantile_cont(value, 0.5) FILTER (value < 90) AS md FROM events) SELECT event_id, round(CASE WHEN value < 90 THEN value ELSE md END, 6) AS filled FROM events, m")
def mlt2_median_filled(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events").select("event_id", F.when(F.col("value") < 90, F.col("value")).alias("filled"), F.lit(None).cast("double").alias("void"))
    return six(reports.median_filled(e, ["filled", "void"]), "filled")


@query("""WITH a AS (SELECT value / (SELECT max(value) FROM events) AS t, user_id % 4 AS k FROM events) SELECT CAST(least(greatest(ceil(least(greatest(t, 0), 1) * 10) - 1, 0), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(t), 6) AS axis_mean, round(avg(k), 6) AS k_mean FROM a GROUP BY 1""")
def win10_binned_means(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events")
    t = e.select("value", (F.col("user_id") % 4).alias("k")).join(F.broadcast(e.agg(F.max("value").alias("m")))).select((F.col("value") / F.col("m")).alias("t"), "k")
    return six(reports.binned_means(t, "t", 10, ["k"]), "axis_mean", "k_mean")
