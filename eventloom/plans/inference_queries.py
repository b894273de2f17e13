"""Queries on resampling with shared weights, generated outcomes, agreement beyond chance, matching, silhouettes, and further models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import geometry, inference, metrics, mixture, models
from ..sources import tables as T
from ..sources.shared import written
from .common import LOSS, PR, VE, register
from .event_queries import six
from .model_queries import _design, _refolded

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)
DRAWS = 100
U = lambda x: f"CAST('0x' || substr(md5({x}), 1, 13) AS BIGINT) / 4503599627370496.0"

#: Clip weights of every draw, gains of clips, and the weighted means of all arms.
BOOT = f"""{PR}, cl AS (SELECT clip, row_number() OVER (ORDER BY CAST('0x' || substr(md5(CAST(clip AS VARCHAR)), 1, 13) AS BIGINT)) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT clip FROM pr WHERE clip IS NOT NULL)),
wt AS (SELECT draw, CAST(floor({U("'1|' || draw || '|' || place")} * n) AS BIGINT) AS taken FROM cl CROSS JOIN range({DRAWS}) r(draw)), wc AS (SELECT draw, cl.clip, count(*) AS w FROM wt JOIN cl ON taken = place GROUP BY ALL),
rl AS (SELECT *, unnest(['overall', label]) AS part FROM pr), vw AS (SELECT *, unnest(CASE WHEN valid THEN ['all', 'valid'] ELSE ['all', 'rejected'] END) AS view FROM pr)"""
GAIN = f"({LOSS('m0')} - {LOSS('m1')})"


def _drawn_sql(table: str, *by: str) -> str:
    keys = ", ".join(by)
    return f"""bk AS (SELECT {keys}, clip, count(*) AS n, sum({GAIN}) AS g FROM {table} WHERE clip IS NOT NULL GROUP BY ALL),
dw AS (SELECT {keys}, draw, sum(w * g) / sum(w * n) AS x FROM bk JOIN wc USING (clip) GROUP BY ALL UNION ALL SELECT {keys}, -1, sum(g) / sum(n) FROM bk GROUP BY ALL)"""


def _interval_sql(table: str, *by: str) -> str:
    return f"SELECT {', '.join(by)}, round(max(x) FILTER (WHERE draw < 0), 6) AS point, round(quantile_cont(x, 0.025) FILTER (WHERE draw >= 0), 6) AS low, round(quantile_cont(x, 0.975) FILTER (WHERE draw >= 0), 6) AS high, count(x) FILTER (WHERE draw >= 0) AS draws, round(avg(CAST(x > 0 AS INTEGER)) FILTER (WHERE draw >= 0), 6) AS above FROM {table} GROUP BY ALL"


def _intervals(drawn: DataFrame, *by: str) -> DataFrame:
    return six(inference.intervals(drawn, by), "point", "low", "high", "above")


@query(f"WITH {BOOT}, {_drawn_sql('rl', 'part', 'target')} {_interval_sql('dw', 'part', 'target')}")
def inf1_paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Gains of every arm under clip weights that all arms share, with points and 95 % ranges."""
    return _intervals(inference.drawn_gains(metrics.rolled(T.predictions(spark, d)), ["part", "target"], DRAWS), "part", "target")


@query(f"WITH {BOOT}, {_drawn_sql('rl', 'part', 'target')}, ch AS (SELECT a.part, a.target, a.draw, a.x - b.x AS x FROM dw a JOIN dw b ON a.part IS NOT DISTINCT FROM b.part AND a.draw = b.draw WHERE a.target <> 'pre' AND b.target = 'pre') {_interval_sql('ch', 'part', 'target')}")
def inf5_paired_changes(spark: SparkSession, d: str) -> DataFrame:
    """Each arm less the base arm, draw by draw."""
    x = inference.drawn_gains(metrics.rolled(T.predictions(spark, d)), ["part", "target"], DRAWS)
    return _intervals(inference.paired_changes(x, ["part"], "target", "pre"), "part", "target")


@query(f"""WITH {BOOT}, oa AS (SELECT * EXCLUDE (m1, arms), arms.arm AS arm, arms.p AS m1 FROM (SELECT *, unnest([{{'arm': 'standard', 'p': m1}}, {{'arm': 'oracle', 'p': (m1 + y) / 2.0}}]) AS arms FROM pr)),
{_drawn_sql('oa', 'target', 'arm')}, ch AS (SELECT a.target, a.arm, a.draw, a.x - b.x AS x FROM dw a JOIN dw b ON a.target = b.target AND a.draw = b.draw WHERE a.arm = 'oracle' AND b.arm = 'standard') {_interval_sql('ch', 'target', 'arm')}""")
def inf3_oracle_change(spark: SparkSession, d: str) -> DataFrame:
    """What an arm that knows part of the outcome gains beyond the standard one, over all rows, under the same draws."""
    arms = F.array(F.struct(F.lit("standard").alias("arm"), F.col("m1").alias("p")), F.struct(F.lit("oracle").alias("arm"), ((F.col("m1") + F.col("y")) / 2).alias("p")))
    p = T.predictions(spark, d).withColumn("x", F.explode(arms)).withColumns({"arm": F.col("x.arm"), "m1": F.col("x.p")}).drop("x")
    x = inference.drawn_gains(p, ["target", "arm"], DRAWS)
    return _intervals(inference.paired_changes(x, ["target"], "arm", "standard"), "target", "arm")


@query(f"""WITH {BOOT}, {_drawn_sql('rl', 'part', 'target')}, ch AS (SELECT a.part, a.target, a.draw, a.x - b.x AS x FROM dw a JOIN dw b ON a.part IS NOT DISTINCT FROM b.part AND a.draw = b.draw WHERE a.target <> 'pre' AND b.target = 'pre'),
iv AS ({_interval_sql('dw', 'part', 'target')}), ic AS ({_interval_sql('ch', 'part', 'target')})
SELECT iv.part, iv.target, iv.point, iv.low, iv.high, ic.point AS change, ic.low AS change_low, ic.high AS change_high FROM iv LEFT JOIN ic ON iv.part IS NOT DISTINCT FROM ic.part AND iv.target = ic.target""")
def inf8_summary(spark: SparkSession, d: str) -> DataFrame:
    """Points and ranges of each arm beside its change from the base arm."""
    x = inference.drawn_gains(metrics.rolled(T.predictions(spark, d)), ["part", "target"], DRAWS)
    own = inference.intervals(x, ["part", "target"]).select("part", "target", "point", "low", "high")
    change = inference.intervals(inference.paired_changes(x, ["part"], "target", "pre"), ["part", "target"])
    change = change.select(F.col("part").alias("p"), F.col("target").alias("t"), F.col("point").alias("change"), F.col("low").alias("change_low"), F.col("high").alias("change_high"))
    out = own.join(change, F.col("part").eqNullSafe(F.col("p")) & (F.col("target") == F.col("t")), "left").drop("p", "t")
    return six(out, "point", "low", "high", "change", "change_low", "change_high")


@query(f"WITH {BOOT}, {_drawn_sql('vw', 'target', 'view')}, ch AS (SELECT a.target, a.view, a.draw, a.x - b.x AS x FROM dw a JOIN dw b ON a.target = b.target AND a.draw = b.draw WHERE a.view <> 'all' AND b.view = 'all' UNION ALL SELECT target, 'gain of ' || view, draw, x FROM dw) {_interval_sql('ch', 'target', 'view')}")
def inf4_population_parts(spark: SparkSession, d: str) -> DataFrame:
    """Gains over all, valid and rejected rows, and what the parts differ by from all, under the same draws."""
    p = T.predictions(spark, d)
    v = p.withColumn("view", F.explode(F.array(F.lit("all"), F.when(F.coalesce("valid", F.lit(False)), "valid").otherwise("rejected"))))
    x = inference.drawn_gains(v, ["target", "view"], DRAWS)
    change = inference.paired_changes(x, ["target"], "view", "all")
    named = x.withColumn("view", F.concat(F.lit("gain of "), F.col("view")))
    return _intervals(change.unionByName(named), "target", "view")


@query(f"WITH {BOOT}, {_drawn_sql('rl', 'part', 'target')}, iv AS ({_interval_sql('dw', 'part', 'target')}) SELECT target, count(*) AS n, count_if(low > 0) AS found, round(avg(CAST(low > 0 AS INTEGER)), 6) AS rate, round(avg(above), 6) AS mean_above FROM iv GROUP BY target")
def inf7_detection_rates(spark: SparkSession, d: str) -> DataFrame:
    """In how many parts the range of an arm's gain lies above 0."""
    i = _intervals(inference.drawn_gains(metrics.rolled(T.predictions(spark, d)), ["part", "target"], DRAWS), "part", "target")
    g = i.groupBy("target").agg(F.count("*").alias("n"), F.count_if(F.col("low") > 0).alias("found"), F.avg((F.col("low") > 0).cast("double")).alias("rate"), F.avg("above").alias("mean_above"))
    return six(g, "rate", "mean_above")


@query(f"""WITH {PR}, q AS (SELECT *, unnest(['overall', label]) AS part, (m0 + m1) / 2 AS mc FROM pr), g AS (SELECT part, target, avg({LOSS('m0')} - {LOSS('m1')}) AS total, avg({LOSS('m0')} - {LOSS('mc')}) AS config, avg({LOSS('mc')} - {LOSS('m1')}) AS remaining FROM q GROUP BY ALL)
SELECT part, target, round(total, 6) AS total, round(config, 6) AS config, round(remaining, 6) AS remaining, round(config / nullif(total, 0), 4) AS share FROM g""")
def inf9_block_effects(spark: SparkSession, d: str) -> DataFrame:
    p = metrics.rolled(T.predictions(spark, d)).withColumns({"mc": (F.col("m0") + F.col("m1")) / 2, "mr": F.lit(0.5)})
    g = metrics.decomposed(p).groupBy("part", "target").agg(*(F.avg(c).alias(c) for c in ("total", "config", "remaining")))
    return six(g.withColumn("share", F.round(S.ratio(F.col("config"), F.col("total")), 4)), "total", "config", "remaining")


# -- agreement, matching, silhouettes

MARGINS = f"""{VE}, c AS (SELECT label AS a, cluster AS b, count(*) AS n FROM ve GROUP BY ALL), ra AS (SELECT a, sum(n)::DOUBLE AS na FROM c GROUP BY a), rb AS (SELECT b, sum(n)::DOUBLE AS nb FROM c GROUP BY b), t AS (SELECT sum(n)::DOUBLE AS t FROM c)"""


@query(f"""WITH {MARGINS}, e AS (SELECT t, na, nb, unnest(range(CAST(greatest(1, na + nb - t) AS BIGINT), CAST(least(na, nb) AS BIGINT) + 1)) AS k FROM ra CROSS JOIN rb CROSS JOIN t),
x AS (SELECT sum(k / t * ln(t * k / (na * nb)) * exp(lgamma(na + 1) + lgamma(nb + 1) + lgamma(t - na + 1) + lgamma(t - nb + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(na - k + 1) - lgamma(nb - k + 1) - lgamma(t - na - nb + k + 1))) AS emi FROM e),
m AS (SELECT sum(n / t * ln(n * t / (na * nb))) AS mi FROM c JOIN ra USING (a) JOIN rb USING (b) CROSS JOIN t), h AS (SELECT (SELECT -sum(na / t * ln(na / t)) FROM ra, t) AS ha, (SELECT -sum(nb / t * ln(nb / t)) FROM rb, t) AS hb)
SELECT round(mi, 6) AS mi, round(emi, 6) AS emi, round((mi - emi) / ((ha + hb) / 2 - emi), 6) AS ami FROM m, x, h""")
def met11_adjusted_information(spark: SparkSession, d: str) -> DataFrame:
    return six(inference.adjusted_information(T.vectors(spark, d), "label", "cluster"), "mi", "emi", "ami")


@query(f"""WITH {MARGINS}, f AS (SELECT x.a, y.b, coalesce(c.n, 0) AS n FROM ra x CROSS JOIN rb y LEFT JOIN c ON c.a = x.a AND c.b = y.b)
SELECT CAST(max(p.n + q.n + r.n + s.n) AS BIGINT) AS matched, round(max(p.n + q.n + r.n + s.n) / (SELECT t FROM t), 6) AS share FROM (SELECT * FROM f WHERE b = 0) p JOIN (SELECT * FROM f WHERE b = 1) q ON q.a <> p.a JOIN (SELECT * FROM f WHERE b = 2) r ON r.a NOT IN (p.a, q.a) JOIN (SELECT * FROM f WHERE b = 3) s ON s.a NOT IN (p.a, q.a, r.a)""")
def met13_matching(spark: SparkSession, d: str) -> DataFrame:
    """Rows that the best one-to-one matching of labels and clusters keeps."""
    v = T.vectors(spark, d)
    n = v.agg(F.count("*").alias("all_n"))
    m = inference.matched(v, "label", "cluster").agg(F.sum("n").alias("matched"))
    return six(m.join(F.broadcast(n)).select("matched", S.ratio(F.col("matched"), F.col("all_n")).alias("share")), "share")


DIST = "sqrt(list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


@query(f"""WITH {VE}, dd AS (SELECT a.id, a.cluster AS g, b.cluster AS o, {DIST.format('a.v', 'b.v')} AS dist FROM ve a JOIN ve b ON true), s AS (SELECT id, g, o, sum(dist) AS far, count(*) AS n FROM dd GROUP BY ALL),
r AS (SELECT id, g, max(far) FILTER (WHERE o = g) / nullif(max(n) FILTER (WHERE o = g) - 1, 0) AS i, min(far / n) FILTER (WHERE o <> g) AS e FROM s GROUP BY ALL)
SELECT g AS cluster, count(*) AS n, round(avg(coalesce((e - i) / greatest(e, i), 0)), 6) AS silhouette FROM r GROUP BY g""")
def met14_silhouette(spark: SparkSession, d: str) -> DataFrame:
    s = inference.silhouettes(T.vectors(spark, d), "cluster")
    return six(s.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("s").alias("silhouette")), "silhouette")


# -- generated outcomes

COV = """z AS (SELECT doc_id, source, (ln(1 + n_chars) - avg(ln(1 + n_chars)) OVER ()) / stddev_pop(ln(1 + n_chars)) OVER () AS a, (quality - avg(quality) OVER ()) / stddev_pop(quality) OVER () AS b FROM documents JOIN labels USING (doc_id))"""


def _covariates(spark: SparkSession, d: str) -> DataFrame:
    docs = T.table(spark, d, "documents").select("doc_id", "source", F.log1p("n_chars").alias("a"))
    t = docs.join(T.table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("b")), "doc_id")
    return inference.zscored(t, ["a", "b"]).select(F.col("doc_id").alias("call_id"), F.col("source").alias("clip"), "a", "b")


@query(f"WITH {COV} SELECT doc_id AS call_id, round(a, 6) AS a, round(b, 6) AS b FROM z")
def mlt16_covariates(spark: SparkSession, d: str) -> DataFrame:
    return six(_covariates(spark, d).select("call_id", "a", "b"), "a", "b")


NORMAL = f"(sqrt(-2 * ln(greatest({U(chr(39) + 'u|1|clip|' + chr(39) + ' || source')}, 1e-12))) * cos(2 * pi() * {U(chr(39) + 'v|1|clip|' + chr(39) + ' || source')}))"


@query(f"WITH {COV} SELECT doc_id AS call_id, round(0.4 * a + 0.6 * a * b + 0.5 * {NORMAL}, 6) AS score FROM z WHERE source IS NOT NULL")
def dgp6_scores(spark: SparkSession, d: str) -> DataFrame:
    t = _covariates(spark, d).where("clip is not null")
    return six(inference.scores(t, "a", "b", inference.SCENARIOS["joint"], 1).select("call_id", "score"), "score")


@query()
def dgp1_generated(spark: SparkSession, d: str) -> DataFrame:
    """By scenario and target: mean probability (the rate asked for) and rate of the drawn outcomes."""
    g = inference.generated(_covariates(spark, d), "a", "b", {"post": 0.3, "pre": 0.1})
    return six(g.groupBy("scenario", "target").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate")), "mean_p", "rate")


@query()
def dgp2_one_sided(spark: SparkSession, d: str) -> DataFrame:
    """An outcome that has nothing to do with the covariate, and one that is linear in it: how far they go with it."""
    g = inference.one_sided(_covariates(spark, d), "a", "b", 0.25)
    return six(g.groupBy("target").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.corr("a", "p").alias("along")), "mean_p", "along")


@query(f"WITH {COV}, n AS (SELECT count(*) AS n FROM z) SELECT rate, n, rate AS reached FROM n, (VALUES (0.1), (0.3), (0.5)) t(rate)")
def dgp3_intercepts(spark: SparkSession, d: str) -> DataFrame:
    """The number to add to all scores so that their mean probability is a rate: what it reaches."""
    t = inference.scores(_covariates(spark, d), "a", "b", (0.8, 0.0, 0.0, 0.0), 1).select("score")
    t, out = written(t, "dgp3-scores"), None
    for rate in (0.1, 0.3, 0.5):
        p = inference.expit(F.col("score") + F.lit(inference.intercept(t, "score", rate)))
        part = t.agg(F.count("*").alias("n"), F.round(F.avg(p), 6).alias("reached")).withColumn("rate", F.lit(rate))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {COV} SELECT doc_id AS call_id, source AS clip, a_new AS a FROM (SELECT doc_id, source, 1.5 AS a_new FROM z)")
def dgp5_materialised(spark: SparkSession, d: str) -> DataFrame:
    c = _covariates(spark, d).withColumn("y", F.lit(1)).drop("b")
    packet = c.select("call_id", F.lit(1.5).alias("a"))
    return inference.materialised(c, packet, ["a"]).select("call_id", "clip", "a")


# -- models


@query(f"WITH {PR}, n AS (SELECT fold, count(*) AS n, sum(y) AS k FROM pr WHERE target = 'post' GROUP BY fold), c AS (SELECT fold, (sum(k) OVER () - k) / (sum(n) OVER () - n) AS cut FROM n), g AS (SELECT y, CAST(m1 >= cut AS INTEGER) AS g FROM pr JOIN c USING (fold) WHERE target = 'post'),"
       " t AS (SELECT count_if(y = 1 AND g = 1) AS tp, count_if(y = 0 AND g = 1) AS fp, count_if(y = 0 AND g = 0) AS tn, count_if(y = 1 AND g = 0) AS fn FROM g)"
       " SELECT tp, fp, tn, fn, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) AS macro_f1 FROM t")
def fit2_prevalence_threshold(spark: SparkSession, d: str) -> DataFrame:
    p = T.predictions(spark, d).where("target = 'post'")
    return six(models.threshold_scores(p, "m1"), "balanced_accuracy", "macro_f1")


def _spline_sql() -> str:
    """The basis by its recursion, one CTE a degree."""
    low, high, knots, degree = 0.0, 100.0, 5, 3
    step = (high - low) / (knots - 1)
    at = [low + step * (k - degree) for k in range(knots + 2 * degree)]
    inner = degree + knots - 2
    ctes = ["b0 AS (SELECT event_id, least(greatest(value, 0), 100) AS x, " + ", ".join(f"CAST(least(greatest(value, 0), 100) >= {at[k]} AND least(greatest(value, 0), 100) {'<=' if k == inner else '<'} {at[k + 1]} AND {k} <= {inner} AS INTEGER) AS c{k}" for k in range(len(at) - 1)) + " FROM events)"]
    for d in range(1, degree + 1):
        ctes.append(f"b{d} AS (SELECT event_id, x, " + ", ".join(f"(x - ({at[k]})) / {at[k + d] - at[k]} * c{k} + ({at[k + d + 1]} - x) / {at[k + d + 1] - at[k + 1]} * c{k + 1} AS c{k}" for k in range(len(at) - d - 1)) + f" FROM b{d - 1})")
    return "WITH " + ", ".join(ctes) + " SELECT event_id, " + ", ".join(f"round(c{k}, 6) AS s{k}" for k in range(knots + degree - 1)) + f" FROM b{degree}"


@query(_spline_sql())
def mlt7_spline_basis(spark: SparkSession, d: str) -> DataFrame:
    """Cubic splines with five uniform knots; beyond the ends the end's value."""
    columns = models.spline_columns(F.col("value"), 0.0, 100.0)
    t = T.table(spark, d, "events").select("event_id", *(c.alias(f"s{k}") for k, c in enumerate(columns)))
    return six(t, *(f"s{k}" for k in range(len(columns))))


CVROWS = f"""{PR}, x AS (SELECT fold, ln(1 + n_chars) AS a, CAST(n_chars AS DOUBLE) AS b FROM pr JOIN documents ON doc_id = call_id WHERE target = 'post' AND fold IS NOT NULL), f AS (SELECT DISTINCT fold FROM x), l AS (SELECT f.fold, u.name, u.x FROM f JOIN x ON x.fold <> f.fold, LATERAL (VALUES ('log_chars', a), ('n_chars', b)) u(name, x))"""


@query(f"WITH {CVROWS} SELECT fold, name, round(quantile_cont(x, 0.5), 6) AS median, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd, count(*) AS n FROM l GROUP BY ALL")
def mlt13_transform_state(spark: SparkSession, d: str) -> DataFrame:
    """What each fold's imputation and scaling learned, recomputed from the other folds' rows."""
    p = T.predictions(spark, d).where("target = 'post' and fold is not null").select("call_id", "fold")
    docs = T.table(spark, d, "documents").select(F.col("doc_id").alias("call_id"), F.log1p("n_chars").alias("log_chars"), F.col("n_chars").cast("double").alias("n_chars"))
    return six(models.transform_state(p.join(docs, "call_id"), ["log_chars", "n_chars"]), "median", "mean", "sd")


@query()
def mlt8_boosted_trees(spark: SparkSession, d: str) -> DataFrame:
    """Held-out losses of 40 boosted trees with and without the extra columns."""
    from ..operators import cohort

    x = _design(spark, d)
    folds = cohort.group_folds(x, "clip", 2).select("clip", F.col("fold").alias("cv"))
    oof = models.paired_cv(_refolded(x, folds), ["log_chars"], ["chars", "words"], ["label"], trees=40)
    return six(models.pooled(oof), "loss0", "loss1", "delta")


@query()
def clu7_mixture_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Bayes criteria of mixtures of 1 to 12 parts with diagonal covariances, over all components of the vectors."""
    v = written(T.vectors(spark, d).select("v"), "clu7-vectors")
    return six(mixture.criteria(v, range(1, 13)), "log_likelihood", "bic")


@query()
def clu7_full_mixture_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The same of 1 to 4 parts with full covariances."""
    v = written(T.vectors(spark, d).select("v"), "clu7-vectors")
    return six(mixture.criteria(v, range(1, 5), "full"), "log_likelihood", "bic")


@query()
def clu8_mixture_posteriors(spark: SparkSession, d: str) -> DataFrame:
    """Soft clusters from three parts with full covariances, the best of five starts: by winner, rows, mean probability and mean entropy."""
    v = written(T.vectors(spark, d).select("id", "label", "v"), "clu8-vectors")
    _, best, _ = mixture.fitted(v, [3], "full", restarts=5)
    if not best:
        return spark.createDataFrame([], "winner int, n long, probability double, entropy double")
    u = mixture.posteriors(v, best[3])
    return six(u.groupBy("winner").agg(F.count("*").alias("n"), F.avg(F.array_max("u")).alias("probability"), F.avg(S.entropy(F.col("u"))).alias("entropy")), "probability", "entropy")


@query(f"WITH {VE}, s AS (SELECT id, cluster AS a, CASE WHEN substr(sha256('5|' || id), 1, 1) < 'c' THEN label % 4 END AS b FROM ve) SELECT count(*) AS n, round(avg(CAST(a = b AS INTEGER)), 6) AS same FROM s WHERE b IS NOT NULL")
def clu4_subsample(spark: SparkSession, d: str) -> DataFrame:
    """Two solutions over the items of a subsample drawn by hash."""
    v = T.vectors(spark, d)
    s = v.where(F.substring(S.seeded(5, F.col("id")), 1, 1) < "c")
    return six(s.agg(F.count("*").alias("n"), F.avg((F.col("cluster") == F.col("label") % 4).cast("double")).alias("same")), "same")


@query()
def clu4_refit_stability(spark: SparkSession, d: str) -> DataFrame:
    """Mixtures of three parts fitted on all vectors and on a subsample by hash: how far their clusters of the subsample agree."""
    v = written(T.vectors(spark, d).select("id", "v"), "clu4-vectors")
    some = v.where(F.substring(S.seeded(5, F.col("id")), 1, 1) < "c")
    (_, whole, _), (_, part, _) = (mixture.fitted(x, [3], restarts=3) for x in (v, some))
    if not part:
        return spark.createDataFrame([], "n long, ari double, nmi double, purity double, pair_agreement double, same_kept double")
    both = mixture.posteriors(mixture.posteriors(some, whole[3]).select("id", "v", F.col("winner").alias("a")), part[3]).select("a", F.col("winner").alias("b"))
    both = written(both, "clu4-clusters")
    agreement = metrics.agreement(both, "a", "b")
    return six(agreement.join(F.broadcast(both.agg(F.count("*").alias("n")))), *agreement.columns)  # one row each


@query(f"""WITH {VE}, lo AS (SELECT id, unnest(v) AS x, unnest(range(len(v))) AS i FROM ve), s AS (SELECT id, i, (x - avg(x) OVER (PARTITION BY i)) / stddev_pop(x) OVER (PARTITION BY i) AS z FROM lo) SELECT id, round(sqrt(sum(z * z)), 6) AS length FROM s GROUP BY id""")
def mlt10_prepared_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Infinite cells become missing, missing ones their column's median, and columns are scaled."""
    v = T.vectors(spark, d)
    s = geometry.standardised(v.select("id", F.transform("v", lambda x: F.when(F.abs(x) != float("inf"), x)).alias("v")))
    return six(s.select("id", F.sqrt(geometry.dot(F.col("v"), F.col("v"))).alias("length")), "length")
