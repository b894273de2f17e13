"""Queries on cohorts: samples, folds, bins, joins, sets, reshaping, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audits, cohort
from ..operators.ranks import quantiles
from ..sources import tables as T
from .common import EV, greedy_folds, register
from .event_queries import six

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)
LABELS = ("click", "error", "purchase", "signup", "view")


@query("SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY sha256('1|' || event_id), event_id) AS r FROM events) WHERE r <= 25")
def smp1_cap_per_label(spark: SparkSession, d: str) -> DataFrame:
    return cohort.sampled_per_group(T.table(spark, d, "events").select("event_id", "event_type"), ["event_type"], 25, "event_id")


@query("""WITH w AS (SELECT event_type, count(*) AS need FROM events WHERE value > 90 GROUP BY event_type)
SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY sha256('1|' || event_id), event_id) AS r FROM events) JOIN w USING (event_type) WHERE r <= need""")
def smp3_quotas(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events").select("event_id", "event_type", "value")
    return cohort.quota_sample(e.drop("value"), e.where("value > 90"), ["event_type"], "event_id")


DUR = (0.0, 25.0, 50.0, 75.0, 1e9)
DUR_SQL = "CASE WHEN value < 25 THEN 0 WHEN value < 50 THEN 1 WHEN value < 75 THEN 2 ELSE 3 END"


@query(f"""WITH e AS (SELECT event_id, event_type, {DUR_SQL} AS bin, user_id FROM events), w AS (SELECT event_type, bin, count(*) AS need FROM e WHERE user_id % 7 = 0 GROUP BY ALL)
SELECT event_id, event_type, bin FROM (SELECT *, row_number() OVER (PARTITION BY event_type, bin ORDER BY sha256('1|' || event_id), event_id) AS r FROM e) JOIN w USING (event_type, bin) WHERE r <= need""")
def smp4_matched(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events").select("event_id", "event_type", S.binned(F.col("value"), DUR).alias("bin"), "user_id")
    return cohort.quota_sample(e.drop("user_id"), e.where("user_id % 7 = 0"), ["event_type", "bin"], "event_id")


@query("""SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY sha256('1|' || event_id), event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r <= greatest(2, round_even(n * 0.05, 0))""")
def smp5_fraction(spark: SparkSession, d: str) -> DataFrame:
    return cohort.fraction_sample(T.table(spark, d, "events").select("event_id", "event_type"), ["event_type"], 0.05, "event_id")


@query(f"SELECT {DUR_SQL} AS bin, count(*) AS n, min(value) AS least FROM events GROUP BY 1")
def bin1_durations(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "events").groupBy(S.binned(F.col("value"), DUR).alias("bin")).agg(F.count("*").alias("n"), F.min("value").alias("least"))


FOLDS = greedy_folds("fd", "SELECT user_id, count(*) AS size FROM events GROUP BY user_id", 5, 1)


@query(f"WITH RECURSIVE {FOLDS} SELECT user_id, size, fold FROM fd")
def spl1_group_folds(spark: SparkSession, d: str) -> DataFrame:
    return cohort.group_folds(T.table(spark, d, "events"), "user_id")


@query(f"WITH RECURSIVE {FOLDS} SELECT fold, count(DISTINCT user_id) AS groups, count(*) AS n FROM events JOIN fd USING (user_id) GROUP BY fold")
def agg13_fold_counts(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events")
    folds = cohort.group_folds(e, "user_id").select("user_id", "fold")
    return T.joined_one(e.select("user_id"), folds, ["user_id"]).groupBy("fold").agg(F.countDistinct("user_id").alias("groups"), F.count("*").alias("n"))


@query()
def spl2_nested_folds(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events").select("user_id")
    return cohort.nested_folds(cohort.group_folds(e, "user_id"), e, "user_id")


@query("SELECT event_id FROM events WHERE (event_type, user_id % 10) IN (SELECT (event_type, user_id % 10) FROM events GROUP BY event_type, user_id % 10 HAVING count_if(value > 50) >= 20)")
def flt9_supported(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events").select("event_id", "event_type", "value", (F.col("user_id") % 10).alias("c"))
    return cohort.supported(e, ["event_type", "c"], F.col("value") > 50, 20).select("event_id")


@query("SELECT event_id, value <= (SELECT quantile_cont(value, 0.03) FROM events) AS low FROM events")
def flt10_quantile_flag(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events").select("event_id", "value")
    cut = quantiles(e, [], "value", {"cut": 0.03})
    return e.join(F.broadcast(cut)).select("event_id", (F.col("value") <= F.col("cut")).alias("low"))


@query("WITH k AS (SELECT user_id, min(event_id) AS a FROM events GROUP BY user_id ORDER BY a, user_id LIMIT 10) SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM k)")
def flt11_first_keys(spark: SparkSession, d: str) -> DataFrame:
    return cohort.first_keys(T.table(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id", 10).select("event_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def flt6_semi(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "documents").select("doc_id").join(T.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def flt7_anti(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "documents").select("doc_id").join(T.table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 1000 AND 200000")
def flt3_label_and_range(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_totalprice").between(1000, 200000)).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("SELECT o.o_orderkey, c.c_custkey, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey")
def jon9_many_to_one(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = T.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = T.table(spark, d, "nation").select("n_nationkey", "n_name")
    return T.joined_one(T.joined_one(o, c, ["c_custkey"]), n, ["n_nationkey"]).select("o_orderkey", "c_custkey", "n_name")


@query("SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS clicks, coalesce(b.n, 0) AS errors FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) a FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) b ON a.user_id = b.user_id")
def jon12_outer_fill(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events")
    n = lambda t, name: e.where(F.col("event_type") == t).groupBy("user_id").agg(F.count("*").alias(name))
    return n("click", "clicks").join(n("error", "errors"), "user_id", "full").na.fill(0, ["clicks", "errors"])


@query("SELECT user_id, count_if(event_type = 'click') AS n_click, count_if(event_type = 'error') AS n_error, count_if(event_type = 'purchase') AS n_purchase, count_if(event_type = 'signup') AS n_signup, count_if(event_type = 'view') AS n_view, count(*) AS total FROM events GROUP BY user_id")
def agg22_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return audits.crosstab(T.table(spark, d, "events"), "user_id", "event_type", LABELS).drop("top", "top_fraction")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r, sum(n) OVER (PARTITION BY user_id) AS size, count(*) OVER (PARTITION BY user_id) AS k FROM c)
SELECT user_id, event_type AS top, CAST(size AS BIGINT) AS size, n AS top_n, k AS "values", round(n / size, 6) AS top_fraction FROM r WHERE r = 1""")
def agg27_dominance(spark: SparkSession, d: str) -> DataFrame:
    return six(audits.dominance(T.table(spark, d, "events"), "user_id", "event_type"), "top_fraction")


@query("SELECT user_id, CAST(sum(n) AS BIGINT) AS size, string_agg(event_type || ':' || n, ';' ORDER BY n DESC, event_type) AS composition FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def agg32_composition(spark: SparkSession, d: str) -> DataFrame:
    return audits.composition(T.table(spark, d, "events"), "user_id", "event_type")


COMP = "cp AS (SELECT event_type AS l, user_id % 12 AS c, count(*) AS n FROM events GROUP BY ALL), ps AS (SELECT *, n / sum(n) OVER (PARTITION BY l) AS p FROM cp)"


@query(f"WITH {COMP} SELECT l AS event_type, count(*) AS components, max(n) AS top_n, round(max(p), 6) AS top_fraction, round(-sum(p * ln(p)), 6) AS entropy FROM ps GROUP BY l")
def agg24_spread(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events").select("event_type", (F.col("user_id") % 12).alias("c"))
    return six(audits.spread(e, "event_type", "c"), "top_fraction", "entropy")


@query(f"WITH {COMP} SELECT a.l AS label_a, b.l AS label_b, round(sum(least(a.p, b.p)), 6) AS shared FROM ps a JOIN ps b ON a.c = b.c AND a.l < b.l GROUP BY 1, 2")
def agg25_shared_mass(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events").select("event_type", (F.col("user_id") % 12).alias("c"))
    return six(audits.shared_mass(e, "event_type", "c"), "shared")


LI = "lg AS (SELECT l_returnflag AS g, l_linestatus AS s, u.name, u.x FROM lineitem, LATERAL (VALUES ('l_quantity', l_quantity), ('l_extendedprice', l_extendedprice), ('l_discount', l_discount)) u(name, x))"
NUM = ("l_quantity", "l_extendedprice", "l_discount")


@query(f"""WITH {LI}, b AS (SELECT name, g, avg(x) AS mean, quantile_cont(x, 0.5) AS med FROM lg GROUP BY name, g), w AS (SELECT name, stddev_pop(x) AS sd FROM lg GROUP BY name)
SELECT name, round(min(mean), 6) AS mean_least, round(max(mean), 6) AS mean_most, min(med) AS median_least, max(med) AS median_most, round(any_value(sd), 6) AS sd, round((max(mean) - min(mean)) / any_value(sd), 6) AS range_sd FROM b JOIN w USING (name) GROUP BY name""")
def agg26_nuisance(spark: SparkSession, d: str) -> DataFrame:
    return six(audits.nuisance(T.table(spark, d, "lineitem"), "l_returnflag", NUM), "mean_least", "mean_most", "sd", "range_sd")


def _two_sql() -> str:
    side = lambda s, w: f"round(avg(x) FILTER ({w}), 6) AS mean_{s}, quantile_cont(x, 0.5) FILTER ({w}) AS median_{s}, round(quantile_cont(x, 0.05) FILTER ({w}), 6) AS p05_{s}, round(quantile_cont(x, 0.95) FILTER ({w}), 6) AS p95_{s}, 0.0::DOUBLE AS missing_{s}"
    a, b = "WHERE s = 'O'", "WHERE s <> 'O'"
    return f"WITH {LI} SELECT name, {side('a', a)}, {side('b', b)}, round((avg(x) FILTER ({a}) - avg(x) FILTER ({b})) / sqrt((var_pop(x) FILTER ({a}) + var_pop(x) FILTER ({b})) / 2), 6) AS smd FROM lg GROUP BY name"


@query(_two_sql())
def agg28_two_groups(spark: SparkSession, d: str) -> DataFrame:
    return six(audits.two_groups(T.table(spark, d, "lineitem"), F.col("l_linestatus") == "O", NUM), "mean_a", "mean_b", "p05_a", "p05_b", "p95_a", "p95_b", "smd")


@query("SELECT count(*) AS groups, min(n) AS least, quantile_cont(n, 0.5) AS median, round(avg(n), 6) AS mean, max(n) AS most, avg(CAST(n = 1 AS INTEGER)) AS singletons FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def agg16_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return six(audits.group_sizes(T.table(spark, d, "orders"), "o_custkey"), "mean")


@query(f"SELECT event_type, {DUR_SQL} AS bin, count(*) AS n, count(DISTINCT user_id) AS groups, min(value) AS least, round(quantile_cont(value, 0.5), 6) AS median, max(value) AS most, count_if(user_id % 3 = 0) AS positives, round(count_if(user_id % 3 = 0) / count(*), 6) AS rate FROM events GROUP BY 1, 2")
def agg12_support(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events").withColumn("bin", S.binned(F.col("value"), DUR))
    return six(audits.support(e, ["event_type", "bin"], "user_id", "value", F.col("user_id") % 3 == 0), "median", "rate")


@query(f"WITH {LI} SELECT name, count(*) AS n, count_if(x IS NULL) AS missing, count(x) = 0 AS all_missing, coalesce(min(x) = max(x), false) AS constant FROM lg GROUP BY name")
def wfl14_column_support(spark: SparkSession, d: str) -> DataFrame:
    return audits.column_support(T.table(spark, d, "lineitem"), NUM)


@query('SELECT l_orderkey, count(DISTINCT l_returnflag) AS "values" FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1')
def agg39_varying(spark: SparkSession, d: str) -> DataFrame:
    return audits.varying(T.table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag")


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity - avg(l_quantity) OVER w, 9) AS centred, round(coalesce(CASE WHEN stddev_pop(l_quantity) OVER w > 1e-12 THEN (l_quantity - avg(l_quantity) OVER w) / stddev_pop(l_quantity) OVER w END, 0), 9) AS scaled FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)""")
def mlt9_group_normalised(spark: SparkSession, d: str) -> DataFrame:
    t = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").alias("centred"), F.col("l_quantity").alias("scaled"))
    t = audits.group_normalised(audits.group_normalised(t, "l_suppkey", ["centred"], False), "l_suppkey", ["scaled"], True)
    return t.select("l_orderkey", "l_linenumber", *((F.round(c, 9) + F.lit(0.0)).alias(c) for c in ("centred", "scaled")))


@query("SELECT l_orderkey, l_linenumber, u.name, u.x FROM lineitem, LATERAL (VALUES ('l_quantity', l_quantity), ('l_discount', l_discount)) u(name, x)")
def set5_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return audits.unpivoted(T.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount"])


@query("SELECT event_id AS id, 'event' AS kind, value, NULL::VARCHAR AS lang FROM events UNION ALL SELECT doc_id, 'document', NULL, lang FROM documents")
def set2_union_missing(spark: SparkSession, d: str) -> DataFrame:
    return T.union_all(T.table(spark, d, "events").select(F.col("event_id").alias("id"), F.lit("event").alias("kind"), "value"), T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), "lang"))


@query("(SELECT user_id FROM events WHERE event_type = 'click' AND value > 60 INTERSECT SELECT user_id FROM events WHERE event_type = 'error' AND value > 40) EXCEPT SELECT user_id FROM events WHERE event_type = 'signup' AND value > 50")
def set3_set_operations(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events")
    of = lambda t, least: e.where((F.col("event_type") == t) & (F.col("value") > least)).select("user_id")
    return of("click", 60).intersect(of("error", 40)).subtract(of("signup", 50))


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20")
def srt4_top(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(20)


@query("SELECT user_id, arg_max(event_id, {'v': value, 'e': -event_id}) AS event_id, max(value) AS value FROM events GROUP BY user_id")
def srt5_top_per_group(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"), F.max("value").alias("value"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS winner FROM embeddings")
def srt7_argmax(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).alias("winner"))


@query("SELECT doc_id FROM documents ORDER BY sha256('7|' || doc_id), doc_id LIMIT 50")
def srt10_blinded_order(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "documents").select("doc_id").orderBy(S.seeded(7, F.col("doc_id")), "doc_id").limit(50)


@query("""WITH a AS (SELECT l_suppkey, sum(l_quantity) AS q, max(l_discount) AS m FROM lineitem GROUP BY l_suppkey), b AS (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'A' AND l_suppkey % 10 = 0 THEN 0 ELSE l_quantity END) AS q, max(l_discount) AS m FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY l_suppkey),
j AS (SELECT a.q - b.q AS q, a.m - b.m AS m, b.l_suppkey IS NULL AS lost FROM a LEFT JOIN b USING (l_suppkey))
SELECT 'q' AS name, max(abs(q)) AS most, count_if(lost) AS null_differs, count_if(lost) AS lost FROM j UNION ALL SELECT 'm', max(abs(m)), count_if(lost), count_if(lost) FROM j""")
def wfl9_recompute_audit(spark: SparkSession, d: str) -> DataFrame:
    """What an audit reports of a result that lacks keys and some of a sum: every column, whether it differs or not."""
    e = T.table(spark, d, "lineitem")
    one = e.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"), F.max("l_discount").alias("m"))
    part = F.when((F.col("l_returnflag") == "A") & (F.col("l_suppkey") % 10 == 0), 0.0).otherwise(F.col("l_quantity"))
    two = e.where("l_suppkey % 7 <> 0").groupBy("l_suppkey").agg(F.sum(part).alias("q"), F.max("l_discount").alias("m"))
    return audits.compared(one, two, ["l_suppkey"], ["q", "m"])


@query(f"WITH {EV} SELECT clip, count(*) AS n, round(max(end_s) - min(start_s), 6) AS extent FROM ev GROUP BY clip")
def prj3_normalised(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d)
    roles = {"call_id": T.resolve(e.columns, ["id", "CALL_ID"]), "clip": T.resolve(e.columns, ["clip"]), "label": "label", "start": "start_s", "end": "end_s"}
    n = T.normalised(e, roles)
    return six(n.groupBy(F.col("clip").cast("long").alias("clip")).agg(F.count("*").alias("n"), (F.max("end_s") - F.min("start_s")).alias("extent")), "extent")
