"""Queries of the engine's operators over the driver tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvaframe.functions import strings
from sylvaframe.operators import agreement, calibration, metrics, relational, resampling, spatial

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Scored parcels: label, fold, block and score of each order.
EVAL = """SELECT o_orderkey AS parcel_id, o_custkey % 6 + 1 AS fold, o_custkey % 20 + 1 AS block, o_orderstatus AS stratum,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS y,
  CAST((o_orderkey * 7919 + o_custkey * 104729) % 1000 AS DOUBLE) / 1000 AS p,
  CAST((o_orderkey * 611953 + o_custkey * 7) % 1000 AS DOUBLE) / 1000 AS p2 FROM orders"""
#: Raters of each part.
RATERS = """SELECT p_partkey, p_brand, CASE WHEN p_size > 20 THEN 1 ELSE 0 END AS a, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS b,
  CASE WHEN p_size % 3 > 0 THEN 1 ELSE 0 END AS c, CASE WHEN p_retailprice > 1400 THEN 1 ELSE 0 END AS reference FROM part"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over(sql: str, *tables: str):
    """A frame for the SQL over the named tables, whatever views the session has."""

    def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql.replace(f"FROM {tables[0]}", "FROM {t}"), t=table(spark, sf_dir, tables[0]))

    return frame


evaluated, raters = over(EVAL, "orders"), over(RATERS, "part")


def query(name: str, sql: str):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


E = f"WITH e AS ({EVAL})"
CONF = "count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn"


@query("ag01_parcel_aggregation", "SELECT l_orderkey AS parcel_id, round(avg(CAST(l_partkey % 100 AS DOUBLE) / 100), 9) AS p_mean, count(*) AS n_pixels FROM lineitem GROUP BY ALL")
def _(s, d):
    own = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("parcel_id"))
    return rounded(own.agg(F.avg((F.col("l_partkey") % 100).cast("double") / 100).alias("p_mean"), F.count("*").alias("n_pixels")))


@query("ag03_zonal_mean_exclude", "SELECT l_suppkey AS zone, round(avg(CASE WHEN l_quantity <> 1 THEN l_quantity END), 9) AS mean, count(*) AS n FROM lineitem GROUP BY ALL")
def _(s, d):
    return rounded(spatial.zonal_mean(table(s, d, "lineitem").withColumnRenamed("l_suppkey", "zone"), "zone", "l_quantity", 1.0, False))


@query("ag04_zonal_mean_zero", "SELECT l_suppkey AS zone, round(avg(CASE WHEN l_quantity <> 1 THEN l_quantity ELSE 0 END), 9) AS mean, count(*) AS n FROM lineitem GROUP BY ALL")
def _(s, d):
    return rounded(spatial.zonal_mean(table(s, d, "lineitem").withColumnRenamed("l_suppkey", "zone"), "zone", "l_quantity", 1.0, True))


@query("ag07_counts_and_sums", "SELECT p_brand, count(*) AS parcels, round(sum(p_retailprice), 4) AS area, count(DISTINCT p_size) AS sizes FROM part GROUP BY ALL")
def _(s, d):
    return rounded(table(s, d, "part").groupBy("p_brand").agg(F.count("*").alias("parcels"), F.sum("p_retailprice").alias("area"), F.countDistinct("p_size").alias("sizes")), 4)


@query("ag08_closest_record", "SELECT l_orderkey, yr FROM (SELECT l_orderkey, year(l_shipdate) AS yr, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(year(l_shipdate) - 1996), CASE WHEN year(l_shipdate) > 1996 THEN 1 ELSE 0 END, year(l_shipdate) DESC) AS r FROM lineitem WHERE l_shipdate IS NOT NULL) WHERE r = 1")
def _(s, d):
    return relational.closest(table(s, d, "lineitem").select("l_orderkey", F.year("l_shipdate").cast("long").alias("yr")), ["l_orderkey"], "yr", 1996)


@query("ag09_dominant_share", "WITH g AS (SELECT l_orderkey, l_returnflag, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), t AS (SELECT *, sum(w) OVER (PARTITION BY l_orderkey) AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY w DESC, l_returnflag) AS r FROM g) SELECT l_orderkey, l_returnflag, round(w / a, 9) AS share FROM t WHERE r = 1 AND w / a >= 0.6")
def _(s, d):
    return rounded(relational.dominant(table(s, d, "lineitem"), ["l_orderkey"], "l_returnflag", "l_quantity", 0.6))


@query("ag12_confusion", f"{E} SELECT fold, {CONF} FROM e GROUP BY fold")
def _(s, d):
    return metrics.confusion(evaluated(s, d), 0.5, ["fold"])


@query("ag13_threshold_metrics", f"{E}, c AS (SELECT fold, {CONF} FROM e GROUP BY fold) SELECT fold, tp, fp, fn, tn, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(fp / (fp + tn), 9) AS fpr, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(tp / (tp + fn) - fp / (fp + tn), 9) AS tss, round((tp * tn - fp * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 9) AS mcc FROM c")
def _(s, d):
    return rounded(metrics.rates(metrics.confusion(evaluated(s, d), 0.5, ["fold"])))


_RANK = """, b AS (SELECT KEY p, sum(y) AS pos, count(*) AS n FROM e GROUP BY KEY p),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS hits, sum(pos) OVER v AS pp, sum(n) OVER v AS nn FROM b WINDOW w AS (OVERKEY ORDER BY p DESC), v AS (OVERKEY)),
f AS (SELECT *, 2 * tp / (hits + pp) AS f, row_number() OVER (OVERKEY ORDER BY 2 * tp / (hits + pp) DESC, p) AS r FROM c)
SELECT KEY CAST(max(nn) AS BIGINT) AS n, CAST(max(pp) AS BIGINT) AS positives, round(sum(pos / pp * tp / hits), 9) AS pr_auc,
round(sum(pos * ((nn - pp) - (hits - tp) + (n - pos) / 2) / (pp * (nn - pp))), 9) AS roc_auc,
max(CASE WHEN r = 1 THEN p END) AS threshold, round(max(f), 9) AS f1 FROM f GROUPKEY"""


def _rank(key: str) -> str:
    return _RANK.replace("GROUPKEY", f"GROUP BY {key}" if key else "").replace("OVERKEY", f"PARTITION BY {key}" if key else "").replace("KEY", f"{key}," if key else "")


@query("ag15_ranking_by_fold", E + _rank("fold"))
def _(s, d):
    return rounded(metrics.ranking(evaluated(s, d), ["fold"]))


@query("ag18_ranking_pooled", E + _rank(""))
def _(s, d):
    return rounded(metrics.ranking(evaluated(s, d)))


@query("ag24_ranking_by_stratum", E + _rank("stratum"))
def _(s, d):
    return rounded(metrics.ranking(evaluated(s, d), ["stratum"]))


@query("ag21_long_metrics", f"{E}, c AS (SELECT fold, {CONF} FROM e GROUP BY fold), r AS (SELECT fold, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall FROM c) SELECT fold, metric, value FROM (UNPIVOT r ON f1, precision, recall INTO NAME metric VALUE value)")
def _(s, d):
    return rounded(metrics.long(metrics.rates(metrics.confusion(evaluated(s, d), 0.5, ["fold"])), ["fold"], ["f1", "precision", "recall"]))


@query("ag25_threshold_sweep", f"{E} SELECT t / 20 AS threshold, count(*) FILTER (p >= t / 20 AND y = 1) AS tp, count(*) FILTER (p >= t / 20 AND y = 0) AS fp FROM e, range(1, 20) r(t) GROUP BY ALL")
def _(s, d):
    steps = s.range(1, 20).select((F.col("id") / 20).alias("threshold"))
    by = evaluated(s, d).groupBy("p", "y").agg(F.count("*").alias("n")).crossJoin(F.broadcast(steps)).where("p >= threshold")
    return by.groupBy("threshold").agg(F.sum(F.expr("IF(y = 1, n, 0)")).alias("tp"), F.sum(F.expr("IF(y = 0, n, 0)")).alias("fp"))


R = f"WITH r AS ({RATERS})"


@query("ag27_votes", f"{R} SELECT p_partkey, a + b + c AS votes FROM r")
def _(s, d):
    return raters(s, d).select("p_partkey", agreement.votes(["a", "b", "c"]).alias("votes"))


@query("ag28_consensus", f"{R} SELECT CASE a + b + c WHEN 3 THEN 'all' WHEN 0 THEN 'none' ELSE 'mixed' END AS consensus, count(*) AS n FROM r GROUP BY ALL")
def _(s, d):
    return agreement.consensus(raters(s, d), ["a", "b", "c"])


@query("ag30_pairwise_kappa", f"{R}, u AS (SELECT p_partkey, rater, v FROM (UNPIVOT (SELECT p_partkey, a, b, c FROM r) ON a, b, c INTO NAME rater VALUE v)), k AS (SELECT x.rater AS rater_a, y.rater AS rater_b, avg(CASE WHEN x.v = y.v THEN 1.0 ELSE 0.0 END) AS ag, avg(x.v) AS pa, avg(y.v) AS pb FROM u x JOIN u y USING (p_partkey) GROUP BY ALL) SELECT rater_a, rater_b, round(ag, 9) AS agreement, round((ag - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 9) AS kappa FROM k")
def _(s, d):
    return rounded(agreement.pairwise(raters(s, d), ["a", "b", "c"]))


@query("ag31_fleiss", f"{R}, v AS (SELECT a + b + c AS v FROM r), o AS (SELECT avg((v * (v - 1) + (3 - v) * (2 - v)) / 6) AS po, avg(v / 3) AS p FROM v) SELECT round((po - (p * p + (1 - p) * (1 - p))) / (1 - (p * p + (1 - p) * (1 - p))), 9) AS kappa FROM o")
def _(s, d):
    return rounded(agreement.fleiss(raters(s, d), ["a", "b", "c"]))


@query("ag35_strata_with_total", "SELECT coalesce(p_brand, 'total') AS p_brand, count(*) AS n, round(count(*) / (SELECT count(*) FROM part), 9) AS share FROM part GROUP BY ROLLUP (p_brand)")
def _(s, d):
    own = table(s, d, "part")
    per = own.rollup("p_brand").agg(F.count("*").alias("n")).select(F.coalesce("p_brand", F.lit("total")).alias("p_brand"), "n")
    return rounded(per.crossJoin(F.broadcast(own.agg(F.count("*").alias("_n")))).select("p_brand", "n", (F.col("n") / F.col("_n")).alias("share")))


@query("ag36_pivot", "SELECT l_linestatus, round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0), 4) AS A, round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0), 4) AS N, round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0), 4) AS R FROM lineitem GROUP BY ALL")
def _(s, d):
    return rounded(table(s, d, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity")).fillna(0.0), 4)


@query("ag38_quantiles", "SELECT p_brand, round(quantile_cont(p_retailprice, 0.05), 6) AS p05, round(quantile_cont(p_retailprice, 0.25), 6) AS p25, round(quantile_cont(p_retailprice, 0.5), 6) AS p50, round(quantile_cont(p_retailprice, 0.95), 6) AS p95, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY ALL")
def _(s, d):
    q = [F.percentile("p_retailprice", p).alias(n) for n, p in (("p05", 0.05), ("p25", 0.25), ("p50", 0.5), ("p95", 0.95))]
    return rounded(table(s, d, "part").groupBy("p_brand").agg(*q, F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high")), 6)


@query("ag40_weighted_mean", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS mean FROM lineitem GROUP BY ALL")
def _(s, d):
    return rounded(table(s, d, "lineitem").groupBy("l_returnflag").agg((F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity")).alias("mean")))


@query("ca01_calibration_errors", f"{E}, b AS (SELECT least(9, greatest(0, CAST(floor(p * 1000 / 100) AS INT))) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS fr FROM (SELECT round(p * 1000) / 1000 AS p, y FROM e) GROUP BY ALL), x AS (SELECT sum(abs(mp - fr) * n) / sum(n) AS ece, max(abs(mp - fr)) AS mce FROM b), z AS (SELECT avg((p - y) ** 2) AS brier, avg(-(y * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - y) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))) AS ll FROM e) SELECT round(ece, 9) AS ece, round(mce, 9) AS mce, round(brier, 9) AS brier, round(ll, 9) AS log_loss FROM x, z")
def _(s, d):
    return rounded(calibration.errors(evaluated(s, d)))


@query("jn01_inner_paired", f"{E} SELECT a.parcel_id, round(a.p - b.p2, 9) AS diff FROM e a JOIN e b USING (parcel_id)")
def _(s, d):
    e = evaluated(s, d)
    return rounded(e.select("parcel_id", "p").join(e.select("parcel_id", "p2"), "parcel_id").select("parcel_id", (F.col("p") - F.col("p2")).alias("diff")))


@query("jn10_semi", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def _(s, d):
    return table(s, d, "orders").join(table(s, d, "lineitem").where("l_quantity > 45"), F.expr("o_orderkey = l_orderkey"), "left_semi").select("o_orderkey")


@query("jn11_anti_with_reason", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'idle' END AS reason FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(s, d):
    own = table(s, d, "customer").join(table(s, d, "orders"), F.expr("c_custkey = o_custkey"), "left_anti")
    return own.select("c_custkey", F.when(F.col("c_acctbal") < 0, "debt").otherwise("idle").alias("reason"))


_BOX = "SELECT {k} AS {n}, CAST({k} * 37 % 500 AS DOUBLE) AS xmin, CAST({k} * 91 % 500 AS DOUBLE) AS ymin, CAST({k} * 37 % 500 + {w} AS DOUBLE) AS xmax, CAST({k} * 91 % 500 + {w} AS DOUBLE) AS ymax FROM {t}"
_T, _S = _BOX.format(k="p_partkey", n="target", w=10, t="part"), _BOX.format(k="s_suppkey", n="source", w=25, t="supplier")


@query("jn13_overlay", f"WITH t AS ({_T}), s AS ({_S}), j AS (SELECT target, source, (least(t.xmax, s.xmax) - greatest(t.xmin, s.xmin)) * (least(t.ymax, s.ymax) - greatest(t.ymin, s.ymin)) AS area FROM t JOIN s ON t.xmin < s.xmax AND s.xmin < t.xmax AND t.ymin < s.ymax AND s.ymin < t.ymax) SELECT target, source, area, area / 100 AS overlap_target, area / 625 AS overlap_source FROM j")
def _(s, d):
    return spatial.overlaps(over(_T, "part")(s, d), over(_S, "supplier")(s, d), 25.0)


@query("pr04_ordered_labels", "SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'old' WHEN p_size >= 20 THEN 'mature' ELSE 'young' END AS label FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.when(F.col("p_size") >= 40, "old").when(F.col("p_size") >= 20, "mature").otherwise("young").alias("label"))


@query("pr09_quantile_bins", "WITH q AS (SELECT quantile_cont(p_retailprice, 1.0 / 3) AS a, quantile_cont(p_retailprice, 2.0 / 3) AS b FROM part) SELECT p_partkey, CASE WHEN p_retailprice <= a THEN 'low' WHEN p_retailprice <= b THEN 'mid' ELSE 'high' END AS bin FROM part, q")
def _(s, d):
    return relational.quantile_bins(table(s, d, "part"), "p_retailprice", [1 / 3, 2 / 3], ["low", "mid", "high"]).select("p_partkey", "bin")


@query("pr10_fixed_bins", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 0 WHEN p_size < 25 THEN 1 ELSE 2 END AS bin FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", relational.fixed_bins(F.col("p_size"), [0, 10, 25]).alias("bin"))


@query("pr15_composition_pairs", "SELECT p_partkey, (p_size % 9 + 1) || 'MO ' || (9 - p_size % 9) || 'FA' AS raw, CASE WHEN p_size % 9 + 1 > 9 - p_size % 9 THEN (p_size % 9 + 1) || 'MO ' || (9 - p_size % 9) || 'FA' ELSE (9 - p_size % 9) || 'FA ' || (p_size % 9 + 1) || 'MO' END AS canonical FROM part")
def _(s, d):
    own = table(s, d, "part").select("p_partkey", F.expr("concat(p_size % 9 + 1, 'MO ', 9 - p_size % 9, 'FA')").alias("raw"))
    return own.select("p_partkey", "raw", F.array_join(F.transform(strings.pairs(strings.clean(F.col("raw"))), lambda x: F.concat(x["share"].cast("string"), x["code"])), " ").alias("canonical"))


@query("pr22_pixel_ids", "SELECT l_orderkey * 100 + l_linenumber AS pixel_id, l_orderkey AS row, CAST(l_linenumber AS BIGINT) AS col FROM lineitem")
def _(s, d):
    own = table(s, d, "lineitem").select(spatial.encode(F.col("l_orderkey"), F.col("l_linenumber"), 100).alias("pixel_id"))
    row, col = spatial.decode(F.col("pixel_id"), 100)
    return own.select("pixel_id", row.alias("row"), col.alias("col"))


@query("rs01_block_bootstrap", f"{E}, c AS (SELECT block, {CONF} FROM e GROUP BY block), dr AS (SELECT k AS replicate, b AS block, (k * 31 + b * 17) % 3 AS times FROM range(100) x(k), range(1, 21) y(b)), m AS (SELECT replicate, sum(tp * times) AS tp, sum(fp * times) AS fp, sum(fn * times) AS fn FROM c JOIN dr USING (block) GROUP BY replicate) SELECT replicate, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM m")
def _(s, d):
    draws = s.range(100).selectExpr("id AS replicate", "explode(sequence(1L, 20L)) AS block").selectExpr("replicate", "block", "(replicate * 31 + block * 17) % 3 AS times")
    sums = resampling.block_bootstrap(metrics.confusion(evaluated(s, d), 0.5, ["block"]), F.broadcast(draws), ["tp", "fp", "fn"])
    return rounded(sums.select("replicate", metrics.ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1")))


@query("rs04_two_sided_p", f"{E} SELECT stratum, round(least(1, 2 * least((count(*) FILTER (p - p2 <= 0) + 1) / (count(*) + 1), (count(*) FILTER (p - p2 >= 0) + 1) / (count(*) + 1))), 9) AS p FROM e GROUP BY stratum")
def _(s, d):
    return rounded(resampling.two_sided_p(evaluated(s, d).select("stratum", (F.col("p") - F.col("p2")).alias("v")), "v", ["stratum"]))


@query("rs05_holm", "WITH x AS (SELECT p_brand, p_partkey, p_size / 500 AS p FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS m FROM x) SELECT p_partkey, round(least(1, max((m - r + 1) * p) OVER (PARTITION BY p_brand ORDER BY p, p_partkey)), 9) AS p_holm FROM r")
def _(s, d):
    own = table(s, d, "part").select("p_brand", "p_partkey", (F.col("p_size") / 500).alias("p"))
    return rounded(resampling.holm(own, "p", ["p_brand"], "p_partkey").select("p_partkey", "p_holm"))


@query("rs11_wilson", f"{E}, g AS (SELECT fold, sum(y) AS h, count(*) AS n FROM e GROUP BY fold), f AS (SELECT fold, h / n AS f, n, 1.959963984540054 AS z FROM g) SELECT fold, round((f + z * z / (2 * n) - z * sqrt(f * (1 - f) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS low, round((f + z * z / (2 * n) + z * sqrt(f * (1 - f) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS high FROM f")
def _(s, d):
    own = evaluated(s, d).groupBy("fold").agg(F.sum("y").alias("h"), F.count("*").alias("n"))
    low, high = resampling.wilson(F.col("h"), F.col("n"))
    return rounded(own.select("fold", low.alias("low"), high.alias("high")))


@query("so03_symmetric_difference", "SELECT count(*) AS n FROM ((SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer))")
def _(s, d):
    return relational.symmetric_difference(table(s, d, "customer").select(F.col("c_custkey").alias("k")), table(s, d, "orders").select(F.col("o_custkey").alias("k")))


@query("wn02_cap_rows", "SELECT l_orderkey, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_quantity) AS r FROM lineitem) WHERE r <= 2")
def _(s, d):
    return relational.capped(table(s, d, "lineitem"), ["l_orderkey"], 2, F.col("l_partkey"), F.col("l_quantity")).select("l_orderkey", "l_partkey", "l_quantity")


@query("wn10_share_of_group", "SELECT n_nationkey, round(count(*) / sum(count(*)) OVER (PARTITION BY n_regionkey), 9) AS share FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey")
def _(s, d):
    per = table(s, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).join(table(s, d, "nation"), F.expr("c_nationkey = n_nationkey"))
    return rounded(per.selectExpr("n_nationkey", "n / sum(n) OVER (PARTITION BY n_regionkey) AS share"))


@query("st04_top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def _(s, d):
    return table(s, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10)


@query("ao05_outlier_threshold", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders) SELECT round(max(o_totalprice), 4) AS threshold FROM orders, q WHERE o_totalprice <= b + 1.5 * (b - a)")
def _(s, d):
    own = table(s, d, "orders").select("o_totalprice")
    q = own.agg(F.percentile("o_totalprice", 0.25).alias("a"), F.percentile("o_totalprice", 0.75).alias("b"))
    return rounded(own.crossJoin(F.broadcast(q)).where("o_totalprice <= b + 1.5 * (b - a)").agg(F.max("o_totalprice").alias("threshold")), 4)
