"""Queries of preparation, weighting, tables and calibration over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sylvaframe.operators import calibration, relational, resampling
from sylvaframe.plans.queries import E, evaluated, query, raters, rounded, table
from sylvaframe.sources import tables

_R = "WITH r AS (SELECT p_partkey, p_brand, CASE WHEN p_size > 20 THEN 1 ELSE 0 END AS a, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS b, CASE WHEN p_size % 3 > 0 THEN 1 ELSE 0 END AS c, CASE WHEN p_retailprice > 1400 THEN 1 ELSE 0 END AS reference FROM part)"


@query("sc02_filtered_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def _(s, d):
    return tables.read_parquet(s, f"{d}/orders.parquet", ["o_orderkey", "o_totalprice"], "o_totalprice > 100000 AND o_orderstatus = 'F'")


@query("sc19_dequantise", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey % 255 - 127 AS DOUBLE) * 0.5 AS band FROM lineitem")
def _(s, d):
    own = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.array((F.col("l_partkey") % 255 - 127).cast("tinyint")).alias("q"))
    return own.select("l_orderkey", "l_linenumber", "l_partkey", F.get(F.transform("q", lambda x: x * F.lit(0.5)), F.lit(0)).alias("band"))


@query("sc21_pending", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3)")
def _(s, d):
    done = table(s, d, "lineitem").where("l_linenumber = 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.pending(table(s, d, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("pr05_tri_state", "SELECT o_orderkey, CASE WHEN o_totalprice >= 150000 AND o_orderstatus = 'F' THEN true WHEN o_custkey % 100 BETWEEN 1 AND 40 THEN false END AS label FROM orders")
def _(s, d):
    yes = (F.col("o_totalprice") >= 150000) & (F.col("o_orderstatus") == "F")
    return table(s, d, "orders").select("o_orderkey", F.when(yes, F.lit(True)).when((F.col("o_custkey") % 100).between(1, 40), F.lit(False)).alias("label"))


@query("pr06_map_default", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS status FROM orders")
def _(s, d):
    names = F.create_map(*[F.lit(x) for x in ("F", "final", "O", "open")])
    return table(s, d, "orders").select("o_orderkey", F.coalesce(F.try_element_at(names, F.col("o_orderstatus")), F.lit("other")).alias("status"))


@query("pr08_null_verdict", "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 7 > 0 THEN p_size END >= 25, false) AS verdict FROM part")
def _(s, d):
    x = F.when(F.col("p_partkey") % 7 > 0, F.col("p_size"))
    return table(s, d, "part").select("p_partkey", F.coalesce(x >= 25, F.lit(False)).alias("verdict"))


@query("pr20_suffix", "SELECT p_partkey, lower(split_part(p_type, ' ', -1)) AS kind FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.lower(F.element_at(F.split("p_type", " "), -1)).alias("kind"))


@query("pr25_cells", "SELECT c_custkey, CAST(floor((c_acctbal + 1000) / 250) AS BIGINT) AS cell FROM customer WHERE c_acctbal >= 0")
def _(s, d):
    return table(s, d, "customer").where("c_acctbal >= 0").select("c_custkey", F.floor((F.col("c_acctbal") + 1000) / 250).alias("cell"))


@query("pr29_standardise", "WITH m AS (SELECT avg(p_size) AS a, stddev_pop(p_size) AS s FROM part) SELECT p_partkey, round((p_size - a) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS z FROM part, m")
def _(s, d):
    own = table(s, d, "part").select("p_partkey", "p_size")
    fit = own.agg(F.avg("p_size").alias("a"), F.stddev_pop("p_size").alias("s"))
    return rounded(own.crossJoin(F.broadcast(fit)).select("p_partkey", ((F.col("p_size") - F.col("a")) / F.when(F.col("s") == 0, 1).otherwise(F.col("s"))).alias("z")), 6)


_Q = "least(greatest(p, 1e-6), 1 - 1e-6)"


@query("pr30_logit", f"{E} SELECT parcel_id, round(ln({_Q} / (1 - {_Q})), 6) AS z FROM e")
def _(s, d):
    return rounded(evaluated(s, d).select("parcel_id", calibration.logit(F.col("p")).alias("z")), 6)


@query("pr31_temperature", f"{E} SELECT parcel_id, round(1 / (1 + exp(-ln({_Q} / (1 - {_Q})) / 1.7)), 6) AS p FROM e")
def _(s, d):
    return rounded(evaluated(s, d).select("parcel_id", calibration.tempered(F.col("p"), F.lit(1.7)).alias("p")), 6)


@query("pr40_stretch", "WITH q AS (SELECT quantile_cont(p_retailprice, 0.02) AS a, quantile_cont(p_retailprice, 0.98) AS b FROM part) SELECT p_partkey, round(least(1, greatest(0, (p_retailprice - a) / (b - a))), 6) AS z FROM part, q")
def _(s, d):
    own = table(s, d, "part").select("p_partkey", "p_retailprice")
    q = own.agg(F.percentile("p_retailprice", 0.02).alias("a"), F.percentile("p_retailprice", 0.98).alias("b"))
    z = (F.col("p_retailprice") - F.col("a")) / (F.col("b") - F.col("a"))
    return rounded(own.crossJoin(F.broadcast(q)).select("p_partkey", F.least(F.lit(1.0), F.greatest(F.lit(0.0), z)).alias("z")), 6)


@query("jn03_template_left", "SELECT c_custkey, n_name, o.orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS orders FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL) o ON c_custkey = o_custkey")
def _(s, d):
    per = table(s, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    nation = table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(s, d, "customer").select("c_custkey", "c_nationkey").join(nation, "c_nationkey", "left").join(per, "c_custkey", "left").select("c_custkey", "n_name", "orders")


@query("ag10_overlap_sum", "SELECT o_orderkey, round(coalesce(w, 0), 6) AS w FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_discount) AS w FROM lineitem WHERE l_linenumber > 3 GROUP BY ALL) ON o_orderkey = l_orderkey")
def _(s, d):
    per = table(s, d, "lineitem").where("l_linenumber > 3").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_discount").alias("w"))
    return rounded(table(s, d, "orders").select("o_orderkey").join(per, "o_orderkey", "left").fillna(0.0, ["w"]), 6)


@query("ag32_agreement_by_reference", f"{_R} SELECT rater, round(avg(CASE WHEN reference = 1 THEN v END), 9) AS positive, round(avg(CASE WHEN reference = 0 THEN v END), 9) AS negative FROM (UNPIVOT r ON a, b, c INTO NAME rater VALUE v) GROUP BY rater")
def _(s, d):
    own = raters(s, d).unpivot(["reference"], ["a", "b", "c"], "rater", "v")
    return rounded(own.groupBy("rater").agg(F.avg(F.when(F.col("reference") == 1, F.col("v"))).alias("positive"), F.avg(F.when(F.col("reference") == 0, F.col("v"))).alias("negative")))


@query("ag34_overlap_by_stratum", f"{_R} SELECT p_brand, round(count(*) FILTER (a = 1 AND c = 1) / nullif(count(*) FILTER (a = 1 OR c = 1), 0), 9) AS iou_positive, round(count(*) FILTER (a = 0 AND c = 0) / nullif(count(*) FILTER (a = 0 OR c = 0), 0), 9) AS iou_negative FROM r GROUP BY ALL")
def _(s, d):
    n = lambda x: F.count(F.when(F.expr(x), 1))
    share = lambda x, y: n(x) / F.nullif(n(y), F.lit(0))
    return rounded(raters(s, d).groupBy("p_brand").agg(share("a = 1 AND c = 1", "a = 1 OR c = 1").alias("iou_positive"), share("a = 0 AND c = 0", "a = 0 OR c = 0").alias("iou_negative")))


@query("ag39_class_quartiles", "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.25), 6) AS q1, round(quantile_cont(l_quantity, 0.5), 6) AS median, round(quantile_cont(l_quantity, 0.75), 6) AS q3 FROM lineitem GROUP BY ALL")
def _(s, d):
    return rounded(table(s, d, "lineitem").groupBy("l_returnflag").agg(*[F.percentile("l_quantity", p).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]), 6)


@query("ag42_having_area", "SELECT count(*) AS parcels, sum(n) * 0.01 AS area_ha FROM (SELECT l_orderkey, avg(l_quantity) AS m, count(*) AS n FROM lineitem GROUP BY ALL HAVING avg(l_quantity) >= 25)")
def _(s, d):
    per = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.avg("l_quantity").alias("m"), F.count("*").alias("n")).where("m >= 25")
    return per.agg(F.count("*").alias("parcels"), (F.sum("n") * F.lit(0.01)).alias("area_ha"))


@query("ag44_balance", f"{E}, g AS (SELECT fold, count(*) AS n, sum(y) AS pos FROM e GROUP BY fold) SELECT fold, n, CAST(pos AS BIGINT) AS positives, round(pos / n, 9) AS prevalence, round(n / avg(n) OVER () - 1, 9) AS deviation FROM g")
def _(s, d):
    per = evaluated(s, d).groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))
    return rounded(per.selectExpr("fold", "n", "positives", "positives / n AS prevalence", "n / avg(n) OVER () - 1 AS deviation"))


@query("ag53_overlap_coefficient", f"{E}, h AS (SELECT least(19, CAST(floor(p * 20) AS INT)) AS bin, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b FROM e GROUP BY ALL) SELECT round(sum(least(a / ta, b / tb)), 9) AS overlap FROM h, (SELECT sum(a) AS ta, sum(b) AS tb FROM h)")
def _(s, d):
    per = evaluated(s, d).groupBy(F.least(F.lit(19), F.floor(F.col("p") * 20)).alias("bin")).agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    total = per.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return rounded(per.crossJoin(F.broadcast(total)).agg(F.sum(F.least(F.col("a") / F.col("ta"), F.col("b") / F.col("tb"))).alias("overlap")))


@query("ag58_apportion", "SELECT p_brand, round(sum(p_retailprice) * 1000 / sum(sum(p_retailprice)) OVER (), 6) AS share FROM part GROUP BY p_brand")
def _(s, d):
    per = table(s, d, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("w"))
    return rounded(per.crossJoin(F.broadcast(per.agg(F.sum("w").alias("t")))).selectExpr("p_brand", "w * 1000 / t AS share"), 6)


@query("wn01_sample_weights", f"{E}, c AS (SELECT parcel_id, 1.0 / count(*) OVER (PARTITION BY y, stratum) AS w FROM e) SELECT parcel_id, round(w / avg(w) OVER (), 6) AS weight FROM c")
def _(s, d):
    return rounded(relational.sample_weights(evaluated(s, d), ["y", "stratum"]).select("parcel_id", "weight"), 6)


@query("wn08_sliding_windows", f"{E}, o AS (SELECT y, row_number() OVER (PARTITION BY fold ORDER BY p, parcel_id) - 1 AS i, fold, count(*) OVER (PARTITION BY fold) AS n FROM e), w AS (SELECT fold, k.k AS win, y FROM o, (SELECT unnest([0, 1]) AS back) b, LATERAL (SELECT CAST(floor(i / 100) AS BIGINT) - back AS k) k WHERE k.k >= 0 AND k.k * 100 + 200 <= n) SELECT fold, win, count(*) AS n, round(avg(y), 9) AS prevalence FROM w GROUP BY ALL")
def _(s, d):
    own = relational.count_windows(evaluated(s, d), ["fold"], 200, F.col("p"), F.col("parcel_id"))
    return rounded(own.groupBy("fold", "win").agg(F.count("*").alias("n"), F.avg("y").alias("prevalence")))


@query("wn18_jackknife", f"{E}, g AS (SELECT fold, avg(p) AS v FROM e GROUP BY fold) SELECT round(sqrt((count(*) - 1) / count(*) * count(*) * var_pop(v)), 9) AS se, round(max(v) - min(v), 9) AS spread FROM g")
def _(s, d):
    return rounded(evaluated(s, d).groupBy("fold").agg(F.avg("p").alias("v")).agg(F.sqrt((F.count("*") - 1) * F.var_pop("v")).alias("se"), (F.max("v") - F.min("v")).alias("spread")))


@query("so04_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(s, d):
    return table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(s, d, "supplier").select("s_nationkey"))


@query("so05_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def _(s, d):
    return table(s, d, "nation").select(F.col("n_nationkey").alias("k")).subtract(table(s, d, "customer").where("c_acctbal > 9000").select("c_nationkey"))


_OLD = "SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = '{}' GROUP BY o_custkey"


@query("so06_upsert", f"WITH old AS ({_OLD.format('F')}), new AS ({_OLD.format('O')}) SELECT k, v FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT k, v FROM new")
def _(s, d):
    side = lambda x: table(s, d, "orders").where(F.col("o_orderstatus") == x).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return tables.upsert(side("F"), side("O"), ["k"])


@query("so07_keep_last", f"WITH old AS ({_OLD.format('F')}), new AS ({_OLD.format('P')}) SELECT coalesce(new.k, old.k) AS k, coalesce(new.v, old.v) AS v FROM old FULL JOIN new ON old.k = new.k")
def _(s, d):
    side = lambda x: table(s, d, "orders").where(F.col("o_orderstatus") == x).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return tables.keep_last(side("F"), side("P"), ["k"])


@query("rs03_percentile_interval", f"{E} SELECT fold, round(quantile_cont(p - p2, 0.025), 6) AS low, round(quantile_cont(p - p2, 0.975), 6) AS high FROM e GROUP BY fold")
def _(s, d):
    return rounded(resampling.interval(evaluated(s, d).select("fold", (F.col("p") - F.col("p2")).alias("v")), "v", ["fold"]), 6)


@query("rs13_percent_differences", f"{E}, g AS (SELECT fold, sum(p) AS v FROM e GROUP BY fold) SELECT a.fold AS fold_a, b.fold AS fold_b, round((a.v / b.v - 1) * 100, 6) AS pct FROM g a, g b WHERE a.fold <> b.fold")
def _(s, d):
    per = evaluated(s, d).groupBy("fold").agg(F.sum("p").alias("v"))
    # Both sides have one row a fold.
    both = per.selectExpr("fold AS fold_a", "v AS a").join(F.broadcast(per.selectExpr("fold AS fold_b", "v AS b")), F.expr("fold_a <> fold_b"))
    return rounded(both.selectExpr("fold_a", "fold_b", "(a / b - 1) * 100 AS pct"), 6)


@query("ln09_max_gap", f"{E} SELECT count(*) AS n_common, CAST(0 AS BIGINT) AS n_only_one, round(max(abs(p - p2)), 9) AS gap FROM e")
def _(s, d):
    e = evaluated(s, d)
    return rounded(tables.max_gap(e.select("parcel_id", F.col("p").alias("v")), e.select("parcel_id", F.col("p2").alias("v")), ["parcel_id"], "v"))
