"""Queries of report tables, bootstraps, feature space and boxes over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvaframe.operators import boxes as bx
from sylvaframe.operators import calibration, featurespace, metrics, relational, reporting, resampling
from sylvaframe.plans.grid import BOXES, GRID, POINTS, boxes, grid, placed
from sylvaframe.plans.queries import E, evaluated, over, query, rounded, table

M = reporting.METRICS


def measured(z: str, w: str = "1") -> str:
    """SQL steps from z(g, y, p[, w]) to m(g, the eight metrics); w: a row's weight."""
    return f"""c AS (SELECT g, p, sum(y * {w}) AS pos, sum({w}) AS n FROM {z} GROUP BY g, p),
k AS (SELECT *, sum(pos) OVER w AS t, sum(n) OVER w AS h, sum(pos) OVER (PARTITION BY g) AS ap, sum(n) OVER (PARTITION BY g) AS an FROM c WINDOW w AS (PARTITION BY g ORDER BY p DESC)),
r AS (SELECT g, sum(pos / ap * t / h) AS pr_auc, sum(pos * ((an - ap) - (h - t) + (n - pos) / 2) / (ap * (an - ap))) AS roc_auc,
  CAST(sum(CASE WHEN p >= 0.5 THEN pos ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN p >= 0.5 THEN n - pos ELSE 0 END) AS DOUBLE) AS fp,
  CAST(sum(CASE WHEN p < 0.5 THEN pos ELSE 0 END) AS DOUBLE) AS fn, CAST(sum(CASE WHEN p < 0.5 THEN n - pos ELSE 0 END) AS DOUBLE) AS tn FROM k GROUP BY g),
m AS (SELECT g, pr_auc, roc_auc, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall, (tp + tn) / (tp + fp + fn + tn) AS accuracy,
  CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END - CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn) END AS tss,
  CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END AS mcc FROM r)"""


_LONG = "l AS (" + " UNION ALL ".join(f"SELECT g, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM m" for m in M) + ")"
_TABLES = E + ", z AS (SELECT CAST(fold AS VARCHAR) AS g, y, p FROM e UNION ALL SELECT 'all', y, p FROM e), " + measured("z") + ", " + _LONG + """,
s AS (SELECT metric, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS mn, max(value) AS mx FROM l WHERE g <> 'all' GROUP BY metric),
t AS (SELECT 'fold' AS level, g AS item, metric, value FROM l WHERE g <> 'all' UNION ALL SELECT 'pooled', g, metric, value FROM l WHERE g = 'all'
UNION ALL SELECT 'summary', 'mean', metric, mean FROM s UNION ALL SELECT 'summary', 'sd', metric, sd FROM s UNION ALL SELECT 'summary', 'min', metric, mn FROM s UNION ALL SELECT 'summary', 'max', metric, mx FROM s)"""
#: Draws as data: 40 replicates of 20 of 20 blocks.
DRAWS = "SELECT r AS replicate, (r * 7919 + i * 104729 + r * i * 31) % 20 + 1 AS block, count(*) AS times FROM (SELECT unnest(range(0, 40)) AS r), (SELECT unnest(range(1, 21)) AS i) GROUP BY ALL"
_BOOT = f"{E}, d AS ({DRAWS}), z AS (SELECT replicate || '/' || s AS g, y, CASE s WHEN 'p' THEN p ELSE p2 END AS p, times AS w FROM e JOIN d USING (block), (SELECT unnest(['p', 'p2']) AS s)), " + measured("z", "w") + ", " + _LONG


def drawn(s):
    picks = s.range(40).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("i"))
    return picks.groupBy("replicate", (F.expr("(replicate * 7919 + i * 104729 + replicate * i * 31) % 20 + 1")).alias("block")).agg(F.count("*").alias("times"))


def replicates(s, d):
    return reporting.bootstrap_metrics(evaluated(s, d), drawn(s), ["p", "p2"])


@query("ag20_fold_tables", _TABLES + " SELECT level, item, metric, round(value, 6) AS value FROM t")
def _(s, d):
    return rounded(reporting.fold_tables(evaluated(s, d)), 6)


@query("rs01b_paired_bootstrap", _BOOT + " SELECT CAST(split_part(g, '/', 1) AS BIGINT) AS replicate, split_part(g, '/', 2) AS score, " + ", ".join(f"round({m}, 6) AS {m}" for m in M) + " FROM m")
def _(s, d):
    return rounded(replicates(s, d), 6)


_ENDS = "v AS (SELECT metric, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM l WHERE g LIKE '%/p' GROUP BY metric)"


@query("rs03b_metric_intervals", _BOOT + ", " + _ENDS + " SELECT metric, round(low, 6) AS low, round(high, 6) AS high FROM v")
def _(s, d):
    return rounded(reporting.metric_intervals(replicates(s, d).where("score = 'p'")), 6)


_STATS = [("pooled", "level = 'pooled'"), *[(f"fold{i}", f"level = 'fold' AND item = '{i}'") for i in range(1, 7)], ("mean", "item = 'mean'"), ("sd", "item = 'sd'")]


@query("ag22_report_row", "WITH a AS (" + _TABLES + " SELECT * FROM t), b AS (" + _BOOT + ", " + _ENDS + " SELECT * FROM v) SELECT " + ", ".join([f"round((SELECT max(value) FROM a WHERE metric = '{m}' AND {w}), 6) AS {m}_{n}" for m in M for n, w in _STATS] + [f"round((SELECT max({e}) FROM b WHERE metric = '{m}'), 6) AS {m}_{e}" for m in M for e in ("low", "high")]))
def _(s, d):
    ends = reporting.metric_intervals(replicates(s, d).where("score = 'p'"))
    return rounded(reporting.wide_row(reporting.fold_tables(evaluated(s, d)), ends, [1, 2, 3, 4, 5, 6]), 6)


_DIFF = _BOOT + ", q AS (SELECT a.metric, split_part(a.g, '/', 1) AS replicate, a.value AS va, b.value AS vb, a.value - b.value AS d FROM l a JOIN l b ON a.metric = b.metric AND split_part(a.g, '/', 1) = split_part(b.g, '/', 1) WHERE a.g LIKE '%/p' AND b.g LIKE '%/p2')"
_P = "least(1.0, 2 * least((count(*) FILTER (d <= 0) + 1) / (count(d) + 1), (count(*) FILTER (d >= 0) + 1) / (count(d) + 1)))"


@query("ag23_contrasts", _DIFF + f" SELECT metric, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, round({_P}, 6) AS p FROM q GROUP BY metric")
def _(s, d):
    return rounded(reporting.contrasts(replicates(s, d), "p", "p2"), 6)


@query("wn07_holm_families", _DIFF + f""", f AS (SELECT metric, CASE WHEN metric LIKE '%auc' THEN 'rank' ELSE 'count' END AS family, {_P} AS p FROM q GROUP BY metric),
h AS (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, metric) + 1) * p AS s FROM f), a AS (SELECT *, least(1.0, max(s) OVER (PARTITION BY family ORDER BY p, metric)) AS p_holm FROM h)
SELECT metric, family, round(p_holm, 6) AS p_holm, p_holm < 0.05 AS reject FROM a""")
def _(s, d):
    own = reporting.contrasts(replicates(s, d), "p", "p2").withColumn("family", F.when(F.col("metric").endswith("auc"), "rank").otherwise("count"))
    return rounded(reporting.holm_families(own, "p", ["family"], "metric").select("metric", "family", "p_holm", "reject"), 6)


@query("rs09_relative_difference", _DIFF + ", x AS (SELECT metric, quantile_cont((va / vb - 1) * 100, 0.025) AS low, quantile_cont((va / vb - 1) * 100, 0.975) AS high FROM q WHERE metric = 'f1' GROUP BY metric) SELECT round(low, 5) AS low, round(high, 5) AS high, low > 0 OR high < 0 AS excludes_zero FROM x")
def _(s, d):
    wide = replicates(s, d).groupBy("replicate").agg(*[F.max(F.when(F.col("score") == k, F.col("f1"))).alias(k) for k in ("p", "p2")])
    return rounded(resampling.relative_difference(wide, "p", "p2"), 5)


@query("rs08_area_intervals", "WITH a AS (SELECT l_partkey % 500 AS r, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), q AS (SELECT unnest([0.9, 0.95, 0.99]) AS level) SELECT CAST(level AS DOUBLE) AS level, round((SELECT quantile_cont(v, [0.05, 0.025, 0.005]) FROM a)[CASE level WHEN 0.9 THEN 1 WHEN 0.95 THEN 2 ELSE 3 END], 4) AS low, round((SELECT quantile_cont(v, [0.95, 0.975, 0.995]) FROM a)[CASE level WHEN 0.9 THEN 1 WHEN 0.95 THEN 2 ELSE 3 END], 4) AS high FROM q")
def _(s, d):
    own = table(s, d, "lineitem").groupBy(F.expr("l_partkey % 500").alias("r")).agg(F.sum("l_quantity").alias("v"))
    return rounded(resampling.interval_levels(own, "v", [0.9, 0.95, 0.99]), 4)


@query("rs06_block_counts", E + """, b AS (SELECT unnest([5, 10, 20]) AS blocks), d AS (SELECT blocks, r AS replicate, (r * 7919 + i * 104729 + r * i * 31) % blocks AS block, count(*) AS times FROM b, (SELECT unnest(range(0, 40)) AS r), (SELECT unnest(range(1, 21)) AS i) WHERE i <= blocks GROUP BY ALL),
c AS (SELECT blocks, parcel_id % blocks AS block, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER ((p >= 0.5) <> (y = 1)) AS wrong FROM e, b GROUP BY ALL),
f AS (SELECT blocks, replicate, 2 * sum(tp * times) / (2 * sum(tp * times) + sum(wrong * times)) AS f1 FROM c JOIN d USING (blocks, block) GROUP BY ALL)
SELECT blocks, round(quantile_cont(f1, 0.975) - quantile_cont(f1, 0.025), 6) AS width FROM f GROUP BY ALL""")
def _(s, d):
    counts = [5, 10, 20]
    e = relational.with_specs(evaluated(s, d).select("parcel_id", "y", "p"), {"blocks": counts})
    hit = F.col("p") >= 0.5
    c = e.groupBy("blocks", F.expr("parcel_id % blocks").alias("block")).agg(F.count(F.when(hit & (F.col("y") == 1), 1)).alias("tp"), F.count(F.when(hit != (F.col("y") == 1), 1)).alias("wrong"))
    picks = relational.with_specs(s.range(40).withColumnRenamed("id", "replicate"), {"blocks": counts}).withColumn("i", F.explode(F.expr("sequence(1, blocks)")))
    draws = picks.groupBy("blocks", "replicate", F.expr("(replicate * 7919 + i * 104729 + replicate * i * 31) % blocks").alias("block")).agg(F.count("*").alias("times"))
    f1 = c.join(draws, ["blocks", "block"]).groupBy("blocks", "replicate").agg((2 * F.sum(F.col("tp") * F.col("times")) / (2 * F.sum(F.col("tp") * F.col("times")) + F.sum(F.col("wrong") * F.col("times")))).alias("f1"))
    return rounded(resampling.interval(f1, "f1", ["blocks"]).select("blocks", (F.col("high") - F.col("low")).alias("width")), 6)


@query("rs10_stratified_roc", f"{E}, d AS ({DRAWS}), z AS (SELECT replicate || '/' || stratum AS g, y, p, times AS w FROM e JOIN d USING (block)), " + measured("z", "w") + " SELECT split_part(g, '/', 2) AS stratum, round(quantile_cont(roc_auc, 0.025), 6) AS low, round(quantile_cont(roc_auc, 0.975), 6) AS high FROM m GROUP BY ALL")
def _(s, d):
    own = evaluated(s, d).select("block", "y", "p", "stratum").join(F.broadcast(drawn(s)), "block")
    by = metrics.weighted_ranking(own, "times", ["replicate", "stratum"])
    return rounded(resampling.interval(by, "roc_auc", ["stratum"]), 6)


@query("rs12_matched_arm", "WITH n AS (SELECT count(*) AS k FROM customer WHERE c_acctbal >= 5000) SELECT c_custkey, c_acctbal >= 5000 AS buffered, row_number() OVER (ORDER BY c_custkey * 2654435761 % 4294967296) <= k AS control FROM customer, n")
def _(s, d):
    return resampling.matched_arm(table(s, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 5000.0, F.expr("c_custkey * 2654435761 % 4294967296")).drop("c_acctbal")


@query("ag26_products", E + ", z AS (SELECT 'existing' AS g, y, CAST(stratum = 'F' AS INT) AS p FROM e UNION ALL SELECT 'in_sample', y, p2 FROM e UNION ALL SELECT 'out_of_fold', y, p FROM e), " + measured("z") + " SELECT g, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall FROM m")
def _(s, d):
    e = evaluated(s, d)
    p = F.array(*[F.struct(F.lit(g).alias("g"), x.cast("double").alias("p")) for g, x in (("existing", F.col("stratum") == "F"), ("in_sample", F.col("p2")), ("out_of_fold", F.col("p")))])
    return rounded(reporting.metric_rows(e.select("y", F.explode(p).alias("x")).select("y", "x.*"), ["g"]).select("g", "f1", "precision", "recall"), 6)


@query("ag02_product_fraction", "SELECT l_orderkey AS parcel, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM lineitem WHERE l_linenumber >= 2 GROUP BY ALL")
def _(s, d):
    return rounded(table(s, d, "lineitem").where("l_linenumber >= 2").groupBy(F.col("l_orderkey").alias("parcel")).agg(F.avg((F.col("l_returnflag") == "R").cast("double")).alias("fraction")), 6)


@query("ag05_eroded_fractions", f"WITH b AS ({BOXES}), c AS (SELECT id, unnest(range(CAST(ceil((xmin + 7) / 10 - 0.5) AS BIGINT), CAST(ceil((xmax - 7) / 10 - 0.5) AS BIGINT))) AS cx, ymin, ymax FROM b), k AS (SELECT id, cx, unnest(range(CAST(ceil((ymin + 7) / 10 - 0.5) AS BIGINT), CAST(ceil((ymax - 7) / 10 - 0.5) AS BIGINT))) AS cy FROM c) SELECT id, round(avg(CASE WHEN (cx + cy) % 2 = 0 THEN 1.0 ELSE 0 END), 6) AS even, round(avg(CASE WHEN cx % 3 = 0 THEN 1.0 ELSE 0 END), 6) AS third FROM k GROUP BY ALL")
def _(s, d):
    cells = bx.unit_cells(bx.buffered(boxes(s, d), -7.0), 10.0)
    return rounded(cells.groupBy("id").agg(F.avg(((F.col("cx") + F.col("cy")) % 2 == 0).cast("double")).alias("even"), F.avg((F.col("cx") % 3 == 0).cast("double")).alias("third")), 6)


@query("ag06_many_bands", "SELECT l_suppkey, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("l_quantity", "l_discount", "l_tax")) + " FROM lineitem GROUP BY ALL")
def _(s, d):
    return rounded(table(s, d, "lineitem").groupBy("l_suppkey").agg(*[F.avg(c).alias(c) for c in ("l_quantity", "l_discount", "l_tax")]), 6)


_R3 = "WITH r AS (SELECT CASE WHEN p_size > 20 THEN 1 ELSE 0 END AS a, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS b, CASE WHEN p_size % 3 > 0 THEN 1 ELSE 0 END AS c FROM part)"
three = over(_R3[len("WITH r AS ("):-1], "part")


@query("ag33_peers", _R3 + ", x AS (SELECT 'a' AS rater, CAST(a = b AS INT) + CAST(a = c AS INT) AS peers FROM r UNION ALL SELECT 'b', CAST(b = a AS INT) + CAST(b = c AS INT) FROM r UNION ALL SELECT 'c', CAST(c = a AS INT) + CAST(c = b AS INT) FROM r) SELECT k.rater, k.peers, count(x.peers) AS n FROM (SELECT unnest(['a', 'b', 'c']) AS rater) CROSS JOIN (SELECT unnest([0, 1, 2]) AS peers) k LEFT JOIN x USING (rater, peers) GROUP BY ALL".replace("SELECT k.rater, k.peers, count(x.peers) AS n FROM (SELECT unnest(['a', 'b', 'c']) AS rater) CROSS JOIN (SELECT unnest([0, 1, 2]) AS peers) k LEFT JOIN x USING (rater, peers)", "SELECT k.rater, k.peers, count(x.peers) AS n FROM (SELECT rater, peers FROM (SELECT unnest(['a', 'b', 'c']) AS rater), (SELECT unnest([0, 1, 2]) AS peers)) k LEFT JOIN x ON k.rater = x.rater AND k.peers = x.peers"))
def _(s, d):
    return reporting.peer_agreement(three(s, d), ["a", "b", "c"])


@query("ag41_weighted_shares", "SELECT split_part(p_type, ' ', 1) AS code, round(sum(p_size * p_retailprice), 4) AS w FROM part GROUP BY ALL ORDER BY w DESC, code LIMIT 5")
def _(s, d):
    own = table(s, d, "part").select(F.explode(F.slice(F.split("p_type", " "), 1, 1)).alias("code"), (F.col("p_size") * F.col("p_retailprice")).alias("w"))
    return rounded(own.groupBy("code").agg(F.sum("w").alias("w")), 4).orderBy(F.desc("w"), "code").limit(5)


@query("ag43_positive_area", f"WITH g AS ({GRID}) SELECT round(count(*) FILTER (z > 25) * 0.01, 6) AS ha FROM g")
def _(s, d):
    return rounded(grid(s, d).agg((F.sum((F.col("z") > 25).cast("int")) * 0.01).alias("ha")), 6)


@query("ag45_balance", E + ", t AS (SELECT fold, sum(p) AS total FROM e GROUP BY ALL), w AS (SELECT avg(total) AS m, max(total) / min(total) AS ratio FROM t) SELECT fold, round(total, 4) AS total, round(abs(total / m - 1), 6) AS deviation, abs(total / m - 1) <= 0.02 AS balanced, round(ratio, 6) AS ratio FROM t, w")
def _(s, d):
    return reporting.balance(evaluated(s, d), "fold", "p", 0.02).select("fold", F.round("total", 4).alias("total"), F.round("deviation", 6).alias("deviation"), "balanced", F.round("ratio", 6).alias("ratio"))


_GAPS = "g AS (SELECT unnest([0, 2500, 5000, 7500]) AS gap)"


@query("ag46_gap_counts", E + ", " + _GAPS + ", c AS (SELECT c_custkey, c_acctbal, c_custkey % 6 + 1 AS fold, c_custkey % 3 AS y3 FROM customer) SELECT gap, fold, count(*) FILTER (c_acctbal >= gap) AS kept, count(*) FILTER (c_acctbal < gap) AS excluded, round(avg(CASE WHEN c_acctbal >= gap THEN CASE WHEN y3 = 0 THEN 1.0 ELSE 0.0 END END), 6) AS prevalence FROM c, g GROUP BY ALL")
def _(s, d):
    own = relational.with_specs(table(s, d, "customer").select("c_acctbal", F.expr("c_custkey % 6 + 1").alias("fold"), F.expr("c_custkey % 3").alias("y3")), {"gap": [0, 2500, 5000, 7500]})
    far = F.col("c_acctbal") >= F.col("gap")
    return rounded(own.groupBy("gap", "fold").agg(F.count(F.when(far, 1)).alias("kept"), F.count(F.when(~far, 1)).alias("excluded"), F.avg(F.when(far, (F.col("y3") == 0).cast("double"))).alias("prevalence")), 6)


@query("ag47_starved", "WITH " + _GAPS + ", k AS (SELECT gap, c_custkey % 6 AS fold, avg(CASE WHEN c_acctbal >= gap THEN 1.0 ELSE 0.0 END) AS kept FROM customer, g GROUP BY ALL), m AS (SELECT gap, min(kept) AS least FROM k GROUP BY ALL) SELECT min(gap) AS gap FROM m WHERE least < 0.5")
def _(s, d):
    own = relational.with_specs(table(s, d, "customer").select("c_acctbal", F.expr("c_custkey % 6").alias("fold")), {"gap": [0, 2500, 5000, 7500]})
    per = own.groupBy("gap", "fold").agg(F.avg((F.col("c_acctbal") >= F.col("gap")).cast("double")).alias("kept"))
    return per.groupBy("gap").agg(F.min("kept").alias("least")).where("least < 0.5").agg(F.min("gap").alias("gap"))


@query("ag48_flag_summary", f"WITH g AS ({GRID}), f AS (SELECT z > 10 AS forest, row % 3 = 0 AS inside FROM g) SELECT forest, inside, count(*) * 0.01 AS ha FROM f GROUP BY GROUPING SETS ((forest, inside), (forest), ())")
def _(s, d):
    own = grid(s, d).select((F.col("z") > 10).alias("forest"), (F.col("row") % 3 == 0).alias("inside"))
    return own.groupingSets([[F.col("forest"), F.col("inside")], [F.col("forest")], []], "forest", "inside").agg((F.count("*") * 0.01).alias("ha"))


@query("ag49_reliability", "WITH c AS (SELECT r_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL) SELECT r_name, c_mktsegment, n, sum(n) OVER (PARTITION BY r_name) >= 250 AS reliable FROM c")
def _(s, d):
    names = table(s, d, "nation").join(F.broadcast(table(s, d, "region")), F.expr("n_regionkey = r_regionkey"))
    per = table(s, d, "customer").join(F.broadcast(names), F.expr("c_nationkey = n_nationkey")).groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("n"))
    return relational.with_group_total(per, ["r_name"], "n").select("r_name", "c_mktsegment", "n", (F.col("total") >= 250).alias("reliable"))


@query("wn11_group_total", "SELECT s_suppkey, round(sum(s_acctbal) OVER (PARTITION BY s_nationkey), 4) AS total FROM supplier")
def _(s, d):
    return rounded(relational.with_group_total(table(s, d, "supplier"), ["s_nationkey"], "s_acctbal").select("s_suppkey", "total"), 4)


@query("ag50_participation", "WITH w AS (SELECT p_brand, p_type, sum(p_retailprice) AS w FROM part GROUP BY ALL) SELECT p_brand, round(sum(w) * sum(w) / sum(w * w), 6) AS participation FROM w GROUP BY ALL")
def _(s, d):
    return rounded(reporting.participation(table(s, d, "part").groupBy("p_brand", "p_type").agg(F.sum("p_retailprice").alias("w")), ["p_brand"], "w"), 6)


@query("ag51_trial_spread", "WITH r AS (SELECT p_brand, p_retailprice AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS i FROM part) SELECT p_brand, max(v) AS best, round(max(v) - min(v), 6) AS range, round(max(v) - quantile_cont(v, 0.5), 6) AS over_median, round(max(v) - min(v) FILTER (i <= 5), 6) AS top_range FROM r GROUP BY ALL")
def _(s, d):
    return rounded(reporting.spread(table(s, d, "part"), ["p_brand"], "p_retailprice", 5), 6)


@query("ag52_seed_spread", "SELECT s_nationkey, round(avg(s_acctbal), 6) AS mean, round(stddev_samp(s_acctbal), 6) AS sd, min(s_acctbal) AS low, max(s_acctbal) AS high, max(s_acctbal) FILTER (s_suppkey % 7 = 0) AS told FROM supplier GROUP BY ALL")
def _(s, d):
    return rounded(table(s, d, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("mean"), F.stddev_samp("s_acctbal").alias("sd"), F.min("s_acctbal").alias("low"), F.max("s_acctbal").alias("high"), F.max(F.when(F.col("s_suppkey") % 7 == 0, F.col("s_acctbal"))).alias("told")), 6)


@query("ag54_area_inside", f"WITH g AS ({GRID}) SELECT count(*) FILTER (z > 30 AND row BETWEEN 5 AND 20) * 0.01 AS ha FROM g")
def _(s, d):
    return grid(s, d).where("row BETWEEN 5 AND 20").agg((F.count(F.when(F.col("z") > 30, 1)) * 0.01).alias("ha"))


@query("ag55_domain_counts", f"WITH g AS ({GRID}) SELECT count(*) FILTER (z > 30 AND col < 20) AS inside, count(*) FILTER (z > 30 AND col >= 20) AS outside FROM g")
def _(s, d):
    yes = lambda c: F.count(F.when((F.col("z") > 30) & c, 1))
    return grid(s, d).agg(yes(F.col("col") < 20).alias("inside"), yes(F.col("col") >= 20).alias("outside"))


@query("ag56_mosaic", f"WITH g AS ({GRID}) SELECT row, col, coalesce(nullif(z, 50), z + 100) AS z FROM g")
def _(s, d):
    g = grid(s, d)
    return relational.first_valid({1: g.withColumn("z", F.nullif("z", F.lit(50.0))), 2: g.withColumn("z", F.col("z") + 100)}, ["row", "col"], "z")


@query("ag57_common_valid", f"WITH g AS ({GRID}) SELECT row, col, z <> 50 AND (row + col) % 5 > 0 AS valid FROM g")
def _(s, d):
    g = grid(s, d)
    both = g.select("row", "col", (F.col("z") != 50).alias("v")).union(g.select("row", "col", ((F.col("row") + F.col("col")) % 5 > 0).alias("v")))
    return both.groupBy("row", "col").agg(F.bool_and("v").alias("valid"))


@query("ag59_overlap_sweep", "SELECT t / 100.0 AS threshold, count(*) FILTER (p_size / 50.0 >= t / 100.0) AS yes, count(*) FILTER (p_size / 50.0 < t / 100.0) AS no FROM part, (SELECT unnest(range(70, 100)) AS t) GROUP BY ALL")
def _(s, d):
    own = relational.with_specs(table(s, d, "part").groupBy("p_size").agg(F.count("*").alias("n")), {"t": list(range(70, 100))})
    hit = F.col("p_size") / 50.0 >= F.col("t") / 100.0
    return own.groupBy((F.col("t") / 100.0).alias("threshold")).agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(hit, 0).otherwise(F.col("n"))).alias("no"))


@query("ag60_dominance_sweep", "WITH s AS (SELECT t, avg(CASE WHEN (p_size * 2 >= t) = (p_retailprice > 1200) THEN 1.0 ELSE 0 END) AS agreement FROM part, (SELECT unnest(range(50, 95, 5)) AS t) GROUP BY ALL) SELECT t, round(agreement, 6) AS agreement, t = (SELECT arg_max(t, (agreement, -t)) FROM s) AS best FROM s")
def _(s, d):
    own = relational.with_specs(table(s, d, "part").select("p_size", "p_retailprice"), {"t": list(range(50, 95, 5))})
    per = own.groupBy("t").agg(F.avg(((F.col("p_size") * 2 >= F.col("t")) == (F.col("p_retailprice") > 1200)).cast("double")).alias("agreement"))
    best = per.agg(F.max_by("t", F.struct("agreement", -F.col("t"))).alias("_b"))
    return per.crossJoin(F.broadcast(best)).select("t", F.round("agreement", 6).alias("agreement"), (F.col("t") == F.col("_b")).alias("best"))


@query("ag61_two_level_quantiles", "WITH m AS (SELECT p_brand, quantile_cont(p_retailprice, 0.5) AS v FROM part WHERE p_size < 40 GROUP BY ALL) SELECT round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS q2, round(quantile_cont(v, 0.75), 6) AS q3 FROM m")
def _(s, d):
    per = table(s, d, "part").where("p_size < 40").groupBy("p_brand").agg(F.percentile("p_retailprice", 0.5).alias("v"))
    return rounded(per.agg(*[F.percentile("v", q).alias(n) for n, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))]), 6)


@query("ag62_class_medians", "SELECT o_orderstatus, o_orderpriority, quantile_cont(o_totalprice, 0.5) AS median, count(*) AS n, round(avg(CASE WHEN o_custkey % 2 = o_orderkey % 2 THEN 1.0 ELSE 0 END), 6) AS agree FROM orders GROUP BY ALL")
def _(s, d):
    return rounded(table(s, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.percentile("o_totalprice", 0.5).alias("median"), F.count("*").alias("n"), F.avg((F.col("o_custkey") % 2 == F.col("o_orderkey") % 2).cast("double")).alias("agree")), 6)


@query("ag63_site_areas", f"WITH g AS ({GRID}), c AS (SELECT row % 4 AS class, count(*) * 0.01 AS ha, min(z) AS low, max(z) AS high, avg(z) AS mean FROM g GROUP BY ALL) SELECT class, ha, round(ha / sum(ha) OVER (), 6) AS share, low, high, round(mean, 6) AS mean FROM c")
def _(s, d):
    per = grid(s, d).groupBy((F.col("row") % 4).alias("class")).agg((F.count("*") * 0.01).alias("ha"), F.min("z").alias("low"), F.max("z").alias("high"), F.avg("z").alias("mean"))
    whole = per.agg(F.sum("ha").alias("_t"))
    return per.crossJoin(F.broadcast(whole)).select("class", "ha", F.round(F.col("ha") / F.col("_t"), 6).alias("share"), "low", "high", F.round("mean", 6).alias("mean")).orderBy(F.desc("ha"))


@query("wn09_bin_windows", E + ", z AS (SELECT CAST(floor(p2 * 5) AS INT) AS g, y, p FROM e), " + measured("z") + " SELECT g AS bin, round(f1, 6) AS f1, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc FROM m")
def _(s, d):
    own = evaluated(s, d).withColumn("bin", relational.fixed_bins(F.col("p2"), [0.0, 0.2, 0.4, 0.6, 0.8]))
    return rounded(reporting.metric_rows(own, ["bin"]).select("bin", "f1", "pr_auc", "roc_auc"), 6)


_ARMS = "a AS (SELECT (o_orderkey % 12) AS gap, CASE WHEN o_custkey % 2 = 0 THEN 'buffered' ELSE 'control' END AS arm, avg(o_totalprice) AS v FROM orders GROUP BY ALL)"


def _arms(s, d):
    return table(s, d, "orders").groupBy((F.col("o_orderkey") % 12).alias("gap"), F.when(F.col("o_custkey") % 2 == 0, "buffered").otherwise("control").alias("arm")).agg(F.avg("o_totalprice").alias("v"))


@query("wn15_adjusted_series", "WITH " + _ARMS + ", w AS (SELECT gap, max(v) FILTER (arm = 'buffered') AS b, max(v) FILTER (arm = 'control') AS c FROM a GROUP BY ALL) SELECT gap, round(b - c + (SELECT c FROM w WHERE gap = 0), 4) AS adjusted FROM w WHERE gap <= 10")
def _(s, d):
    return rounded(reporting.adjusted_series(_arms(s, d), "gap", "arm", "v", "buffered", "control", 10).select("gap", "adjusted"), 4)


@query("wn16_gap_change", "WITH " + _ARMS + " SELECT gap, round(max(v) FILTER (arm = 'buffered') - max(v) FILTER (arm = 'control'), 4) AS change FROM a GROUP BY ALL")
def _(s, d):
    return rounded(reporting.adjusted_series(_arms(s, d), "gap", "arm", "v", "buffered", "control", 99).select("gap", "change"), 4)


@query("wn17_leave_one_out", E + ", z AS (SELECT o AS g, y, p FROM e, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS o) WHERE fold <> o), " + measured("z") + " SELECT CAST(g AS BIGINT) AS left_out, round(f1, 6) AS f1, round(pr_auc, 6) AS pr_auc FROM m")
def _(s, d):
    return rounded(reporting.leave_one_out(evaluated(s, d), "fold", reporting.metric_rows).select("left_out", "f1", "pr_auc"), 6)


@query("wn19_fold_thresholds", E + ", t AS (SELECT fold, avg(p) AS threshold FROM e WHERE y = 1 GROUP BY ALL) SELECT parcel_id, p >= threshold AS verdict FROM e JOIN t USING (fold) WHERE abs(p - threshold) > 1e-9")
def _(s, d):
    e = evaluated(s, d)
    t = e.where("y = 1").groupBy("fold").agg(F.avg("p").alias("threshold"))
    return e.join(F.broadcast(t), "fold").where("abs(p - threshold) > 1e-9").select("parcel_id", (F.col("p") >= F.col("threshold")).alias("verdict"))


@query("ca02_reliability", E + ", b AS (SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, avg(p) AS predicted, avg(y) AS observed, sum(y) AS k FROM e GROUP BY ALL) SELECT bin, n, round(predicted, 6) AS predicted, round(observed, 6) AS observed, round((observed + 3.841458820694124 / (2 * n) - 1.959963984540054 * sqrt(observed * (1 - observed) / n + 3.841458820694124 / (4.0 * n * n))) / (1 + 3.841458820694124 / n), 6) AS low FROM b")
def _(s, d):
    bins = evaluated(s, d).groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg("y").alias("observed"), F.sum("y").alias("k"))
    return rounded(bins.select("bin", "n", "predicted", "observed", resampling.wilson(F.col("k"), F.col("n"))[0].alias("low")), 6)


@query("ca09_best_calibrator", E + ", m AS (SELECT 'p' AS method, avg((p - y) * (p - y)) AS brier, abs(avg(p) - avg(y)) AS ece FROM e UNION ALL SELECT 'p2', avg((p2 - y) * (p2 - y)), abs(avg(p2) - avg(y)) FROM e) SELECT method FROM m ORDER BY ece, brier LIMIT 1")
def _(s, d):
    x = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("q")) for m in ("p", "p2")])
    per = evaluated(s, d).select("y", F.explode(x).alias("x")).groupBy("x.method").agg(F.avg((F.col("x.q") - F.col("y")) * (F.col("x.q") - F.col("y"))).alias("brier"), F.abs(F.avg("x.q") - F.avg("y")).alias("ece"))
    return calibration.best_method(per).select("method")


@query("jn16_all_pairs", f"WITH p AS ({POINTS}), d AS (SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON a.fold < b.fold AND a.fold <= 2 AND b.fold <= 2) SELECT round(quantile_cont(d, 0.05), 6) AS p05, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.95), 6) AS p95 FROM d")
def _(s, d):
    own = placed(s, d).where("fold <= 2")
    a, b = own.select(F.col("fold").alias("f"), F.col("x").alias("ax"), F.col("y").alias("ay")), own.select(F.col("fold").alias("g"), F.col("x").alias("bx"), F.col("y").alias("by"))
    apart = a.join(b, F.expr("f < g")).select(F.sqrt((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))).alias("d"))
    return rounded(apart.agg(*[F.percentile("d", q).alias(n) for n, q in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))]), 6)


def _featured(s, d):
    own = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.expr("c_custkey % 6").alias("fold"), F.expr("c_acctbal / 1000").alias("u"), F.expr("cast(c_custkey * 37 % 101 AS double)").alias("v"))
    return featurespace.scaled(own, ["u", "v"], featurespace.fitted(own, ["u", "v"]), [0.7, 0.3])


_FEAT = "WITH c AS (SELECT c_custkey AS id, c_custkey % 6 AS fold, c_acctbal / 1000 AS u, CAST(c_custkey * 37 % 101 AS DOUBLE) AS v FROM customer), m AS (SELECT avg(u) AS mu, stddev_pop(u) AS su, avg(v) AS mv, stddev_pop(v) AS sv FROM c), x AS (SELECT id, fold, (u - mu) / su * 0.7 AS a, (v - mv) / sv * 0.3 AS b FROM c, m)"


@query("pr28_weighted_scaling", _FEAT + " SELECT id, round(a, 6) AS a, round(b, 6) AS b FROM x")
def _(s, d):
    return rounded(_featured(s, d).select("id", F.get("x", F.lit(0)).alias("a"), F.get("x", F.lit(1)).alias("b")), 6)


_NN = ", n AS (SELECT q.id, min(sqrt((q.a - r.a) ** 2 + (q.b - r.b) ** 2)) AS distance FROM x q JOIN x r ON q.id <> r.id {} GROUP BY q.id)"


@query("jn19_nearest_features", _FEAT + _NN.format("") + " SELECT id, round(distance, 5) AS distance FROM n")
def _(s, d):
    own = _featured(s, d)
    return rounded(featurespace.nearest(own, own).select("id", "distance"), 5)


@query("jn20_nearest_other_fold", _FEAT + _NN.format("AND q.fold <> r.fold") + " SELECT id, round(distance, 5) AS distance FROM n")
def _(s, d):
    own = _featured(s, d)
    return rounded(featurespace.nearest(own, own, "fold").select("id", "distance"), 5)


_MEAN = ", s AS (SELECT * FROM x WHERE id <= 300), w AS (SELECT avg(sqrt((q.a - r.a) ** 2 + (q.b - r.b) ** 2)) AS mean FROM s q JOIN s r ON q.id <> r.id)"


@query("ao02_mean_distance", _FEAT + _MEAN + " SELECT round(mean, 6) AS mean FROM w")
def _(s, d):
    return rounded(featurespace.mean_distance(_featured(s, d).where("id <= 300")), 6)


_ALL = ", w AS (SELECT avg(sqrt((q.a - r.a) ** 2 + (q.b - r.b) ** 2)) AS mean FROM x q JOIN x r ON q.id <> r.id)"


@query("ao06_applicability", _FEAT + _ALL + _NN.format("AND q.fold <> r.fold") + ", k AS (SELECT id, distance / mean AS di FROM n, w), f AS (SELECT quantile_cont(di, 0.75) * 2.5 - quantile_cont(di, 0.25) * 1.5 AS fence FROM k), t AS (SELECT max(di) AS threshold FROM k, f WHERE di <= fence) SELECT id, round(di, 5) AS di, di <= threshold AS inside FROM k, t")
def _(s, d):
    own = _featured(s, d)
    di = featurespace.nearest(own, own, "fold").crossJoin(F.broadcast(featurespace.mean_distance(own))).select("id", featurespace.dissimilarity(F.col("distance"), F.col("mean")).alias("di"))
    return di.crossJoin(F.broadcast(featurespace.upper_fence(di, "di"))).select("id", F.round("di", 5).alias("di"), (F.col("di") <= F.col("threshold")).alias("inside"))


@query("ao08_mask_sensitivity", "SELECT rule, threshold, round(avg(CASE WHEN p_size / 50.0 <= threshold THEN 1.0 ELSE 0 END), 6) AS inside, round(avg(CASE WHEN p_size / 50.0 <= threshold THEN 1.0 ELSE 0 END) FILTER (p_partkey % 2 = 0), 6) AS inside_masked, round(avg(CASE WHEN p_size / 50.0 <= threshold + 0.01 THEN 1.0 ELSE 0 END) - avg(CASE WHEN p_size / 50.0 <= threshold THEN 1.0 ELSE 0 END), 6) AS slope FROM part, (SELECT unnest(['low', 'high']) AS rule, CAST(unnest([0.305, 0.695]) AS DOUBLE) AS threshold) GROUP BY ALL")
def _(s, d):
    return rounded(featurespace.mask_sensitivity(table(s, d, "part").withColumn("di", F.col("p_size") / 50.0), "di", {"low": 0.305, "high": 0.695}, F.col("p_partkey") % 2 == 0), 6)


@query("jn17_distance_to_set", f"WITH p AS ({POINTS}) SELECT a.id, round(min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) AS distance FROM p a JOIN p b ON b.fold = 2 WHERE a.fold <> 2 GROUP BY ALL")
def _(s, d):
    p = placed(s, d).select("id", "fold", F.array("x", "y").alias("x"))
    return rounded(featurespace.nearest(p.where("fold <> 2"), p.where("fold = 2")).select("id", "distance"), 6)


@query("ac03_lag_centres", "SELECT i, (i + 0.5) * 2.5 AS centre FROM (SELECT unnest(range(0, 16)) AS i)")
def _(s, d):
    from sylvaframe.operators import points

    return points.lag_centres(s, [2.5 * (i + 1) for i in range(16)])


@query("ac04_unresolved", "SELECT p_partkey, p_size IS NULL OR p_size >= 0.9 * 50 OR p_size < 50 / 10.0 AS unresolved FROM part")
def _(s, d):
    from sylvaframe.operators import points

    return table(s, d, "part").select("p_partkey", points.unresolved(F.col("p_size"), 50.0, 10).alias("unresolved"))


@query("ac09_residual_points", f"{E}, q AS ({POINTS}) SELECT parcel_id, x, q.y AS northing, round(e.y - p, 9) AS residual FROM e JOIN q ON parcel_id = id")
def _(s, d):
    q = placed(s, d).select(F.col("id").alias("parcel_id"), "x", F.col("y").alias("northing"))
    return rounded(evaluated(s, d).join(q, "parcel_id").select("parcel_id", "x", "northing", (F.col("y") - F.col("p")).alias("residual")))


@query("ac10_wide_summary", "SELECT p_brand, " + ", ".join(f"round(avg(p_retailprice) FILTER (p_size % 3 = {i}), 6) AS model{i}" for i in range(3)) + ", arg_min(p_size % 3, (p_retailprice, p_partkey)) AS best FROM part GROUP BY ALL")
def _(s, d):
    own = table(s, d, "part").withColumn("m", F.col("p_size") % 3)
    return rounded(own.groupBy("p_brand").agg(*[F.avg(F.when(F.col("m") == i, F.col("p_retailprice"))).alias(f"model{i}") for i in range(3)], F.min_by("m", F.struct("p_retailprice", "p_partkey")).alias("best")), 6)


_B = f"WITH b AS ({BOXES})"


@query("sp01_repair", _B + " SELECT id, xmin, ymin, xmax, ymax FROM b WHERE id % 5 > 0")
def _(s, d):
    b = boxes(s, d)
    flipped = b.select("id", F.when(F.col("id") % 2 == 0, F.col("xmax")).otherwise(F.col("xmin")).alias("xmin"), "ymin", F.when(F.col("id") % 2 == 0, F.col("xmin")).otherwise(F.col("xmax")).alias("xmax"), F.when(F.col("id") % 5 == 0, F.col("ymin")).otherwise(F.col("ymax")).alias("ymax"))
    return bx.repaired(flipped)


@query("sp02_clip", _B + " SELECT id, greatest(xmin, 100) AS xmin, greatest(ymin, 200) AS ymin, least(xmax, 700) AS xmax, least(ymax, 600) AS ymax FROM b WHERE xmin < 700 AND xmax > 100 AND ymin < 600 AND ymax > 200")
def _(s, d):
    return bx.clipped(boxes(s, d), (100.0, 200.0, 700.0, 600.0))


_CELLS = ", x AS (SELECT id, xmin, xmax, ymin, ymax, unnest(range(CAST(ceil(xmin / 10 - 0.5) AS BIGINT), CAST(ceil(xmax / 10 - 0.5) AS BIGINT))) AS cx FROM b), k AS (SELECT id, cx, (xmax - xmin) * (ymax - ymin) AS whole, unnest(range(CAST(ceil(ymin / 10 - 0.5) AS BIGINT), CAST(ceil(ymax / 10 - 0.5) AS BIGINT))) AS cy FROM x)"


@query("sp03_deoverlap", _B.replace("FROM supplier)", "+ CASE WHEN s_suppkey % 3 = 0 THEN 20 ELSE 0 END AS ymax FROM supplier)").replace(" AS ymax +", " +") + _CELLS + ", o AS (SELECT cx, cy, arg_min(id, (-whole, id)) AS id FROM k GROUP BY ALL), a AS (SELECT id, count(*) * 100.0 AS area FROM o GROUP BY ALL), w AS (SELECT id, any_value(whole) AS whole FROM k GROUP BY ALL) SELECT id, area, round(area / whole, 6) AS part FROM a JOIN w USING (id) WHERE area >= 200 AND area / whole >= 0.1")
def _(s, d):
    own = boxes(s, d).withColumn("ymax", F.expr("ymax + IF(id % 3 = 0, 20, 0)"))
    return rounded(bx.deoverlapped(own, 10.0, True, 200.0, 0.1), 6)


@query("sp04_erase", _B + _CELLS + " SELECT id, count(*) * 100.0 AS area FROM k WHERE id % 4 > 0 AND (cx, cy) NOT IN (SELECT (cx, cy) FROM k WHERE id % 4 = 0) GROUP BY ALL")
def _(s, d):
    b = boxes(s, d)
    return bx.erased(b.where("id % 4 > 0"), b.where("id % 4 = 0"), 10.0)


@query("sp05_buffer", _B + " SELECT id, xmin + 7.07 AS xmin, ymin + 7.07 AS ymin, xmax - 7.07 AS xmax, ymax - 7.07 AS ymax FROM b")
def _(s, d):
    return bx.buffered(boxes(s, d), -7.07)


@query("so08_dissolve", _B + _CELLS + " SELECT id % 7 AS k, count(DISTINCT (cx, cy)) * 100.0 AS area FROM k GROUP BY ALL")
def _(s, d):
    return bx.dissolved_area(boxes(s, d).withColumn("k", F.col("id") % 7), 10.0, ["k"])


@query("sp08_line_distance", f"WITH g AS ({GRID}), m AS (SELECT row, col FROM g WHERE z = 50), n AS (SELECT g.row, g.col, min((g.row - m.row) ** 2 + (g.col - m.col) ** 2) AS d2 FROM g, m GROUP BY ALL) SELECT row, col, CASE WHEN d2 <= 64 THEN round(sqrt(d2) * 10, 6) END AS distance FROM n")
def _(s, d):
    g = grid(s, d)
    return rounded(bx.cell_distance(g.select("row", "col"), g.where("z = 50"), 10.0, 8), 6)


@query("sp09_training_distance", f"WITH g AS ({GRID}), m AS (SELECT row, col FROM g WHERE (row * 40 + col) % 97 = 0), n AS (SELECT g.row, g.col, min((g.row - m.row) ** 2 + (g.col - m.col) ** 2) AS d2 FROM g, m GROUP BY ALL) SELECT row, col, CASE WHEN d2 <= 400 THEN round(sqrt(d2) * 0.01, 6) END AS distance FROM n")
def _(s, d):
    g = grid(s, d)
    return rounded(bx.cell_distance(g.select("row", "col"), g.where("(row * 40 + col) % 97 = 0"), 0.01, 20), 6)


@query("sp13_tiles", "SELECT t AS tile, CAST(t // 4 * 30 AS BIGINT) AS row, t % 4 * 30 AS col, least(30, 75 - t // 4 * 30) AS rows, least(30, 100 - t % 4 * 30) AS cols FROM (SELECT unnest(range(0, 12)) AS t)")
def _(s, d):
    return bx.tiles(100, 75, 30, s)


@query("sp13b_snapped", _B + " SELECT id, CAST(floor(xmin / 30) AS BIGINT) AS col_off, CAST(floor(ymin / 30) AS BIGINT) AS row_off, CAST(ceil(xmax / 30) - floor(xmin / 30) AS BIGINT) AS width, CAST(ceil(ymax / 30) - floor(ymin / 30) AS BIGINT) AS height FROM b")
def _(s, d):
    return bx.snapped(boxes(s, d), 30.0)


@query("sp15_road_lengths", "SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'major' WHEN '2-HIGH' THEN 'major' ELSE 'minor' END AS kind, round(sum(o_totalprice), 2) AS length FROM orders WHERE o_custkey % 100 <= 50 GROUP BY ALL")
def _(s, d):
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in ("1-URGENT", "major", "2-HIGH", "major")]), F.col("o_orderpriority")), F.lit("minor"))
    return rounded(table(s, d, "orders").where("o_custkey % 100 <= 50").groupBy(kind.alias("kind")).agg(F.sum("o_totalprice").alias("length")), 2)


@query("sp16_stack", f"WITH g AS ({GRID}) SELECT row, col, z AS height, z * 2 AS twice FROM g WHERE z <> 50 AND z > 3")
def _(s, d):
    g = grid(s, d)
    return bx.stacked({"height": g.withColumn("z", F.nullif("z", F.lit(50.0))), "twice": g.where("z > 3").withColumn("z", F.col("z") * 2)})
