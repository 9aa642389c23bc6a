"""Queries of stand descriptions, of checked joins and of small relational operators over the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaframe.functions import forestry, strings
from sylvaframe.operators import assembly, relational, spatial
from sylvaframe.plans.grid import GRID, grid
from sylvaframe.plans.queries import E, EVAL, evaluated, over, query, rounded, table

#: Compositions as they are written down, one of each kind.
RAW = """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN '6fa 4mo' WHEN 1 THEN '10M0' WHEN 2 THEN ' 7FA–3no ' WHEN 3 THEN '5FA3MO2CA'
  WHEN 4 THEN 'none' WHEN 5 THEN '123' WHEN 6 THEN 'taiere rasa' WHEN 7 THEN concat(p_size % 9 + 1, 'GA-2XX') ELSE '4 mo  3 fa/1 di' END AS comp, p_size, p_retailprice FROM part"""
raw = over(RAW, "part")
CODES, BROADLEAF, CONIFEROUS = ["FA", "MO", "CA", "GI", "DI"], ["FA", "CA", "GI"], ["MO", "DI"]
_TIDY = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(upper(comp)), '\s+', ' ', 'g'), '(\d) ([A-Z])', '\1\2', 'g'), '[–—−]', '-', 'g'), '[-\s]+', '-', 'g'), '-')"
_FIXED = r"CASE WHEN t IN ('NONE', 'NAN', '') THEN '' WHEN t = '10M0' THEN '10MO' ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(\d{1,2})OMO\b', '\1MO', 'g'), '(\d{1,2})MP\b', '\1MO', 'g'), '(\d{1,2})NO\b', '\1MO', 'g'), '(\d{1,2})GA\b', '\1GI', 'g') END"
_KIND = r"CASE WHEN trim(f) = '' THEN 'EMPTY' WHEN regexp_full_match(f, '\d{1,3}') THEN 'NUMERIC_ONLY' WHEN f = 'CLEARCUT' OR regexp_matches(f, 'TAIE|RASE') THEN 'CLEARCUT' WHEN regexp_full_match(f, '\d{1,2}[A-Z]{2,4}') THEN 'SINGLE_PAIR' WHEN regexp_full_match(f, '(\d{1,2}[A-Z]{2,4}){2,}') THEN 'CONCATENATED_PAIRS' WHEN regexp_full_match(f, '(\d{1,2}[A-Z]{2,4}[\s\-]*){2,}') THEN 'DELIMITED_PAIRS' WHEN regexp_matches(f, '\d+[A-Z]{2,4}') THEN 'PARTIAL_PAIRING' ELSE 'UNKNOWN' END"
_PAIRS = r"""WITH r AS (SELECT *, """ + _TIDY + r""" AS t FROM (""" + RAW + r""")), f AS (SELECT *, """ + _FIXED + r""" AS f FROM r), k AS (SELECT *, """ + _KIND + r""" AS kind FROM f),
q AS (SELECT p_partkey, f, kind, i, CAST(regexp_extract(x, '\d+') AS INT) AS share, regexp_extract(x, '[A-Z]+') AS code FROM (SELECT p_partkey, f, kind, unnest(regexp_extract_all(f, '\d{1,2}[A-Z]{2,4}')) AS x, generate_subscripts(regexp_extract_all(f, '\d{1,2}[A-Z]{2,4}'), 1) AS i FROM k))"""


@query("pr12b_tidy", f"SELECT p_partkey, {_TIDY} AS comp FROM ({RAW})")
def _(s, d):
    return raw(s, d).select("p_partkey", forestry.tidy(F.col("comp")).alias("comp"))


@query("pr13_corrected", f"SELECT p_partkey, {_FIXED} AS comp FROM (SELECT p_partkey, {_TIDY} AS t FROM ({RAW}))")
def _(s, d):
    return raw(s, d).select("p_partkey", forestry.corrected(forestry.tidy(F.col("comp"))).alias("comp"))


@query("pr14_pattern", f"SELECT {_KIND} AS kind, count(*) AS n FROM (SELECT {_FIXED} AS f FROM (SELECT p_partkey, {_TIDY} AS t FROM ({RAW}))) GROUP BY ALL")
def _(s, d):
    return raw(s, d).groupBy(forestry.pattern(forestry.corrected(forestry.tidy(F.col("comp")))).alias("kind")).agg(F.count("*").alias("n"))


@query("pr16_canonical", _PAIRS + """, g AS (SELECT p_partkey, string_agg(share || code, ' ' ORDER BY share DESC, code) AS c, bool_and(code IN ('FA', 'MO', 'CA', 'GI', 'DI')) AS ok FROM q GROUP BY ALL)
SELECT k.p_partkey, CASE WHEN kind = 'CLEARCUT' THEN 'CLEARCUT' WHEN kind IN ('SINGLE_PAIR', 'CONCATENATED_PAIRS', 'DELIMITED_PAIRS') AND ok THEN c END AS comp FROM k LEFT JOIN g USING (p_partkey)""")
def _(s, d):
    return raw(s, d).select("p_partkey", forestry.canonical(F.col("comp"), CODES).alias("comp"))


@query("pr17_group_shares", _PAIRS + """, c AS (SELECT p_partkey, code, sum(share) AS s, min(i) AS i FROM q GROUP BY ALL), m AS (SELECT p_partkey, first(code ORDER BY s DESC, i) AS dominant FROM c GROUP BY ALL),
g AS (SELECT p_partkey, round(100.0 * coalesce(sum(share) FILTER (code IN ('MO', 'DI')), 0) / sum(share), 2) AS coniferous, round(100.0 * coalesce(sum(share) FILTER (code IN ('FA', 'CA', 'GI')), 0) / sum(share), 2) AS broadleaf FROM q GROUP BY ALL)
SELECT k.p_partkey, CAST(coniferous AS DOUBLE) AS coniferous, CAST(broadleaf AS DOUBLE) AS broadleaf, dominant FROM k LEFT JOIN g USING (p_partkey) LEFT JOIN m USING (p_partkey)""")
def _(s, d):
    x = forestry.corrected(forestry.tidy(F.col("comp")))
    return raw(s, d).withColumn("x", x).select("p_partkey", forestry.group_share(F.col("x"), CONIFEROUS).alias("coniferous"), forestry.group_share(F.col("x"), BROADLEAF).alias("broadleaf"), forestry.dominant_code(F.col("x")).alias("dominant"))


@query("pr18_positive", "SELECT p_partkey, CASE WHEN p_size > 40 THEN NULL ELSE CASE WHEN p_size - 20 > 0 THEN CAST(p_size - 20 AS DOUBLE) END END AS age FROM part")
def _(s, d):
    text = F.when(F.col("p_size") > 40, F.lit("n/a")).otherwise((F.col("p_size") - 20).cast("string"))
    return table(s, d, "part").select("p_partkey", strings.positive(text).alias("age"))


@query("pr19_stand_type", "SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size * 2 >= 70 THEN 'broadleaf' WHEN 100 - p_size * 2 >= 70 THEN 'coniferous' ELSE 'mixed' END AS kind FROM part")
def _(s, d):
    b = F.when(F.col("p_size") % 10 != 0, F.col("p_size") * 2.0)
    return table(s, d, "part").select("p_partkey", forestry.stand_type(b, 100 - b).alias("kind"))


@query("pr21_prefix", "SELECT CASE WHEN starts_with(p_brand, 'Brand#1') THEN 'one' WHEN starts_with(p_brand, 'Brand#2') THEN 'two' ELSE 'rest' END AS grp, count(*) AS n FROM part GROUP BY ALL")
def _(s, d):
    return table(s, d, "part").groupBy(forestry.prefixed(F.col("p_brand"), {"Brand#1": "one", "Brand#2": "two"}, "rest").alias("grp")).agg(F.count("*").alias("n"))


@query("pr01_reindex", "SELECT p_size, p_partkey, CAST(NULL AS VARCHAR) AS verdict FROM part")
def _(s, d):
    return assembly.reindexed(table(s, d, "part"), ["p_size", "p_partkey", "verdict"])


@query("pr02_not_null", "SELECT p_partkey, p_size FROM (SELECT p_partkey, nullif(p_size, 7) AS p_size FROM part) WHERE p_size IS NOT NULL")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.nullif("p_size", F.lit(7)).alias("p_size")).where("p_size IS NOT NULL")


@query("pr03_members", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS found FROM customer")
def _(s, d):
    some = table(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    own = table(s, d, "customer").select("c_custkey")
    return assembly.members(own, some, ["c_custkey"]).withColumn("found", F.lit(True)).union(assembly.members(own, some, ["c_custkey"], False).withColumn("found", F.lit(False)))


@query("pr07_fill", "SELECT p_partkey, coalesce(q, 0.0) AS q FROM part LEFT JOIN (SELECT l_partkey AS p_partkey, sum(l_quantity) AS q FROM lineitem WHERE l_linenumber = 7 GROUP BY ALL) USING (p_partkey)")
def _(s, d):
    per = table(s, d, "lineitem").where("l_linenumber = 7").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("q"))
    return assembly.looked_up(table(s, d, "part").select("p_partkey"), per, ["p_partkey"], {"q": 0.0})


@query("pr11_bands", "SELECT CAST(floor(c_acctbal / 1000) AS BIGINT) AS band, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM customer WHERE c_acctbal >= 0 GROUP BY ALL HAVING count(*) >= 100")
def _(s, d):
    own = table(s, d, "customer").where("c_acctbal >= 0").withColumn("band", relational.fixed_bins(F.col("c_acctbal"), [1000.0 * i for i in range(11)]).cast("long"))
    return rounded(own.groupBy("band").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean")).where("n >= 100"), 6)


@query("pr24_centres", f"WITH g AS ({GRID}) SELECT row, col, 500000 + 10.0 * (col + 0.5) AS x, 600000 - 10.0 * (row + 0.5) AS y FROM g")
def _(s, d):
    x, y = spatial.centre(F.col("row"), F.col("col"), (10.0, 0.0, 500000.0, 0.0, -10.0, 600000.0))
    return grid(s, d).select("row", "col", x.alias("x"), y.alias("y"))


@query("pr37_nodata", f"WITH g AS ({GRID}) SELECT row, col, nullif(z, 50) AS z, coalesce(nullif(z, 50), -9999) AS back FROM g")
def _(s, d):
    z = spatial.to_null(F.col("z"), 50.0)
    return grid(s, d).select("row", "col", z.alias("z"), spatial.from_null(z, -9999.0).alias("back"))


@query("pr38_ever", "SELECT l_orderkey, bool_or(l_discount > 0.09) AS ever FROM lineitem GROUP BY ALL")
def _(s, d):
    return spatial.ever(table(s, d, "lineitem"), ["l_orderkey"], F.col("l_discount") > 0.09)


@query("pr39_masks", "SELECT p_partkey, CASE WHEN abs(CAST(p_size AS DOUBLE) / 10 - 1) < 1e-8 THEN 1 ELSE 0 END AS one, CASE WHEN p_size IN (1, 5, 9) THEN 1 ELSE 0 END AS classes FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", spatial.is_one(F.col("p_size") / 10).alias("one"), spatial.in_classes(F.col("p_size"), [1, 5, 9]).alias("classes"))


@query("pr42_residuals", E + " SELECT parcel_id, round((p - y) * (p - y), 9) AS brier, round(y - p, 9) AS residual FROM e")
def _(s, d):
    return rounded(evaluated(s, d).select("parcel_id", ((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"), (F.col("y") - F.col("p")).alias("residual")))


@query("pr43_boundary", "SELECT p_brand, min(p_size) <= 1 + 0.02 * 49 AS at_low, max(p_size) >= 50 - 0.02 * 49 AS at_high FROM part GROUP BY ALL")
def _(s, d):
    own = table(s, d, "part").groupBy("p_brand").agg(F.min("p_size").alias("low"), F.max("p_size").alias("high"))
    return own.select("p_brand", relational.near_end(F.col("low"), 1.0, 50.0)[0].alias("at_low"), relational.near_end(F.col("high"), 1.0, 50.0)[1].alias("at_high"))


@query("pr44_prob_classes", E + " SELECT '[' || printf('%.2f', least(floor(p * 5), 4) / 5) || ', ' || printf('%.2f', (least(floor(p * 5), 4) + 1) / 5) || CASE WHEN p >= 0.8 THEN ']' ELSE ')' END AS class, count(*) AS n FROM e GROUP BY ALL")
def _(s, d):
    return evaluated(s, d).groupBy(relational.probability_class(F.col("p"), 5).alias("class")).agg(F.count("*").alias("n"))


@query("jn02_left_blocks", E + ", b AS (SELECT DISTINCT c_custkey % 20 + 1 AS block, c_custkey % 4 AS side FROM customer WHERE c_custkey <= 15) SELECT parcel_id, side FROM e LEFT JOIN b USING (block)")
def _(s, d):
    b = table(s, d, "customer").where("c_custkey <= 15").selectExpr("c_custkey % 20 + 1 AS block", "c_custkey % 4 AS side").distinct()
    return assembly.looked_up(evaluated(s, d), b, ["block"]).select("parcel_id", "side")


def _products(s, d):
    own = table(s, d, "lineitem")
    return {f"m{i}": own.where(f"l_linenumber = {i}").select(F.col("l_orderkey").alias("o_orderkey"), "l_discount") for i in (1, 4, 7)}


@query("jn04_assembly", "SELECT o_orderkey, " + ", ".join(f"coalesce(max(l_discount) FILTER (l_linenumber = {i}), 0.0) AS m{i}" for i in (1, 4, 7)) + " FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def _(s, d):
    return assembly.assembled(table(s, d, "orders").select("o_orderkey"), _products(s, d), "o_orderkey", "l_discount")


@query("jn05_map", "SELECT c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    names = table(s, d, "nation").join(F.broadcast(table(s, d, "region")), F.expr("n_regionkey = r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    return assembly.looked_up(table(s, d, "customer"), names, ["c_nationkey"]).select("c_custkey", "r_name")


@query("jn06_alignment", "SELECT (SELECT count(*) FROM lineitem) AS rows_a, (SELECT count(*) FROM orders) AS rows_b, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) AS both, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)) AS repeated")
def _(s, d):
    return assembly.alignment(table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), table(s, d, "orders").select("o_orderkey"), ["o_orderkey"])


@query("jn07_index_join", E + ", c AS (SELECT c_custkey AS parcel_id, c_acctbal FROM customer WHERE c_acctbal > 0) SELECT parcel_id, y, c_acctbal FROM e JOIN c USING (parcel_id)")
def _(s, d):
    c = table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("parcel_id"), "c_acctbal")
    return assembly.looked_up(evaluated(s, d).select("parcel_id", "y"), c, ["parcel_id"]).dropna(subset=["c_acctbal"])


@query("jn08_agreeing", E + " SELECT a.parcel_id, a.fold, a.p, b.p2, true AS agrees FROM e a JOIN e b USING (parcel_id) WHERE b.p2 > 0.5 AND a.parcel_id % 11 > 0 UNION ALL SELECT a.parcel_id, least(a.fold, 99), a.p, b.p2, false FROM e a JOIN e b USING (parcel_id) WHERE b.p2 > 0.5 AND a.parcel_id % 11 = 0")
def _(s, d):
    e = evaluated(s, d)
    other = e.where("p2 > 0.5").withColumn("fold", F.expr("IF(parcel_id % 11 = 0, 99, fold)"))
    return assembly.agreeing({"p": e.withColumn("v", F.col("p")), "p2": other.withColumn("v", F.col("p2"))}, "parcel_id", ["fold"], "v")


@query("jn09_two_keys", E + ", f AS (SELECT fold, stratum, avg(p) AS v FROM e GROUP BY ALL), g AS (SELECT fold, stratum, max(p2) AS w FROM e WHERE p2 < 0.999 AND fold < 5 GROUP BY ALL) SELECT fold, stratum, round(v, 6) AS v, w FROM f LEFT JOIN g USING (fold, stratum)")
def _(s, d):
    e = evaluated(s, d)
    g = e.where("p2 < 0.999 AND fold < 5").groupBy("fold", "stratum").agg(F.max("p2").alias("w"))
    return rounded(assembly.looked_up(e.groupBy("fold", "stratum").agg(F.avg("p").alias("v")), g, ["fold", "stratum"]), 6)


@query("jn12_excluded", E + " SELECT parcel_id, y FROM e WHERE fold <> 2 AND parcel_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def _(s, d):
    out = table(s, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("parcel_id"))
    return assembly.members(evaluated(s, d).where("fold <> 2").select("parcel_id", "y"), out, ["parcel_id"], False)


@query("jn21_point_sample", f"WITH g AS ({GRID}) SELECT s_suppkey, z FROM supplier JOIN g ON row = CAST(floor(s_suppkey * 53 % 97 / 10.0) AS BIGINT) AND col = CAST(floor(s_suppkey * 37 % 101 / 10.0) AS BIGINT)")
def _(s, d):
    pts = table(s, d, "supplier").select("s_suppkey", F.expr("cast(floor(s_suppkey * 53 % 97 / 10.0) AS long)").alias("row"), F.expr("cast(floor(s_suppkey * 37 % 101 / 10.0) AS long)").alias("col"))
    return pts.join(grid(s, d), ["row", "col"]).select("s_suppkey", "z")


@query("jn22_containment", "SELECT bool_and(s_suppkey * 37 % 101 >= 0 - 1 AND s_suppkey * 53 % 97 <= 95 + 1) AS ok, count(*) AS n FROM supplier")
def _(s, d):
    return table(s, d, "supplier").agg(F.bool_and(spatial.within(F.expr("s_suppkey * 37 % 101"), F.expr("s_suppkey * 53 % 97"), (0.0, 0.0, 1e9, 95.0), 1.0)).alias("ok"), F.count("*").alias("n"))


@query("jn24_specs", "SELECT n_name, k, r FROM nation, (SELECT unnest([1, 2, 3]) AS k), (SELECT unnest(['a', 'b']) AS r)")
def _(s, d):
    return relational.with_specs(table(s, d, "nation").select("n_name"), {"k": [1, 2, 3], "r": ["a", "b"]})


@query("ag37_crosstab", "SELECT s AS o_orderstatus, " + ", ".join(f"count(*) FILTER (o_orderpriority = '{p}') AS \"{p}\"" for p in ("1-URGENT", "5-LOW", "9-NONE")) + " FROM (SELECT unnest(['F', 'X']) AS s) LEFT JOIN orders ON o_orderstatus = s GROUP BY ALL")
def _(s, d):
    return assembly.crosstab(table(s, d, "orders"), "o_orderstatus", "o_orderpriority", ["F", "X"], ["1-URGENT", "5-LOW", "9-NONE"])


@query("ag11_duplicates", "SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(s, d):
    return assembly.duplicates(table(s, d, "lineitem"), ["l_orderkey", "l_returnflag"])


@query("ag11b_keep_last", "SELECT l_orderkey, max(l_linenumber) AS l_linenumber, last(l_quantity ORDER BY l_linenumber, l_extendedprice, l_quantity) AS l_quantity FROM lineitem GROUP BY ALL")
def _(s, d):
    return assembly.last_of(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), ["l_orderkey"], F.col("l_linenumber"), F.col("l_extendedprice"), F.col("l_quantity")).drop("l_extendedprice")


@query("wn12_run_starts", "SELECT l_orderkey, l_extendedprice, coalesce(lag(l_returnflag) OVER w <> l_returnflag, true) AS starts FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_returnflag)")
def _(s, d):
    return assembly.run_starts(table(s, d, "lineitem"), ["l_orderkey"], "l_returnflag", F.col("l_extendedprice"), F.col("l_returnflag")).select("l_orderkey", "l_extendedprice", "starts")


@query("st01_sort", "SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name DESC) AS place FROM nation")
def _(s, d):
    return relational.placed(table(s, d, "nation").select("n_regionkey", "n_name"), ["n_regionkey"], F.desc("n_name"))


@query("st02_stable_first", "SELECT p_brand, first(p_partkey ORDER BY p_size, p_retailprice, p_partkey) AS p_partkey FROM part GROUP BY ALL")
def _(s, d):
    return relational.best_row(table(s, d, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice"), ["p_brand"], F.col("p_size"), F.col("p_retailprice"), F.col("p_partkey")).select("p_brand", "p_partkey")


@query("st03_top_one", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 1")
def _(s, d):
    return table(s, d, "supplier").select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(1)


@query("st05_lexsort", "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey * 37 % 101, s_suppkey) AS place FROM supplier")
def _(s, d):
    return relational.placed(table(s, d, "supplier"), ["s_nationkey"], F.expr("s_suppkey * 37 % 101"), F.col("s_suppkey")).select("s_suppkey", "place")


@query("st06_importance", "SELECT p_brand, w FROM (SELECT p_brand, round(sum(p_retailprice), 4) AS w FROM part GROUP BY ALL) ORDER BY w DESC, p_brand LIMIT 15")
def _(s, d):
    return rounded(table(s, d, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("w")), 4).orderBy(F.desc("w"), "p_brand").limit(15)


@query("st07_sample", "SELECT p_partkey FROM part ORDER BY p_partkey * 2654435761 % 4294967296, p_partkey LIMIT 100")
def _(s, d):
    return relational.sampled(table(s, d, "part").select("p_partkey"), 100, F.expr("p_partkey * 2654435761 % 4294967296"), F.col("p_partkey"))


@query("st08_newest_complete", "SELECT max(o_orderkey) AS run FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) = 7)")
def _(s, d):
    parts = table(s, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("part"))
    return relational.newest_complete(table(s, d, "orders").select(F.col("o_orderkey").alias("run")), parts, 7)


@query("so01_union_all", "SELECT c_nationkey AS k, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY ALL")
def _(s, d):
    both = [table(s, d, "customer").select(F.col("c_nationkey").alias("k")), table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))]
    return reduce(DataFrame.unionByName, both).groupBy("k").agg(F.count("*").alias("n"))


@query("so02_tagged", "SELECT k, level, count(*) AS n FROM (SELECT c_nationkey AS k, 'customer' AS level FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier) GROUP BY ALL")
def _(s, d):
    return assembly.tagged({"customer": table(s, d, "customer").select(F.col("c_nationkey").alias("k")), "supplier": table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))}, "level").groupBy("k", "level").agg(F.count("*").alias("n"))


@query("sc03_folds", E.replace("FROM orders", "FROM orders WHERE o_orderkey % 2 = 0") + " SELECT fold, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT 0, count(*) FROM (" + EVAL + ") WHERE parcel_id % 2 = 1")
def _(s, d):
    e = evaluated(s, d)
    return assembly.tagged({"a": e.where("parcel_id % 2 = 0"), "b": e.where("parcel_id % 2 = 1").withColumn("fold", F.lit(0).cast("long"))}, "part").groupBy("fold").agg(F.count("*").alias("n"))
