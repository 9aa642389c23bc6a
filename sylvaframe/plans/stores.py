"""Queries of sources, sinks and checks, and those of fitted models, which SQL can't express (tests hold them against brute force)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sylvaframe.operators import calibration, models, partition, points
from sylvaframe.plans.grid import placed
from sylvaframe.plans.queries import E, QUERIES, evaluated, query, rounded, table
from sylvaframe.sources import tables


def plain(name: str):
    def put(f):
        QUERIES[name] = f
        return f

    return put


def _place(s) -> str:
    """A new path in the shared folder."""
    found = s.conf.get("spark.checkpoint.dir", None) or f"{s.conf.get('spark.sql.warehouse.dir').rstrip('/')}/sylvaframe-tables"
    return f"{found.rstrip('/')}/store-{uuid.uuid4().hex}"


@query("sc01_scan", "SELECT s_suppkey, s_acctbal FROM supplier")
def _(s, d):
    return tables.read_parquet(s, f"{d}/supplier.parquet", ["s_suppkey", "s_acctbal"])


@query("sc04_csv_round_trip", "SELECT s_suppkey, s_name, s_acctbal / 7 AS v FROM supplier")
def _(s, d):
    own, path = table(s, d, "supplier").select("s_suppkey", "s_name", (F.col("s_acctbal") / 7).alias("v")), _place(s)
    tables.write_csv(own, path, own.schema)
    return tables.read_csv(s, path, own.schema)


@query("sc05_checked_sink", "SELECT n_nationkey, n_name FROM nation")
def _(s, d):
    own, path = table(s, d, "nation").select("n_name", "n_nationkey"), _place(s)
    tables.write_parquet(own, path, StructType([own.schema["n_nationkey"], own.schema["n_name"]]))
    return s.read.parquet(path)


@query("sc07_load", "SELECT r_regionkey, r_name FROM region")
def _(s, d):
    return tables.load(s, f"{d}/region.parquet").select("r_regionkey", "r_name")


@query("ln01_schema_problems", "SELECT 'extra column n_regionkey' AS problem UNION ALL SELECT 'missing column verdict' UNION ALL SELECT 'column n_name is string, not bigint'")
def _(s, d):
    want = StructType.fromDDL("n_nationkey int, n_name bigint, verdict string")
    return s.createDataFrame([(x,) for x in tables.schema_problems(table(s, d, "nation"), want)], "problem string")


@query("ln03_provenance", "SELECT 'ok' AS status, true AS found")
def _(s, d):
    path = _place(s)
    table(s, d, "region").coalesce(1).write.parquet(path)
    told = tables.manifest(s, path)
    return tables.verify(told, tables.manifest(s, path)).groupBy("status").agg((F.count("*") > 0).alias("found"))


@query("ln10_refit_gap", E + " SELECT count(*) AS n_common, CAST(0 AS BIGINT) AS n_only_one, round(max(abs(p - p2)), 9) AS gap FROM e")
def _(s, d):
    e = evaluated(s, d)
    return rounded(tables.max_gap(e.select("parcel_id", "p"), e.select("parcel_id", F.col("p2").alias("p")), ["parcel_id"], "p"))


def _scored(s, d):
    return evaluated(s, d).select("parcel_id", "fold", "y", "p")


for _name in sorted(calibration.METHODS):
    plain(f"ca_{_name}")(lambda s, d, m=_name: calibration.fit(_scored(s, d), m)(_scored(s, d)).select("parcel_id", "calibrated"))


@plain("ca08_compared")
def _(s, d):
    return calibration.compared(_scored(s, d), ["platt", "beta"], 5, F.col("parcel_id"))


@plain("ac02_variogram_fits")
def _(s, d):
    lags = points.variogram(placed(s, d), "v", 8, 40.0).select((F.col("lag") * 5.0 - 2.5).alias("h"), "gamma")
    return points.fitted_variogram(lags, 40.0)


@plain("ac06_permuted_moran")
def _(s, d):
    return points.permuted_moran(placed(s, d), "v", 12.0, 99)


@plain("sp17_spatial_partition")
def _(s, d):
    return partition.assigned(placed(s, d).withColumn("mass", F.abs("v") + 1), [(3, 2), (2, 3)], 12)


def _pixels(s, d):
    own = table(s, d, "lineitem").select(F.col("l_partkey").alias("parcel_id"), F.expr("l_partkey % 6 + 1").alias("fold"), F.expr("cast(l_partkey % 3 = 0 AS int)").alias("y"), "l_quantity", "l_discount", F.expr("l_extendedprice * (1 + l_partkey % 3)").alias("b"), "l_linenumber", "l_orderkey")
    return own


FEATURES = ["l_quantity", "l_discount", "b"]


@plain("ml05_fixed_refit")
def _(s, d):
    train, test = models.fold_frames(_pixels(s, d), 2, 20, F.col("l_orderkey"), F.col("l_linenumber"), F.col("b"))
    return models.parcel_scores(models.Trees(train, FEATURES, 1, maxIter=3, maxDepth=3).scored(test))


@plain("ml07_importance")
def _(s, d):
    train, _ = models.fold_frames(_pixels(s, d), 1, 20, F.col("l_orderkey"), F.col("l_linenumber"), F.col("b"))
    return s.createDataFrame(models.Trees(train, FEATURES, 1, maxIter=3, maxDepth=3).importance(), "feature string, importance double")
