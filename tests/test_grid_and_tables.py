"""Terrain, points, tables and calibrator fits against answers worked out by hand or by plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sylvaframe.operators import calibration, points, relational, resampling, terrain
from sylvaframe.sources import tables


def test_plane_has_its_slope_and_edges_have_none(spark):
    cells = spark.createDataFrame([(r, c, 3.0 * c) for r in range(4) for c in range(4)], "row long, col long, z double")
    got = terrain.gradients(cells, 10.0, 10.0).withColumn("slope", terrain.slope(F.col("dzdx"), F.col("dzdy"))).withColumn("aspect", terrain.aspect(F.col("dzdx"), F.col("dzdy"))).collect()
    assert len(got) == 16
    for r in got:
        if r.row in (1, 2) and r.col in (1, 2):
            assert r.slope == pytest.approx(math.degrees(math.atan(0.3))) and r.aspect == pytest.approx(270)
        else:
            assert r.dzdx is None and r.slope is None


def test_missing_elevation_spreads_to_neighbours_only(spark):
    cells = spark.createDataFrame([(r, c, None if (r, c) == (2, 2) else 1.0) for r in range(7) for c in range(7)], "row long, col long, z double")
    got = {(r.row, r.col): r.dzdx for r in terrain.gradients(cells, 1.0, 1.0).collect()}
    assert got[2, 2] is None and got[3, 3] is None and got[4, 4] == 0.0


def test_nearest_is_brute_force_at_any_spacing(spark):
    rng = random.Random(3)
    near = [(i, rng.uniform(0, 50), rng.uniform(0, 50)) for i in range(40)]
    far = [(i, rng.uniform(200, 900), rng.uniform(0, 50)) for i in range(100, 130)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, x double, y double")
    got = {r.id: (r.other, r.dist) for r in points.nearest(frame(near), frame(far), 10.0).collect()}
    for i, x, y in near:
        dist, other = min((math.hypot(x - a, y - b), k) for k, a, b in far)
        assert got[i][0] == other and got[i][1] == pytest.approx(dist)
    assert points.nearest(frame(near), frame([]), 10.0).count() == 0


def test_groups_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 30)] + [(50, 51), (52, 51)], "a long, b long")
    got = {r.id: r.component for r in points.groups(edges).collect()}
    assert all(got[i] == 10 for i in range(10, 31)) and got[52] == 50


def test_moran_of_a_checkerboard_is_minus_one(spark):
    cells = spark.createDataFrame([(r * 4 + c, float(r), float(c), float((r + c) % 2)) for r in range(4) for c in range(4)], "id long, x double, y double, v double")
    row = points.moran(cells, "v", 1.0).first()
    assert row.moran_i == pytest.approx(-1) and row.expected_i == pytest.approx(-1 / 15) and row.mean_neighbours == 3.0


def test_schema_problems_come_all_at_once(spark, tmp_path):
    schema = spark.createDataFrame([], "parcel_id long, p double").schema
    df = spark.createDataFrame([(1, "a", 2)], "parcel_id int, p string, extra int")
    assert len(tables.schema_problems(df, schema)) == 3
    with pytest.raises(ValueError, match="extra column"):
        tables.check_schema(df, schema)
    good = spark.createDataFrame([(1, 0.1), (2, 1 / 3)], schema)
    for write, suffix in ((tables.write_parquet, "parquet"), (tables.write_csv, "csv")):
        path = str(tmp_path / f"t.{suffix}")
        write(good, path, schema)
        assert sorted(tables.load(spark, path, schema).collect()) == sorted(good.collect())


def test_append_twice_changes_nothing(spark, tmp_path):
    path, rows = str(tmp_path / "r"), spark.createDataFrame([(1, 0.5), (2, 0.7)], "rep int, v double")
    tables.append_pending(spark, rows.where("rep = 1"), path, ["rep"])
    for _ in range(2):
        tables.append_pending(spark, rows, path, ["rep"])
        assert sorted(r.rep for r in spark.read.parquet(path).collect()) == [1, 2]


def test_unknown_folds_are_an_error(spark, tmp_path):
    path = str(tmp_path / "folds")
    spark.createDataFrame([("a", 1), ("b", 7)], "parcel_id string, fold_id int").write.parquet(path)
    with pytest.raises(ValueError, match="7"):
        tables.fold_assignment(spark, path, 6)


def test_verify_statuses(spark):
    told = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("d", 1, "x")], "path string, n_bytes long, sha256 string")
    now = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 1, "y"), ("e", 1, "x")], "path string, n_bytes long, sha256 string")
    assert {r.path: r.status for r in tables.verify(told, now).collect()} == {"a": "ok", "b": "size", "c": "digest", "d": "missing", "e": "unrecorded"}


def test_weights_have_mean_one_and_equal_totals(spark):
    df = spark.createDataFrame([("a",)] * 3 + [(None,)], "k string")
    got = relational.sample_weights(df, ["k"]).collect()
    assert sum(r.weight for r in got) == pytest.approx(4) and {r.k: round(r.weight, 6) for r in got} == {"a": round(2 / 3, 6), None: 2.0}


def test_interval_leaves_nulls_out(spark):
    row = resampling.interval(spark.createDataFrame([(float(i),) for i in range(101)] + [(None,)], "v double"), "v").first()
    assert (row.low, row.high) == (pytest.approx(2.5), pytest.approx(97.5))


def test_calibrators_help_overconfident_scores(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(3000):
        p = rng.uniform(0.05, 0.95)
        z = 2 * math.log(p / (1 - p))
        rows.append((int(rng.random() < p), 1 / (1 + math.exp(-z))))
    df = spark.createDataFrame(rows, "y int, p double").cache()
    before = calibration.errors(df).first().ece
    for fit in (calibration.isotonic, calibration.logistic, lambda d: calibration.logistic(d, beta=True)):
        after = fit(df)(df).select("y", F.col("calibrated").alias("p"))
        assert calibration.errors(after).first().ece < before / 2
    assert calibration.best_temperature(df) == pytest.approx(2, abs=0.25)
