"""Fits and partitions against brute force and known answers."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvaframe.operators import calibration, featurespace, models, partition, points


def test_cuts_against_all_cuts():
    rnd = np.random.default_rng(4)
    for _ in range(60):
        n, k = int(rnd.integers(3, 9)), int(rnd.integers(1, 4))
        mass = rnd.integers(1, 20, n).astype(float)
        cost = lambda ends: sum((mass[a:b].sum() - mass.sum() / k) ** 2 for a, b in zip([0, *ends[:-1]], ends))  # noqa: B023, E731
        best = min(cost([*c, n]) for c in itertools.combinations(range(1, n), k - 1))
        ends = partition.cuts(mass, k)
        assert len(ends) == k and ends[-1] == n and cost(ends) == pytest.approx(best)
    with pytest.raises(ValueError):
        partition.cuts(np.ones(2), 3)


def test_partition_of_a_regular_grid_is_even(spark):
    rows = [(i, float(i % 6), float(i // 6), 1.0) for i in range(36)]
    got = partition.assigned(spark.createDataFrame(rows, "id long, x double, y double, mass double"), [(3, 2)], 4).collect()
    assert {r.unit for r in got} == set(range(1, 7)) and got[0].deviation == pytest.approx(0)


def test_variogram_fit_finds_the_model_it_was_made_from(spark):
    h = [float(i) for i in range(1, 21)]
    rows = [(x, 2.0 + 5.0 * (1.5 * x / 12 - 0.5 * (x / 12) ** 3 if x < 12 else 1.0)) for x in h]
    got = {r.model: r for r in points.fitted_variogram(spark.createDataFrame(rows, "h double, gamma double"), 20.0, 100).collect()}
    best = min(got.values(), key=lambda r: r.rmse)
    assert best.model == "spherical" and best.reach == pytest.approx(12) and best.nugget == pytest.approx(2) and best.sill == pytest.approx(5)


def test_permuted_moran_of_a_trend(spark):
    rows = [(i, float(i % 8), float(i // 8), float(i // 8)) for i in range(64)]
    df = spark.createDataFrame(rows, "id long, x double, y double, v double")
    got = points.permuted_moran(df, "v", 1.0, 39).first()
    assert got.moran_i == pytest.approx(points.moran(df, "v", 1.0).first().moran_i) and got.p == pytest.approx(1 / 40) and got.z > 3


def test_calibrators_and_trees(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(0.02, 0.98, 600)
    y = (rng.uniform(size=600) < p**2).astype(int)
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "id int, y int, p double")
    raw = calibration.errors(df).first().brier
    told = {r.method: r.brier for r in calibration.compared(df, ["platt", "beta"], 3, F.col("id")).collect()}
    assert told["beta"] < raw and told["platt"] < raw
    with pytest.raises(ValueError):
        calibration.fit(df, "none")
    pixels = spark.createDataFrame([(i % 60, i % 3, int(i % 60 > 30), float(i % 60), float(i % 7)) for i in range(600)], "parcel_id int, fold int, y int, a double, b double")
    train, test = models.fold_frames(pixels, 1, 4, F.col("b"))
    assert train.groupBy("parcel_id").count().agg(F.max("count")).first()[0] == 4 and train.where("fold = 1").count() == 0
    tree = models.Trees(train, ["a", "b"], 1, maxIter=2, maxDepth=2, maxBins=64)
    assert tree.importance()[0][0] == "a"
    assert all((r.p > 0.5) == (r.y == 1) for r in models.parcel_scores(tree.scored(test)).collect() if abs(r.parcel_id - 30.5) > 1)
    settings, cut = models.search(pixels, ["a", "b"], 0, [0, 1, 2], [{"maxIter": 1, "maxDepth": 1}], 4, F.col("b"))
    assert settings["maxIter"] == 1 and 0 < cut < 1


@pytest.mark.parametrize("block,groups", [(1 << 14, 3), (40, 3), (40, None), (7, 2)])
def test_nearest_over_cells_against_brute_force(spark, monkeypatch, block, groups):
    monkeypatch.setattr(featurespace, "BLOCK", block)
    monkeypatch.setattr(featurespace, "LEAF", 5)
    rnd = np.random.default_rng(block)
    x = np.round(rnd.normal(size=(300, 2)) * [24, 8]) / 8
    x[:60] = [0.5, 0.5]  # more than a cell's of one place
    group = (x[:, 0] > 1).astype(int) if groups == 2 else rnd.integers(0, 3, 300)  # groups that lie apart: cells without others
    rows = [(i, int(group[i]), x[i].tolist()) for i in range(300)] + [(300, 1, [None, 1.0])]
    got = {r.id: (r.nearest, r.distance) for r in featurespace.nearest(*[spark.createDataFrame(rows, "id long, g long, x array<double>")] * 2, "g" if groups else None).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    d[np.eye(300, dtype=bool) | ((group[:, None] == group[None]) & bool(groups))] = np.inf
    assert got.pop(300) == (None, None) and set(got) == set(range(300))
    for i, (near, distance) in got.items():
        assert near == d[i].argmin() and distance == pytest.approx(d[i].min(), abs=1e-12)


def test_permuted_moran_writes_no_pairs(spark, monkeypatch):
    """Many points in reach of one another, in several chunks, against the sums over all pairs; what is written grows with the points only."""
    monkeypatch.setattr(points, "BLOCK", 50, raising=False)
    rnd = np.random.default_rng(2)
    x, y, v = rnd.integers(0, 12, 300).astype(float), rnd.integers(0, 12, 300).astype(float), rnd.integers(0, 90, 300).astype(float)
    rows = [(i, *map(float, r)) for i, r in enumerate(zip(x, y, v, strict=True))] + [(300, 100.0, 100.0, 7.0)]
    df, written, shared = spark.createDataFrame(rows, "id long, x double, y double, v double"), [], points._shared
    monkeypatch.setattr(points, "_shared", lambda d: (written.append(out := shared(d)), out)[1])
    got = points.permuted_moran(df, "v", 5.0, 19).first()
    near = (np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2) <= 5) & ~np.eye(300, dtype=bool)
    z = v - np.append(v, 7.0).mean()
    want = (z * (near @ z) / near.sum(1)).sum() / (300 * np.append(v, 7.0).var())
    assert got.moran_i == pytest.approx(want) and 0 < got.p <= 1
    assert near.sum() > 20_000 and max(d.count() for d in written) <= 301


@pytest.mark.parametrize("sides,least", [(1, 30), (2, 40), (3, 9)])
def test_mean_distance_of_all_pairs(spark, monkeypatch, sides, least):
    """Cells apart, near and of one place, repeated ids and rows that lack something, against all pairs."""
    monkeypatch.setattr(featurespace, "LEAST", least)
    monkeypatch.setattr(featurespace, "BLOCK", 400)
    rng = np.random.default_rng(sides)
    x = np.concatenate((rng.normal(size=(900, sides)), 40 + 0.01 * rng.normal(size=(300, sides)), np.full((100, sides), 2.0)))
    ids = np.concatenate((np.arange(1295), [1, 2, 2, 3, 3]))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    other = ids[:, None] != ids[None]
    rows = [(int(i), v) for i, v in zip(ids, x.tolist(), strict=True)]
    lacking = [(None, [0.0] * sides), (7, [None] * sides), (8, None)]
    got = featurespace.mean_distance(spark.createDataFrame(rows + lacking, "id long, x array<double>")).first().mean
    assert got == pytest.approx(d[other].mean(), rel=1e-9)
    for some, expected in ((rows[:1], None), (rows[:2], d[0, 1]), ([(1, [0.0]), (2, [math.inf])], math.inf)):
        assert featurespace.mean_distance(spark.createDataFrame(some, "id long, x array<double>")).first().mean == (expected if expected is None else pytest.approx(expected))


def test_applicability_of_all_rows(spark, tmp_path):
    """Rows beyond the first 300 count in the mean distance."""
    from sylvaframe.plans.catalog import QUERIES

    rows = [(i, float(i * 7919 % 1000) if i <= 300 else float(i * 7919 % 100_000)) for i in range(1, 601)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    x = np.array([(b / 1000, i * 37 % 101) for i, b in rows])
    x = (x - x.mean(0)) / x.std(0) * [0.7, 0.3]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    fold = np.arange(1, 601) % 6
    di = np.where(fold[:, None] != fold[None], d, np.inf).min(1) / (d.sum() / (600 * 599))
    got = {r.id: r.di for r in QUERIES["ao06_applicability"](spark, str(tmp_path)).collect()}
    assert [got[i] for i, _ in rows] == pytest.approx(di.tolist(), abs=1.1e-5)
