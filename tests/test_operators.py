"""Operators against answers worked out by hand, and every oracle against DuckDB."""

import decimal
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from sylvaframe.functions import strings
from sylvaframe.operators import agreement, metrics, relational, resampling, spatial
from sylvaframe.plans.catalog import ORACLES, QUERIES

SF = os.environ.get("SYLVAFRAME_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


def frame(spark, y, p):
    return spark.createDataFrame(list(zip(y, p, strict=True)), "y int, p double")


def test_ranking_with_known_answers(spark):
    # Hits in order of score: yes, no, yes, no, yes. AP = (1 + 2/3 + 3/5) / 3; of 6 pairs, 4 are in order.
    got = metrics.ranking(frame(spark, [1, 0, 1, 0, 1], [0.95, 0.7, 0.65, 0.2, 0.1])).first()
    assert got.pr_auc == pytest.approx((1 + 2 / 3 + 3 / 5) / 3) and got.roc_auc == pytest.approx(0.5)
    assert got.threshold == 0.1 and got.f1 == pytest.approx(0.75)


def test_holm(spark):
    for given, expected in (((0.2, 0.001, 0.012, 0.013, 0.5), (0.4, 0.005, 0.048, 0.048, 0.5)), ((None, 0.3), (None, 0.3))):
        df = spark.createDataFrame([(7, i, p) for i, p in enumerate(given)], "k int, i int, p double")
        assert [r.p_holm for r in resampling.holm(df, "p", ["k"], "i").orderBy("i").collect()] == [None if x is None else pytest.approx(x) for x in expected]


def test_agreement(spark):
    df = spark.createDataFrame([(1, 1, 0), (0, 0, 0), (0, 1, 1), (1, 1, 1), (0, 0, 0)], "a int, b int, c int")
    assert {r.consensus: r.n for r in agreement.consensus(df, ["a", "b", "c"]).collect()} == {"all": 1, "none": 2, "mixed": 2}
    pair = {(r.rater_a, r.rater_b): r for r in agreement.pairwise(df, ["a", "b"]).collect()}["a", "b"]
    # 4 of 5 agree; by chance 2/5 * 3/5 + 3/5 * 2/5 = 0.48.
    assert pair.agreement == pytest.approx(0.8) and pair.kappa == pytest.approx((0.8 - 0.48) / 0.52)
    # Rows agree by 1/3, 1, 1/3, 1, 1; 7 of 15 votes are yes.
    by_chance = (7 / 15) ** 2 + (8 / 15) ** 2
    assert agreement.fleiss(df, ["a", "b", "c"]).first().kappa == pytest.approx((11 / 15 - by_chance) / (1 - by_chance))


def test_overlaps(spark):
    box = "xmin double, ymin double, xmax double, ymax double"
    t = spark.createDataFrame([("t", -3.0, 2.0, 5.0, 6.0), ("far", 90.0, 90.0, 95.0, 95.0)], f"target string, {box}")
    s = spark.createDataFrame([("s", 3.0, -4.0, 7.0, 4.0), ("edge", 5.0, 2.0, 9.0, 6.0)], f"source string, {box}")
    assert [tuple(r) for r in spatial.overlaps(t, s, 2.5).collect()] == [("t", "s", 4.0, 0.125, 0.125)]


def test_composition_and_age(spark):
    rows = [("3ca 5fa\t2mo", "12.5", "5FA 3CA 2MO"), ("4ULC4DR2PAM", "0", "4DR 4ULC 2PAM"), (None, "x", None)]
    df = spark.createDataFrame([(v, age) for v, age, _ in rows], "v string, age string")
    got = df.select(F.array_join(F.transform(strings.pairs(strings.clean(F.col("v"))), lambda x: F.concat(x["share"].cast("string"), x["code"])), " ").alias("c"), strings.positive(F.col("age")).alias("a")).collect()
    assert [r.c for r in got] == [c for *_, c in rows] and [r.a for r in got] == [12.5, None, None]


def test_closest_prefers_not_after(spark):
    df = spark.createDataFrame([(1, 1987), (1, 2013), (2, 2031), (2, None), (3, 2001), (3, 1998)], "k int, y int")
    assert {r.k: r.y for r in relational.closest(df, ["k"], "y", 2000).collect()} == {1: 1987, 2: 2031, 3: 2001}


def _same(a, b):
    a, b = (float(x) if isinstance(x, decimal.Decimal) else x for x in (a, b))
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-6, abs_tol=1.1e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    told = con.execute(ORACLES[name])
    names = [x[0] for x in told.description]
    expected = sorted((tuple(r[names.index(c)] for c in cols) for r in told.fetchall()), key=repr)
    assert sorted(names) == cols and len(got) == len(expected)
    assert all(_same(x, y) for a, b in zip(got, expected, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name,table,key,own", [("rs05_holm", "part", "p_partkey", "p_partkey"), ("jn01_inner_paired", "orders", "parcel_id", "o_orderkey")])
def test_whole_tables(spark, name, table, key, own):
    sf = "/root/testdata/sf0.01"
    got = sorted(r[key] for r in QUERIES[name](spark, sf).collect())
    assert got == [x[0] for x in duckdb.sql(f"SELECT {own} FROM '{sf}/{table}.parquet' ORDER BY 1").fetchall()]
