"""Agreement of raters given as 0/1 columns. Each operator is one aggregation over the rows."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def votes(raters: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(r) for r in raters])


def consensus(df: DataFrame, raters: list[str]) -> DataFrame:
    """Rows on which all raters, none, or some say yes."""
    v = votes(raters)
    kind = F.when(v == len(raters), "all").when(v == 0, "none").otherwise("mixed")
    return df.groupBy(kind.alias("consensus")).agg(F.count("*").alias("n"))


def pairwise(df: DataFrame, raters: list[str]) -> DataFrame:
    """Agreement and Cohen's kappa of each ordered pair; kappa of constant raters is 1 if they agree everywhere, else 0."""
    terms = [F.count("*").alias("n"), *[F.sum(r).alias(r) for r in raters], *[F.sum(F.when(F.col(a) == F.col(b), 1).otherwise(0)).alias(f"{a}|{b}") for a, b in product(raters, raters)]]
    one = df.agg(*terms)
    rows = F.array(*[F.struct(F.lit(a).alias("rater_a"), F.lit(b).alias("rater_b"), (F.col(f"{a}|{b}") / F.col("n")).alias("agreement"), (F.col(a) / F.col("n")).alias("pa"), (F.col(b) / F.col("n")).alias("pb")) for a, b in product(raters, raters)])
    x = one.select(F.explode(rows).alias("x")).select("x.*")
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    kappa = F.when(F.abs(1 - chance) < 1e-12, F.when(F.col("agreement") == 1, 1.0).otherwise(0.0)).otherwise((F.col("agreement") - chance) / (1 - chance))
    return x.select("rater_a", "rater_b", "agreement", kappa.alias("kappa"))


def fleiss(df: DataFrame, raters: list[str]) -> DataFrame:
    """Fleiss' kappa; 1 where chance agreement is 1."""
    k = len(raters)
    v = votes(raters).cast("double")
    own = (v * (v - 1) + (k - v) * (k - v - 1)) / (k * (k - 1))
    one = df.agg(F.avg(own).alias("po"), F.avg(v / k).alias("p"))
    pe = F.col("p") * F.col("p") + (1 - F.col("p")) * (1 - F.col("p"))
    return one.select(F.when(F.abs(1 - pe) < 1e-12, 1.0).otherwise((F.col("po") - pe) / (1 - pe)).alias("kappa"))
