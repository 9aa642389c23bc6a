"""Relational preparation: picks, shares, bins and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_row(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per keys, the first in `order`, by a partial aggregation rather than a sort of each group."""
    rest = [c for c in df.columns if c not in keys]
    names = [f"o{i}" for i in range(len(order))]
    at = F.struct(*[o.alias(n) for o, n in zip(order, names, strict=True)])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), at).alias("row")).select(*keys, "row.*")


def closest(df: DataFrame, keys: list[str], at: str, target: float) -> DataFrame:
    """The record nearest to target per keys: least distance, then not after it, then the latest."""
    own = df.where(F.col(at).isNotNull())
    return best_row(own, keys, F.abs(F.col(at) - target), (F.col(at) > target).cast("int"), -F.col(at))


def dominant(df: DataFrame, keys: list[str], category: str, weight: str, least: float = 0.0) -> DataFrame:
    """The category with the largest share of the weight per keys, ties to the first by name, if its share is `least` or more."""
    per = df.groupBy(*keys, category).agg(F.sum(weight).alias("w"))
    top = per.groupBy(*keys).agg(F.min_by(category, F.struct(-F.col("w"), F.col(category))).alias(category), (F.max("w") / F.sum("w")).alias("share"))
    return top.where(F.col("share") >= least)


def capped(df: DataFrame, keys: list[str], cap: int, *order: Column) -> DataFrame:
    """At most cap rows per keys, the first in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")


def quantile_bins(df: DataFrame, column: str, probs: list[float], labels: list[str]) -> DataFrame:
    """df with `bin`: right-closed classes at exact quantiles, which are one small row."""
    q = df.agg(F.percentile(column, F.array(*[F.lit(p) for p in probs])).alias("q"))
    bin_ = F.lit(labels[-1])
    for i in reversed(range(len(probs))):
        bin_ = F.when(F.col(column) <= F.get("q", F.lit(i)), labels[i]).otherwise(bin_)
    return df.crossJoin(F.broadcast(q)).withColumn("bin", bin_).drop("q")


def fixed_bins(x: Column, edges: list[float]) -> Column:
    """Left-closed classes [edge, next), numbered from 0, the last open; null below the first edge."""
    out = F.when(x < edges[0], F.lit(None))
    for i, e in enumerate(edges[1:]):
        out = out.when(x < e, F.lit(i))
    return out.otherwise(F.lit(len(edges) - 1))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many distinct rows only one side has."""
    return a.distinct().withColumn("side", F.lit(1)).unionByName(b.distinct().withColumn("side", F.lit(2))).groupBy(*a.columns).agg(F.count("*").alias("n")).where("n = 1").agg(F.count("*").alias("n"))


def sample_weights(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with `weight`: one over the size of its group, scaled to a mean of 1, so that groups weigh the same.

    Sizes are counted with partial aggregation; the table of groups, not the rows, goes to the join.
    """
    per = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = per.agg((F.sum("_n") / F.count("*")).alias("_m"))
    per = per.crossJoin(F.broadcast(total)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col("_m") / F.col("_n")).alias("weight"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return df.join(per, on).drop(*[f"_k{i}" for i in range(len(keys))])


def count_windows(df: DataFrame, keys: list[str], width: int, *order: Column) -> DataFrame:
    """df's rows once for each whole window `win` of `width` rows in order, with a step of half the width, within keys."""
    step = width // 2
    w = Window.partitionBy(*keys)
    own = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_c", F.count("*").over(w))
    own = own.withColumn("win", F.explode(F.array(F.floor(F.col("_i") / step), F.floor(F.col("_i") / step) - 1)))
    return own.where((F.col("win") >= 0) & (F.col("win") * step + width <= F.col("_c"))).drop("_i", "_c")


def near_end(x: Column, low: float, high: float, part: float = 0.02) -> tuple[Column, Column]:
    """Whether x is within such a part of a range of its low and of its high end."""
    return x <= low + part * (high - low), x >= high - part * (high - low)


def probability_class(p: Column, n: int) -> Column:
    """The label of the equal-width class of p: `[a, b)`, the last `[a, b]`."""
    i = F.least(F.floor(p * n), F.lit(n - 1))
    return F.concat(F.format_string("[%.2f, %.2f", i / n, (i + 1) / n), F.when(i == n - 1, "]").otherwise(")"))


def with_specs(df: DataFrame, specs: dict[str, list]) -> DataFrame:
    """df's rows once for each combination of the given values, which come in as literals."""
    for name, values in specs.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def placed(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """df with `place` in order within keys, from 1."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def sampled(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The n rows with the least keys, a sample without replacement if these are random: each task keeps n rows at most."""
    return df.orderBy(*order).limit(n)


def newest_complete(runs: DataFrame, parts: DataFrame, needed: int) -> DataFrame:
    """The largest run with at least `needed` distinct parts."""
    done = parts.groupBy("run").agg(F.count_distinct("part").alias("n")).where(F.col("n") >= needed)
    return runs.join(done, "run", "left_semi").agg(F.max("run").alias("run"))


def with_group_total(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with `total`, the sum of its group: a partial aggregation and a join, so that a large group needs no single task."""
    return df.join(df.groupBy(*keys).agg(F.sum(value).alias("total")), keys)


def first_valid(frames: dict, keys: list[str], value: str) -> DataFrame:
    """Per keys the value of the first frame (by its number) that has one, in one aggregation."""
    from functools import reduce

    long = reduce(DataFrame.union, [f.select(*keys, F.lit(i).alias("_i"), value) for i, f in frames.items()])
    return long.groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col("_i"))).alias(value))
