"""Putting tables together: schemas, lookups, checked joins, tagged unions, fixed crosstabs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reindexed(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in this order; those that df lacks are null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def members(df: DataFrame, keys: DataFrame, on: list[str], keep: bool = True) -> DataFrame:
    """Rows whose keys the other table has; without keep, those whose keys it lacks (null keys among them)."""
    return df.join(keys.select(*on).distinct(), on, "left_semi" if keep else "left_anti")


def looked_up(df: DataFrame, table: DataFrame, on: list[str], fill: dict | None = None) -> DataFrame:
    """df with the table's columns, which must be unique by key; missing values filled."""
    out = df.join(table, on, "left")
    return out.fillna(fill) if fill else out


def assembled(template: DataFrame, products: dict[str, DataFrame], on: str, value: str, fill: float = 0.0) -> DataFrame:
    """The template with a column per product, by one pass over their union rather than a join each."""
    long = reduce(DataFrame.union, [p.select(on, F.lit(name).alias("_product"), F.col(value).alias("_value")) for name, p in products.items()])
    wide = long.groupBy(on).agg(*[F.max(F.when(F.col("_product") == n, F.col("_value"))).alias(n) for n in products])
    return template.join(wide, on, "left").fillna(fill, list(products))


def alignment(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """One row: rows of a and of b, keys that both have, keys that stand twice on a side. Aligned: the first three equal, none twice."""
    side = lambda d, i: d.groupBy(*on).agg(F.count("*").alias("_n")).select(*on, F.lit(i).alias("_s"), "_n")
    per = side(a, 1).union(side(b, 2)).groupBy(*on).agg(*[F.sum(F.when(F.col("_s") == i, F.col("_n")).otherwise(0)).alias(f"n{i}") for i in (1, 2)])
    count = lambda c: F.count(F.when(c, 1))
    return per.agg(F.coalesce(F.sum("n1"), F.lit(0)).alias("rows_a"), F.coalesce(F.sum("n2"), F.lit(0)).alias("rows_b"), count((F.col("n1") > 0) & (F.col("n2") > 0)).alias("both"), count((F.col("n1") > 1) | (F.col("n2") > 1)).alias("repeated"))


def agreeing(frames: dict[str, DataFrame], on: str, shared: list[str], own: str) -> DataFrame:
    """The frames joined by key, each with its column `own` under its name, and whether they agree on the shared columns.

    One aggregation over their union: keys that a frame lacks go; `agrees` is false where a shared column differs.
    """
    long = reduce(DataFrame.unionByName, [f.select(on, *shared, F.lit(n).alias("_f"), F.col(own).alias("_v")) for n, f in frames.items()])
    same = reduce(Column.__and__, [F.min(c).eqNullSafe(F.max(c)) for c in shared])
    out = long.groupBy(on).agg(*[F.min(c).alias(c) for c in shared], *[F.max(F.when(F.col("_f") == n, F.col("_v"))).alias(n) for n in frames], same.alias("agrees"), F.count_distinct("_f").alias("_k"))
    return out.where(F.col("_k") == len(frames)).drop("_k")


def tagged(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    """The frames one after the other, with their names in the column `tag`."""
    return reduce(DataFrame.unionByName, [f.withColumn(tag, F.lit(n)) for n, f in frames.items()])


def crosstab(df: DataFrame, row: str, column: str, rows: list, columns: list) -> DataFrame:
    """Counts by row and column, with all the given categories and no others."""
    counts = df.where(F.col(row).isin(rows)).groupBy(row).agg(*[F.count(F.when(F.col(column) == c, 1)).alias(str(c)) for c in columns])
    every = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(r) for r in rows])).alias(row))
    return every.join(counts, row, "left").fillna(0, [str(c) for c in columns])


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def last_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row in order per keys, by a partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    at = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("_r")).select(*keys, "_r.*")


def run_starts(df: DataFrame, keys: list[str], value: str, *order: Column) -> DataFrame:
    """df with `starts`: whether a row's value differs from that of the row before, within keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("starts", ~F.lag(value).over(w).eqNullSafe(F.col(value)) | (F.row_number().over(w) == 1))
