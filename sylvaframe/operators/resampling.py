"""Block bootstrap, p-values and step-down correction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_bootstrap(counts: DataFrame, draws: DataFrame, measures: list[str]) -> DataFrame:
    """Sums of the measures per replicate: counts (block, measures) joined with draws (replicate, block, times). Rows never leave their block's sum."""
    return counts.join(draws, "block").groupBy("replicate").agg(*[F.sum(F.col(m) * F.col("times")).alias(m) for m in measures])


def two_sided_p(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """min(1, 2 min of the smoothed tail shares) of the values on either side of 0."""
    n = F.count(value)
    low, high = F.count(F.when(F.col(value) <= 0, 1)), F.count(F.when(F.col(value) >= 0, 1))
    return df.groupBy(*keys).agg(F.least(F.lit(1.0), 2 * F.least((low + 1) / (n + 1), (high + 1) / (n + 1))).alias("p"))


def holm(df: DataFrame, p: str, keys: list[str], tie: str) -> DataFrame:
    """df with p_holm: step-down adjusted p-values within keys; null p stays null."""
    known = F.col(p).isNotNull()
    order = Window.partitionBy(*keys, known).orderBy(F.col(p), F.col(tie))
    step = (F.count(p).over(Window.partitionBy(*keys)) - F.row_number().over(order) + 1) * F.col(p)
    return df.withColumn("_s", step).withColumn("p_holm", F.when(known, F.least(F.lit(1.0), F.max("_s").over(order)))).drop("_s")


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Ends of the Wilson interval of a frequency."""
    f = hits / n
    mid = (f + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(f * (1 - f) / n + z * z / (4 * n * n))
    return mid - half, mid + half


def interval(df: DataFrame, value: str, keys: list[str] = (), level: float = 0.95) -> DataFrame:
    """low, high: the exact percentile interval of the values, without nulls."""
    tail = (1 - level) / 2
    return df.groupBy(*keys).agg(F.percentile(value, tail).alias("low"), F.percentile(value, 1 - tail).alias("high"))


def draws(spark, replicates: int, blocks: int, seed: int = 0) -> DataFrame:
    """(replicate, block, times): per replicate as many of the blocks 1.. as there are, drawn with replacement; blocks drawn at least once."""
    picks = spark.range(replicates).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(1), F.lit(blocks))).alias("i"))
    picked = picks.select("replicate", (F.pmod(F.xxhash64("replicate", "i", F.lit(seed)), F.lit(blocks)) + 1).alias("block"))
    return picked.groupBy("replicate", "block").agg(F.count("*").alias("times"))


def interval_levels(df: DataFrame, value: str, levels: list[float], keys: list[str] = ()) -> DataFrame:
    """(keys, level, low, high) for several levels, in one pass."""
    probs = [p for level in levels for p in ((1 - level) / 2, 1 - (1 - level) / 2)]
    q = df.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(p) for p in probs])).alias("q"))
    rows = F.array(*[F.struct(F.lit(level).alias("level"), F.get("q", F.lit(2 * i)).alias("low"), F.get("q", F.lit(2 * i + 1)).alias("high")) for i, level in enumerate(levels)])
    return q.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*")


def relative_difference(df: DataFrame, a: str, b: str, keys: list[str] = ()) -> DataFrame:
    """low, high and excludes_zero of (a / b - 1) * 100 over replicates."""
    own = df.withColumn("_d", (F.col(a) / F.nullif(F.col(b), F.lit(0)) - 1) * 100)
    return interval(own, "_d", list(keys)).withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))


def matched_arm(df: DataFrame, distance: str, gap: float, *order: Column) -> DataFrame:
    """df with `buffered` (at least gap away) and `control`: as many rows, the first in order (a seeded key). Counts and ranks, no second pass over pairs."""
    n = F.count(F.when(F.col(distance) >= gap, 1))
    kept = df.crossJoin(F.broadcast(df.agg(n.alias("_n"))))
    return kept.withColumn("_r", F.row_number().over(Window.orderBy(*order))).select(*df.columns, (F.col(distance) >= gap).alias("buffered"), (F.col("_r") <= F.col("_n")).alias("control"))
