"""Calibration figures over (y, p)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaframe.operators.relational import fixed_bins


def reliability(df: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean_p and freq of equal-width left-closed bins; 1 falls in the last."""
    return df.withColumn("bin", fixed_bins(F.col("p"), [i / bins for i in range(bins)])).groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("freq"))


def errors(df: DataFrame, bins: int = 10) -> DataFrame:
    """ece, mce, brier and log_loss in one row."""
    gap = F.abs(F.col("mean_p") - F.col("freq"))
    curve = reliability(df, bins).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))
    q = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    rest = df.agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"), F.avg(-(F.col("y") * F.log(q) + (1 - F.col("y")) * F.log(1 - q))).alias("log_loss"))
    return curve.crossJoin(rest)


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def tempered(p: Column, temperature: Column) -> Column:
    """The logistic of the logit over a temperature."""
    return 1 / (1 + F.exp(-logit(p) / temperature))


def isotonic(df: DataFrame):
    """A function of a frame with p that adds `calibrated`: a monotone step curve fitted to (y, p)."""
    from pyspark.ml.regression import IsotonicRegression

    model = IsotonicRegression(featuresCol="p", labelCol="y", predictionCol="calibrated").fit(df.select(F.col("p").cast("double").alias("p"), F.col("y").cast("double").alias("y")))
    return model.transform


def logistic(df: DataFrame, beta: bool = False):
    """A function of a frame with p that adds `calibrated`: logistic regression on the logit, or (beta) on ln p and -ln(1 - p)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    def features(frame: DataFrame) -> DataFrame:
        q = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
        frame = frame.withColumns({"_a": F.log(q) if beta else logit(F.col("p")), "_b": -F.log(1 - q)})
        return VectorAssembler(inputCols=["_a", "_b"] if beta else ["_a"], outputCol="_x").transform(frame).drop("_a", "_b")

    model = LogisticRegression(featuresCol="_x", labelCol="y", regParam=0.0, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_l").fit(features(df.withColumn("y", F.col("y").cast("double"))))
    return lambda frame: model.transform(features(frame)).withColumn("calibrated", vector_to_array("_p")[1]).drop("_x", "_p", "_r", "_l")


def best_temperature(df: DataFrame, low: float = 0.05, high: float = 20.0, rounds: int = 3, width: int = 40) -> float:
    """The temperature with the least log loss, by grids that close in; each grid is one pass."""
    import math

    for _ in range(rounds):
        grid = [low * (high / low) ** (i / width) for i in range(width + 1)]
        losses = []
        for t in grid:
            q = tempered(F.col("p"), F.lit(t))
            losses.append(F.avg(-F.log(F.greatest(F.when(F.col("y") == 1, q).otherwise(1 - q), F.lit(1e-12)))))
        row = df.agg(*losses).first()
        at = min(range(len(grid)), key=lambda i: (math.inf if row[i] is None else row[i], i))
        low, high = grid[max(0, at - 1)], grid[min(width, at + 1)]
    return math.sqrt(low * high)


def best_method(scores: DataFrame) -> DataFrame:
    """The row of `scores` (method, ece, brier) with the least ece, then brier, then name."""
    return scores.orderBy("ece", "brier", "method").limit(1)


#: Fitters by name: each takes a frame (y, p) and returns a function that adds `calibrated`.
METHODS = {"isotonic": isotonic, "platt": logistic, "beta": lambda df: logistic(df, True), "temperature": lambda df: (lambda t: lambda frame: frame.withColumn("calibrated", tempered(F.col("p"), F.lit(t))))(best_temperature(df))}


def fit(df: DataFrame, method: str):
    """The calibrator of that name, fitted to (y, p)."""
    if method not in METHODS:
        raise ValueError(f"no method {method}; there are {', '.join(sorted(METHODS))}")
    return METHODS[method](df)


def compared(df: DataFrame, methods: list[str], folds: int, *order: Column) -> DataFrame:
    """(method, ece, mce, brier, log_loss) on held-out parts, stratified by y: rows are dealt to the parts in order within each class."""
    from functools import reduce

    from pyspark.sql import Window

    dealt = df.withColumn("_k", F.row_number().over(Window.partitionBy("y").orderBy(*order)) % folds)
    rows = []
    for method in methods:
        parts = [fit(dealt.where(F.col("_k") != k), method)(dealt.where(F.col("_k") == k)).select("y", F.col("calibrated").alias("p")) for k in range(folds)]
        rows.append(errors(reduce(DataFrame.union, parts)).withColumn("method", F.lit(method)))
    return reduce(DataFrame.unionByName, rows)
