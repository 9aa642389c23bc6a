"""Classification metrics over (keys, y, p). Scores are summed per distinct value first, so ties count once and windows stay small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where den is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def confusion(df: DataFrame, threshold: float | Column, keys: list[str] = ()) -> DataFrame:
    """tp, fp, fn, tn per keys; a null score is negative."""
    hit = F.coalesce(F.col("p") >= threshold, F.lit(False))
    count = lambda c: F.count(F.when(c, 1))
    yes = F.col("y") == 1
    return df.groupBy(*keys).agg(count(hit & yes).alias("tp"), count(hit & ~yes).alias("fp"), count(~hit & yes).alias("fn"), count(~hit & ~yes).alias("tn"))


def rates(counts: DataFrame) -> DataFrame:
    """f1, precision, recall, fpr, accuracy, tss and mcc (0 where undefined) beside the counts."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    mcc = ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return counts.select("*", ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(fp, fp + tn).alias("fpr"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), (ratio(tp, tp + fn) - ratio(fp, fp + tn)).alias("tss"), mcc.alias("mcc"))


def curve(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Per keys and distinct score: positives and rows of that score, and of all scores at least as high; totals."""
    by = df.where("p IS NOT NULL").groupBy(*keys, "p").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    down = Window.partitionBy(*keys).orderBy(F.desc("p"))
    whole = Window.partitionBy(*keys)
    return by.select("*", F.sum("pos").over(down).alias("tp"), F.sum("n").over(down).alias("hits"), F.sum("pos").over(whole).alias("all_pos"), F.sum("n").over(whole).alias("all_n"))


def ranking(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Average precision, ROC-AUC with mid-ranks for ties, and the lowest score with the best F1, per keys."""
    c = curve(df, keys).withColumn("f", 2 * F.col("tp") / (F.col("hits") + F.col("all_pos")))
    neg, all_neg = F.col("n") - F.col("pos"), F.col("all_n") - F.col("all_pos")
    below = all_neg - (F.col("hits") - F.col("tp"))
    return c.groupBy(*keys).agg(
        F.max("all_n").alias("n"),
        F.max("all_pos").alias("positives"),
        F.sum(F.col("pos") / F.col("all_pos") * F.col("tp") / F.col("hits")).alias("pr_auc"),
        F.sum(F.col("pos") * (below + neg / 2) / (F.col("all_pos") * all_neg)).alias("roc_auc"),
        F.max_by("p", F.struct("f", -F.col("p"))).alias("threshold"),
        F.max("f").alias("f1"),
    )


def long(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One row per keys and metric."""
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])).alias("x")).select(*keys, "x.*")


def weighted_ranking(df: DataFrame, weight: str, keys: list[str] = ()) -> DataFrame:
    """Average precision and ROC-AUC per keys, each row counted `weight` times; null where a class is missing."""
    by = df.where("p IS NOT NULL").groupBy(*keys, "p").agg(F.sum(F.col("y") * F.col(weight)).alias("pos"), F.sum(weight).alias("n"))
    down, whole = Window.partitionBy(*keys).orderBy(F.desc("p")), Window.partitionBy(*keys)
    c = by.select("*", F.sum("pos").over(down).alias("tp"), F.sum("n").over(down).alias("hits"), F.sum("pos").over(whole).alias("_pos"), F.sum("n").over(whole).alias("_all"))
    neg, all_neg = F.col("n") - F.col("pos"), F.col("_all") - F.col("_pos")
    return c.groupBy(*keys).agg(F.sum(F.col("pos") / F.nullif(F.col("_pos"), F.lit(0)) * F.col("tp") / F.col("hits")).alias("pr_auc"), F.sum(F.col("pos") * (all_neg - (F.col("hits") - F.col("tp")) + neg / 2) / F.nullif(F.col("_pos") * all_neg, F.lit(0))).alias("roc_auc"))
