"""Report tables over scored rows (fold, block, y, p): all keyed sums are taken in one pass, and reports are small tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvaframe.operators import metrics, resampling

#: The metrics of a report row.
METRICS = ["pr_auc", "roc_auc", "f1", "precision", "recall", "accuracy", "tss", "mcc"]


def metric_rows(df: DataFrame, keys: list[str], threshold: float | Column = 0.5) -> DataFrame:
    """All METRICS per keys, wide."""
    ranked = metrics.ranking(df, keys).select(*keys, "pr_auc", "roc_auc")
    return metrics.rates(metrics.confusion(df, threshold, keys)).select(*keys, *METRICS[2:]).join(ranked, keys).select(*keys, *METRICS)


def fold_tables(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(level, item, metric, value): metrics by fold, their mean, sd, min and max, and those of all rows pooled. One pass over df."""
    both = df.withColumn("g", F.explode(F.array(F.col("fold").cast("string"), F.lit("all"))))
    long = metrics.long(metric_rows(both, ["g"], threshold), ["g"], METRICS)
    own = long.where("g <> 'all'")
    stats = own.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))
    summary = stats.select(F.lit("summary").alias("level"), "metric", F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("value")) for c in ("mean", "sd", "min", "max")])).alias("x"))
    head = lambda d, level: d.select(F.lit(level).alias("level"), F.col("g").alias("item"), "metric", "value")
    return head(own, "fold").union(summary.select("level", "x.item", "metric", "x.value")).union(head(long.where("g = 'all'"), "pooled"))


def wide_row(tables: DataFrame, intervals: DataFrame, folds: list) -> DataFrame:
    """One row with metric_pooled, _low, _high, one column a fold, _mean and _sd of each metric. intervals: (metric, low, high)."""
    long = tables.where("item <> 'min' AND item <> 'max'").select("metric", F.when(F.col("level") == "pooled", "pooled").when(F.col("level") == "fold", F.concat(F.lit("fold"), "item")).otherwise(F.col("item")).alias("stat"), "value")
    ends = intervals.select("metric", F.explode(F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).alias("value")) for c in ("low", "high")])).alias("x")).select("metric", "x.*")
    stats = ["pooled", "low", "high", *[f"fold{f}" for f in folds], "mean", "sd"]
    return long.union(ends).agg(*[F.max(F.when((F.col("metric") == m) & (F.col("stat") == s), F.col("value"))).alias(f"{m}_{s}") for m in METRICS for s in stats])


def bootstrap_metrics(df: DataFrame, draws: DataFrame, scores: list[str], threshold: float = 0.5, min_classes: int = 2) -> DataFrame:
    """(replicate, score, METRICS): every score column over the same drawn blocks; null where fewer classes than min_classes are drawn.

    Rows are summed by block and distinct score before they meet the draws (replicate, block, times).
    """
    long = df.select("block", "y", F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).alias("p")) for s in scores])).alias("x")).select("block", "y", "x.*")
    sums = long.groupBy("block", "score", "p").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    drawn = sums.join(F.broadcast(draws), "block").groupBy("replicate", "score", "p").agg(F.sum(F.col("pos") * F.col("times")).alias("pos"), F.sum(F.col("n") * F.col("times")).alias("n"))
    down = Window.partitionBy("replicate", "score").orderBy(F.desc("p"))
    whole = Window.partitionBy("replicate", "score")
    c = drawn.select("*", F.sum("pos").over(down).alias("tp"), F.sum("n").over(down).alias("hits"), F.sum("pos").over(whole).alias("_pos"), F.sum("n").over(whole).alias("_all"))
    neg, all_neg = F.col("n") - F.col("pos"), F.col("_all") - F.col("_pos")
    hit = F.col("p") >= threshold
    out = c.groupBy("replicate", "score").agg(
        F.max("_pos").alias("_pos"), F.max("_all").alias("_all"),
        F.sum(F.col("pos") / F.nullif(F.col("_pos"), F.lit(0)) * F.col("tp") / F.col("hits")).alias("pr_auc"),
        F.sum(F.col("pos") * (all_neg - (F.col("hits") - F.col("tp")) + neg / 2) / F.nullif(F.col("_pos") * all_neg, F.lit(0))).alias("roc_auc"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, neg).otherwise(0)).alias("fp"), F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("fn"), F.sum(F.when(hit, 0).otherwise(neg)).alias("tn"))
    enough = ((F.col("_pos") > 0).cast("int") + (F.col("_pos") < F.col("_all")).cast("int")) >= min_classes
    return metrics.rates(out.withColumn("_e", enough)).select("replicate", "score", *[F.when(F.col("_e"), F.col(m)).alias(m) for m in METRICS])


def metric_intervals(replicates: DataFrame, keys: list[str] = (), level: float = 0.95) -> DataFrame:
    """(keys, metric, low, high) of wide replicates."""
    return resampling.interval(metrics.long(replicates, list(keys), METRICS), "value", [*keys, "metric"], level)


def contrasts(replicates: DataFrame, a: str, b: str) -> DataFrame:
    """(metric, low, high, p): the paired difference of two scores over replicates."""
    wide = metrics.long(replicates, ["replicate", "score"], METRICS).groupBy("replicate", "metric").agg(*[F.max(F.when(F.col("score") == s, F.col("value"))).alias(n) for n, s in (("a", a), ("b", b))])
    diff = wide.select("metric", (F.col("a") - F.col("b")).alias("d"))
    return resampling.interval(diff, "d", ["metric"]).join(resampling.two_sided_p(diff, "d", ["metric"]), "metric")


def holm_families(df: DataFrame, p: str, families: list[str], tie: str, alpha: float = 0.05) -> DataFrame:
    """df with p_holm within each family and whether it is under alpha (null where p is)."""
    return resampling.holm(df, p, families, tie).withColumn("reject", F.col("p_holm") < alpha)


def adjusted_series(df: DataFrame, gap: str, arm: str, value: str, buffered, control, furthest: float) -> DataFrame:
    """(gap, adjusted, change): buffered - control + the control at gap 0, and buffered - control, up to `furthest`."""
    per = df.where(F.col(gap) <= furthest).groupBy(gap).agg(*[F.max(F.when(F.col(arm) == a, F.col(value))).alias(n) for n, a in (("b", buffered), ("c", control))])
    base = per.where(F.col(gap) == 0).select(F.col("c").alias("c0"))
    return per.crossJoin(F.broadcast(base)).select(gap, (F.col("b") - F.col("c") + F.col("c0")).alias("adjusted"), (F.col("b") - F.col("c")).alias("change"))


def leave_one_out(df: DataFrame, group: str, measure) -> DataFrame:
    """measure(rows, keys) for each scenario `left_out`: all rows but one group's. Rows are dealt to the scenarios that hold them."""
    groups = df.groupBy(group).agg(F.count("*").alias("_n")).agg(F.collect_set(group).alias("_all"))
    dealt = df.crossJoin(F.broadcast(groups)).withColumn("left_out", F.explode(F.array_except("_all", F.array(group)))).drop("_all")
    return measure(dealt, ["left_out"])


def peer_agreement(df: DataFrame, raters: list[str]) -> DataFrame:
    """(rater, peers, n): how many rows have `peers` others agree with the rater, for each count from 0 to all others."""
    agree = lambda r: reduce(Column.__add__, [(F.col(r) == F.col(o)).cast("int") for o in raters if o != r])
    counts = df.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rater"), agree(r).alias("peers")) for r in raters])).alias("x")).groupBy("x.rater", "x.peers").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(len(raters)).select(F.col("id").cast("int").alias("peers"), F.explode(F.array(*[F.lit(r) for r in raters])).alias("rater"))
    return every.join(counts, ["rater", "peers"], "left").select("rater", "peers", F.coalesce("n", F.lit(0)).alias("n"))


def spread(df: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """best, range, best minus median, and range of the k best, per keys."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value))
    own = df.withColumn("_r", F.row_number().over(w))
    top = F.when(F.col("_r") <= k, F.col(value))
    return own.groupBy(*keys).agg(F.max(value).alias("best"), (F.max(value) - F.min(value)).alias("range"), (F.max(value) - F.percentile(value, 0.5)).alias("over_median"), (F.max(top) - F.min(top)).alias("top_range"))


def participation(df: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """1 / sum of squared shares of the weights, per keys."""
    return df.groupBy(*keys).agg((F.sum(weight) * F.sum(weight) / F.sum(F.col(weight) * F.col(weight))).alias("participation"))


def balance(df: DataFrame, unit: str, quantity: str, tolerance: float) -> DataFrame:
    """(unit, total, deviation, balanced, ratio): relative deviation from an equal share, whether it is allowed, largest over smallest."""
    per = df.groupBy(unit).agg(F.sum(quantity).alias("total"))
    whole = per.agg(F.avg("total").alias("_m"), (F.max("total") / F.min("total")).alias("ratio"))
    out = per.crossJoin(F.broadcast(whole)).withColumn("deviation", F.abs(F.col("total") / F.col("_m") - 1))
    return out.select(unit, "total", "deviation", (F.col("deviation") <= tolerance).alias("balanced"), "ratio")
