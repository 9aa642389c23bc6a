"""Boosted trees over pixels with spatial folds: sampling caps, fits per held-out fold, inner search, importances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaframe.operators import metrics, relational


def fold_frames(df: DataFrame, held_out, cap: int, *order: Column) -> tuple[DataFrame, DataFrame]:
    """Training rows (other folds, at most cap per parcel, labelled) and the held-out fold's rows."""
    train = df.where((F.col("fold") != held_out) & F.col("y").isNotNull())
    return relational.capped(train, ["parcel_id"], cap, *order), df.where(F.col("fold") == held_out)


class Trees:
    """A fitted model: adds `p` to a frame."""

    def __init__(self, train: DataFrame, features: list[str], seed: int = 0, **settings):
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.feature import VectorAssembler

        self.features = features
        self.assembler = VectorAssembler(inputCols=features, outputCol="_x")
        own = self.assembler.transform(train.select(*features, F.col("y").cast("double").alias("y")))
        self.model = GBTClassifier(featuresCol="_x", labelCol="y", seed=seed, **settings).fit(own)

    def scored(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        out = self.model.transform(self.assembler.transform(df))
        return out.withColumn("p", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")

    def importance(self) -> list[tuple[str, float]]:
        return sorted(zip(self.features, self.model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def parcel_scores(scored: DataFrame) -> DataFrame:
    """(parcel_id, fold, y, p): the mean score and the label of each parcel."""
    return scored.groupBy("parcel_id", "fold").agg(F.max("y").alias("y"), F.avg("p").alias("p"))


def search(df: DataFrame, features: list[str], held_out, folds: list, grid: list[dict], cap: int, order: Column, seed: int = 0) -> tuple[dict, float]:
    """The settings with the best mean inner average precision over the other folds, and the mean inner F1 threshold (0.5 where undefined)."""
    best = (float("-inf"), grid[0], 0.5)
    for settings in grid:
        aps, cut = [], []
        for inner in (f for f in folds if f != held_out):
            train, test = fold_frames(df.where(F.col("fold") != held_out), inner, cap, order)
            row = metrics.ranking(parcel_scores(Trees(train, features, seed, **settings).scored(test))).first()
            if row and row["pr_auc"] is not None:
                aps.append(row["pr_auc"])
                cut.append(row["threshold"])
        worth = (sum(aps) / len(aps) if aps else float("-inf"), settings, sum(cut) / len(cut) if cut else 0.5)
        if worth[0] > best[0]:
            best = worth
    return best[1], best[2]


def out_of_fold(df: DataFrame, features: list[str], folds: list, settings: dict, cap: int, order: Column, seed: int = 0) -> DataFrame:
    """Scores of every fold by a model of the others, with given settings."""
    from functools import reduce

    parts = []
    for f in folds:
        train, test = fold_frames(df, f, cap, order)
        parts.append(parcel_scores(Trees(train, features, seed, **settings).scored(test)))
    return reduce(DataFrame.union, parts)
