"""Boosted and bagged trees on feature vectors, as page scorers: histogram trees of Spark's machine learning, with class weights and early selection on a validation part.

Boosting is between two classes; several are each held against the rest, and their probabilities are scaled to a sum of 1. Trees never see a page alone: a task's rows are
counted in histograms of features, so a level of a tree is one pass whose result doesn't grow with the rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.graph import saved


@dataclass(frozen=True)
class Settings:
    """Of boosting: rounds at most, depth, learning rate, shares of the rows and of the features that a tree sees, histogram bins, seed, and by how little the validation loss may fall to go on."""

    rounds: int = 300
    depth: int = 6
    rate: float = 0.05
    rows: float = 0.8
    features: float = 0.8
    bins: int = 64
    seed: int = 42
    tolerance: float = 1e-4
    least_rows: int = 1


def _vector(df: DataFrame, vector: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("_x", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))


def positive_weight(train: DataFrame, label: str, positive: int = 1) -> float:
    """How many rows of the other classes there are for one of the positive."""
    n = train.agg(F.count_if(F.col(label) == positive).alias("p"), F.count_if(F.col(label) != positive).alias("n")).first()
    return float(n["n"]) / max(n["p"], 1)


class BoostedTrees:
    """A boosted model for each class (for two classes one, of class 1)."""

    def __init__(self, models: list, classes: int):
        self.models, self.classes = models, classes

    def scored(self, df: DataFrame, vector: str) -> DataFrame:
        """``df`` with probs (of each class, in order), predicted (the likeliest, the first of several) and probability."""
        from pyspark.ml.functions import vector_to_array

        out = _vector(df, vector)
        names = []
        for i, m in enumerate(self.models):
            m.setFeaturesCol("_x").setProbabilityCol(f"_p{i}").setPredictionCol(f"_y{i}").setRawPredictionCol(f"_r{i}")
            out = m.transform(out)
            names.append(vector_to_array(f"_p{i}")[1])
        if self.classes == 2 and len(self.models) == 1:
            probs = F.array(1 - names[0], names[0])
        else:
            total = sum(names[1:], names[0])
            probs = F.array(*[F.when(total > 0, p / total).otherwise(1.0 / self.classes) for p in names])
        from quire.functions.scalars import argmax

        out = out.withColumn("probs", probs).drop("_x", *[f"_{c}{i}" for c in "pyr" for i in range(len(self.models))])
        return out.withColumns({"predicted": argmax(F.col("probs")), "probability": F.array_max("probs")})

    def save(self, spark: SparkSession, folder: str) -> None:
        """Models and model_config.json, as ``load`` and the registry read them; what is there is replaced."""
        for i, m in enumerate(self.models):
            m.write().overwrite().save(f"{folder.rstrip('/')}/model_{i}")
        config = [(json.dumps({"family": "trees", "classes": self.classes, "models": len(self.models)}),)]
        spark.createDataFrame(config, "value string").coalesce(1).write.mode("overwrite").text(f"{folder.rstrip('/')}/model_config.json")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> BoostedTrees:
        from pyspark.ml.classification import GBTClassificationModel

        config = json.loads(spark.read.text(f"{folder.rstrip('/')}/model_config.json").first()[0])
        return cls([GBTClassificationModel.load(f"{folder.rstrip('/')}/model_{i}") for i in range(config["models"])], config["classes"])


def boosted(train: DataFrame, valid: DataFrame | None, vector: str, label: str, classes: int, settings: Settings = Settings()) -> BoostedTrees:
    """Boosts on ``train`` (label: 0 to classes - 1) until the loss on ``valid`` no longer falls.

    Classes weigh as much as all others together. A null vector or label takes no part; a class without rows in ``train`` gets a probability near 0; an empty ``train`` is an error.
    """
    from pyspark.ml.classification import GBTClassifier

    rows = train.select(vector, label).withColumn("_valid", F.lit(False))
    if valid is not None:
        rows = rows.unionByName(valid.select(vector, label).withColumn("_valid", F.lit(True)))
    rows = saved(rows.filter(F.col(vector).isNotNull() & F.col(label).isNotNull()))
    sizes = {r[label]: r["n"] for r in rows.filter("NOT _valid").groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each class
    if not sizes:
        raise ValueError("no rows to learn from")
    total, models = sum(sizes.values()), []
    for k in [1] if classes == 2 else range(classes):
        own = sizes.get(k, 0)
        weight = (total - own) / max(own, 1)
        marked = _vector(rows, vector).withColumns({"_label": (F.col(label) == k).cast("double"), "_weight": F.when(F.col(label) == k, float(max(weight, 1e-6))).otherwise(1.0)})
        gbt = GBTClassifier(featuresCol="_x", labelCol="_label", weightCol="_weight", maxIter=settings.rounds, maxDepth=settings.depth, stepSize=settings.rate, subsamplingRate=settings.rows,
                            featureSubsetStrategy=str(float(settings.features)), maxBins=settings.bins, seed=settings.seed, minInstancesPerNode=settings.least_rows, validationTol=settings.tolerance)
        if valid is not None:
            gbt = gbt.setValidationIndicatorCol("_valid")
        models.append(gbt.fit(marked))
    return BoostedTrees(models, classes)


def forest(train: DataFrame, vector: str, label: str, trees: int = 100, depth: int = 8, bins: int = 64, seed: int = 42, weight: Column | None = None):
    """A random forest over all classes at once; its ``transform`` is in ``forest_scored``."""
    from pyspark.ml.classification import RandomForestClassifier

    rows = _vector(train.filter(F.col(vector).isNotNull() & F.col(label).isNotNull()), vector).withColumn("_label", F.col(label).cast("double"))
    rows = rows.withColumn("_weight", weight if weight is not None else F.lit(1.0))
    return RandomForestClassifier(featuresCol="_x", labelCol="_label", weightCol="_weight", numTrees=trees, maxDepth=depth, maxBins=bins, seed=seed).fit(rows)


def forest_scored(model, df: DataFrame, vector: str) -> DataFrame:
    """``df`` with probs, predicted and probability."""
    from pyspark.ml.functions import vector_to_array

    from quire.functions.scalars import argmax

    out = model.setFeaturesCol("_x").transform(_vector(df, vector)).withColumn("probs", vector_to_array(F.col("probability"))).drop("_x", "rawPrediction", "probability", "prediction")
    return out.withColumns({"predicted": argmax(F.col("probs")), "probability": F.array_max("probs")})


def stump(train: DataFrame, vector: str, label: str, bins: int = 256):
    """The best single split between two classes, by Gini impurity."""
    from pyspark.ml.classification import DecisionTreeClassifier

    rows = _vector(train, vector).withColumn("_label", F.col(label).cast("double"))
    return DecisionTreeClassifier(featuresCol="_x", labelCol="_label", maxDepth=1, maxBins=bins, impurity="gini").fit(rows)
