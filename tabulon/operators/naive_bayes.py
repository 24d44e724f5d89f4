"""Gaussian naive Bayes: class statistics by aggregation, scores as one row expression."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.vectors import argmax, array_sum, let, softmax

SMALLEST_DEVIATION = 1e-9
LOG_FLOOR = 1e-9
DENSITIES = ("normal", "scaled")


def class_statistics(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """(label, n, column_name, mean, std): population deviations with a floor, one aggregation for all classes."""
    stats = df.groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.avg(c).alias("mean"),
                     F.greatest(F.stddev_pop(c), F.lit(SMALLEST_DEVIATION)).alias("std"))
            for c in columns
        ]).alias("features"),
    )
    return stats.select("label", "n", F.inline("features"))


def class_scores(values: Column, priors: Sequence[float], means: Sequence[Sequence[float]],
                 stds: Sequence[Sequence[float]], density: str = "normal") -> Column:
    """Array of log prior + sum of log(density + 1e-9), one entry per class.

    "normal" divides the density by the deviation; "scaled" multiplies by it, as the published formula does.
    """
    if density not in DENSITIES:
        raise ValueError(f"density must be one of {DENSITIES}")
    table = [
        {"prior": math.log(p), "stats": [{"mean": float(x), "std": float(y)} for x, y in zip(m, s)]}
        for p, m, s in zip(priors, means, stds)
    ]
    # One constant for the whole table; the optimiser evaluates it once.
    classes = F.from_json(F.lit(json.dumps(table)), "array<struct<prior: double, stats: array<struct<mean: double, std: double>>>>")
    root = math.sqrt(2 * math.pi)

    def log_density(x: Column, stat: Column) -> Column:
        z = (x - stat["mean"]) / stat["std"]
        factor = 1 / (root * stat["std"]) if density == "normal" else stat["std"] / root
        return F.log(factor * F.exp(-0.5 * z * z) + LOG_FLOOR)

    return F.transform(classes, lambda c: c["prior"] + array_sum(
        F.zip_with(values, c["stats"], log_density)))


def with_class_probabilities(df: DataFrame, stats: DataFrame, columns: Sequence[str],
                             density: str = "normal") -> DataFrame:
    """Adds probabilities, an array of (label, p) in label order, and predicted, the most probable label.

    The statistics have one number per class and column; the rows are scored without a join or a shuffle.
    """
    place = {c: i for i, c in enumerate(columns)}
    found: dict = {}
    for r in stats.collect():
        entry = found.setdefault(r["label"], (r["n"], [0.0] * len(columns), [0.0] * len(columns)))
        entry[1][place[r["column_name"]]], entry[2][place[r["column_name"]]] = r["mean"], r["std"]
    labels = sorted(found)
    total = sum(found[c][0] for c in labels)
    values = F.array(*[F.col(c).cast("double") for c in columns])
    scored = df.withColumn("_scores", class_scores(
        values, [found[c][0] / total for c in labels], [found[c][1] for c in labels], [found[c][2] for c in labels],
        density))
    scored = scored.withColumn("_p", softmax("_scores"))
    named = F.arrays_zip(F.array(*[F.lit(c) for c in labels]).alias("label"), F.col("_p").alias("p"))
    return scored.withColumn("probabilities", named).withColumn(
        "predicted", F.get(F.array(*[F.lit(c) for c in labels]), argmax("_p"))).drop("_scores", "_p")


class _BayesParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol):
    density = Param(Params._dummy(), "density", "normal or scaled", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction",
                         probabilityCol="probability", density="normal")


class GaussianBayes(Estimator, _BayesParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits on a feature vector and a label 0.0, 1.0, …; one aggregation, whatever the number of classes."""

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", density="normal"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> GaussianBayesModel:
        label, features = self.getLabelCol(), self.getFeaturesCol()
        found = (
            dataset.groupBy(F.col(label).alias("label"))
            .agg(Summarizer.metrics("count", "mean", "variance").summary(F.col(features)).alias("s"))
            .select("label", F.col("s.count").alias("n"), vector_to_array("s.mean").alias("mean"),
                    vector_to_array("s.variance").alias("variance"))
            .orderBy("label").collect()
        )
        total = sum(r["n"] for r in found)
        classes = int(max(r["label"] for r in found)) + 1
        model = GaussianBayesModel()
        # The summary's variance has n - 1 below the line; the score uses the population form.
        stds = [[max(math.sqrt(v * (r["n"] - 1) / r["n"]), SMALLEST_DEVIATION) for v in r["variance"]] for r in found]
        model._set(
            classCount=classes, classes=[float(r["label"]) for r in found], priors=[r["n"] / total for r in found],
            means=[x for r in found for x in r["mean"]], stds=[x for row in stds for x in row],
            featuresCol=features, labelCol=label, predictionCol=self.getPredictionCol(),
            probabilityCol=self.getProbabilityCol(), density=self.getOrDefault(self.density),
        )
        return model


class GaussianBayesModel(Model, _BayesParams, DefaultParamsReadable, DefaultParamsWritable):
    classCount = Param(Params._dummy(), "classCount", "length of the probability vector", TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "labels seen", TypeConverters.toListFloat)
    priors = Param(Params._dummy(), "priors", "class shares", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "means, class by class", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "deviations, class by class", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        classes, priors = self.getOrDefault(self.classes), self.getOrDefault(self.priors)
        width = len(self.getOrDefault(self.means)) // len(classes)
        rows = [slice(i * width, (i + 1) * width) for i in range(len(classes))]
        means = [self.getOrDefault(self.means)[r] for r in rows]
        stds = [self.getOrDefault(self.stds)[r] for r in rows]
        seen = {int(c): i for i, c in enumerate(classes)}

        def by_label(p: Column) -> Column:
            return F.array(*[
                F.get(p, F.lit(seen[c])) if c in seen else F.lit(0.0) for c in range(self.getOrDefault(self.classCount))])

        scores = let(vector_to_array(self.getFeaturesCol()), lambda v: class_scores(
            v, priors, means, stds, self.getOrDefault(self.density)))
        scored = dataset.withColumn("_p", let(softmax(scores), by_label))
        return scored.withColumns({
            self.getProbabilityCol(): array_to_vector("_p"),
            self.getPredictionCol(): argmax("_p").cast("double"),
        }).drop("_p")
