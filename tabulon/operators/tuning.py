"""Cross-validation, random search, candidate models and model selection on a prepared feature table."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark import SparkContext
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.common import _py2java
from pyspark.ml.feature import Imputer, IndexToString, StandardScaler, StandardScalerModel, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators import metrics
from tabulon.operators.batch_logistic import fit_many, fold_accuracies, pack
from tabulon.operators.logistic import logistic_regression
from tabulon.operators.naive_bayes import GaussianBayes
from tabulon.operators.rows import is_numeric
from tabulon.operators.splits import row_digest, with_folds, with_split
from tabulon.operators.trees import decision_tree, random_forest
from tabulon.sources.tables import TASK_ROWS

FOLDS = 5
SEARCH_DRAWS = 50
SEARCH_FOLDS = 3
#: The most classes that a target may have.
MAX_CLASSES = 1000
SEED = 42

# Names of the candidate models.
NAIVE_BAYES = "Naive Bayes"
TREE = "Decision Tree"
FOREST = "Random Forest"
LOGISTIC = "Logistic Regression"
TUNED = "Tuned Logistic Regression"


@dataclass
class Prepared:
    """Rows with `features`, `label`, `fold` and `is_test`, and the fitted stages that make features from a table."""

    frame: DataFrame
    stages: PipelineModel
    mode: str
    labels: list[str] | None = None
    inputs: list[str] = field(default_factory=list)

    @property
    def classes(self) -> int:
        return len(self.labels or [])


@contextmanager
def held(data: Prepared) -> Iterator[Prepared]:
    """The rows in memory, computed by all tasks at once, for fits that read them again and again. A pass costs each task the
    sums of all nodes or weights, however few rows it has, so partitions beyond two a core are merged, up to TASK_ROWS rows."""
    frame = data.frame.persist()
    try:
        parts = max(frame.sparkSession.sparkContext.defaultParallelism, -(-frame.count() // TASK_ROWS))
        yield replace(data, frame=frame.coalesce(parts) if frame.rdd.getNumPartitions() > 2 * parts else frame)
    finally:
        frame.unpersist()


def prepare(df: DataFrame, target: str, numbers: Sequence[str], mode: str = "classification", key: str | None = None,
            text_stages: Sequence = (), text_outputs: Sequence[str] = (), folds: int = FOLDS) -> Prepared:
    """Impute and assemble the inputs, index the target, and mark folds and the held-out fifth."""
    numbers = list(numbers)
    filled = [f"_num_{i}" for i in range(len(numbers))]
    stages = [Imputer(strategy="mean", inputCols=numbers, outputCols=filled)] if numbers else []
    stages += list(text_stages)
    stages.append(VectorAssembler(inputCols=[*filled, *text_outputs], outputCol="features", handleInvalid="keep"))
    cast = df.withColumns({c: F.col(c).cast("double") for c in numbers}).where(F.col(target).isNotNull())
    fitted = Pipeline(stages=stages).fit(cast)
    marked = with_split(cast.withColumn("_target", F.col(target)), key)
    marked = marked.withColumn("_row_digest", row_digest(key, marked.columns, SEED))
    # Dealing the folds shuffles the rows: their features go along, texts and other inputs do not.
    made = fitted.transform(marked).select("features", "is_test", "_target", "_row_digest", *([F.col(key).alias("_key")] if key else []))
    made = with_folds(made, "_target" if mode == "classification" else None, "_key" if key else None, folds, digest="_row_digest")
    made = made.select("features", "fold", "is_test", "_target")
    if mode == "classification":
        labels = sorted_labels(df, target)
        made = made.withColumn("_target", F.col("_target").cast("string"))
        made = StringIndexerModel.from_labels(labels, inputCol="_target", outputCol="label").transform(made)
    else:
        labels = None
        made = made.withColumn("label", F.col("_target").cast("double"))
    frame = made.drop("_target")
    return Prepared(frame, fitted, mode, labels, numbers)


def sorted_labels(df: DataFrame, target: str) -> list[str]:
    """The distinct labels in the order of their own type, as text; an error above MAX_CLASSES of them, as a model
    holds an entry per class."""
    order = F.col(target).cast("double") if is_numeric(df.schema[target]) else F.col(target).cast("string")
    found = df.where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("label"), order.alias("o"))
    labels = [r["label"] for r in found.distinct().orderBy("o").limit(MAX_CLASSES + 1).collect()]
    if len(labels) > MAX_CLASSES:
        raise ValueError(f"{target!r} has more than {MAX_CLASSES} classes")
    return labels


class PopulationScaler(Estimator):
    """Z-scores with the population deviation, as everywhere in the library; the fitted stage is Spark's own."""

    def _fit(self, df: DataFrame):
        found = StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="scaled").fit(df)
        rows = df.count()
        if rows < 2:
            return found
        context = SparkContext._active_spark_context
        std = _py2java(context, Vectors.dense(found.std.toArray() * math.sqrt((rows - 1) / rows)))
        made = context._jvm.org.apache.spark.ml.feature.StandardScalerModel(found._java_obj.uid(), std, found._java_obj.mean())
        for param, value in (("inputCol", "features"), ("outputCol", "scaled"), ("withMean", True), ("withStd", True)):
            made.set(made.getParam(param), value)
        return StandardScalerModel(made)


def scaled(estimator: Estimator) -> Pipeline:
    """Z-score, then the model."""
    return Pipeline(stages=[PopulationScaler(), estimator.copy().setFeaturesCol("scaled")])


def single(estimator: Estimator) -> Pipeline:
    return Pipeline(stages=[estimator])


def candidates(mode: str, tuned: LogisticRegression | None = None, trees: int = 100, forest_depth: int = 25) -> dict[str, Pipeline]:
    """Pipelines by name, in the order in which ties are decided."""
    found = {}
    if mode == "classification":
        found[NAIVE_BAYES] = single(GaussianBayes())
    found[f"{TREE} {mode}"] = single(decision_tree(mode))
    found[f"{FOREST} {mode}"] = scaled(random_forest(mode, trees, forest_depth))
    if mode == "classification":
        found[LOGISTIC] = scaled(logistic_regression())
        if tuned is not None:
            found[TUNED] = scaled(tuned)
    return found


def predictions(model: PipelineModel, df: DataFrame, *keep: str) -> DataFrame:
    """label, prediction, probability as an array (classifiers only)."""
    out = model.transform(df)
    extra = [vector_to_array("probability").alias("probability")] if "probability" in out.columns else []
    return out.select(*keep, "label", "prediction", *extra)


def score(predicted: DataFrame, mode: str, classes: int, by: Sequence[str] = ()) -> DataFrame:
    """(by…, score): R2 for regression, else ROC-AUC."""
    if mode == "regression":
        return metrics.r2(predicted, by=by).withColumnRenamed("r2", "score")
    return metrics.class_auc(predicted, "label", "probability", classes, by).withColumnRenamed("auc", "score")


def cross_validated_score(pipeline: Pipeline, data: Prepared, folds: int = FOLDS, parallelism: int = 4) -> DataFrame:
    """One row (score): mean over folds. The folds' predictions are scored together, in one job."""
    def run(fold: int) -> DataFrame:
        model = pipeline.fit(data.frame.where(F.col("fold") != fold))
        return predictions(model, data.frame.where(F.col("fold") == fold), "fold")

    with ThreadPoolExecutor(parallelism) as pool:
        parts = list(pool.map(run, range(folds)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return score(out, data.mode, data.classes, ["fold"]).agg(F.avg("score").alias("score"))


def held_out_score(pipeline: Pipeline, data: Prepared) -> tuple[PipelineModel, DataFrame]:
    model = pipeline.fit(data.frame.where(~F.col("is_test")))
    return model, predictions(model, data.frame.where("is_test"))


@dataclass
class Search:
    params: dict[str, float]
    scores: dict[str, float | None]
    trials: DataFrame
    estimator: LogisticRegression
    passes: int


def random_search(data: Prepared, draws: int = SEARCH_DRAWS, folds: int = SEARCH_FOLDS, seed: int = SEED,
                  max_iter: int = 100) -> Search:
    """Seeded draws of the L2 strength from U(0.01, 10.01), scored by accuracy over folds of the training part. All draws on
    all folds are fitted in the same passes over the rows."""
    rng = random.Random(seed)
    strengths = [rng.uniform(0.01, 10.01) for _ in range(draws)]
    train = data.frame.where(~F.col("is_test"))
    blocks = pack(train.withColumn("search_fold", F.pmod(F.xxhash64("features", "label", "fold"), F.lit(folds)).cast("int")), fold="search_fold")
    fits = fit_many(blocks, data.classes, strengths, folds, max_iter)
    # A fold without rows has no say.
    means = [float(np.nanmean(a)) if np.isfinite(a).any() else 0.0 for a in fold_accuracies(blocks, fits).T]
    trials = data.frame.sparkSession.createDataFrame(
        [(i, s, a) for i, (s, a) in enumerate(zip(strengths, means))], "draw int, l2 double, accuracy double")
    best = max(range(draws), key=lambda i: (round(means[i], 12), -i))
    chosen = logistic_regression(strengths[best], max_iter)
    found = predictions(scaled(chosen).fit(train), data.frame.where("is_test")).persist()
    counts = metrics.one_vs_rest(metrics.confusion(found))
    scores = {
        "Accuracy": metrics.accuracy(found).head()[0],
        "F1 Score": metrics.weighted_f1(counts).head()[0],
        "ROC AUC": score(found, "classification", data.classes).head()["score"],
    }
    found.unpersist()
    return Search({"L2": strengths[best]}, scores, trials, chosen, fits.passes)


@dataclass
class Selection:
    best: str
    score: float
    table: DataFrame
    pipeline: Pipeline


def best_of(table: DataFrame) -> DataFrame:
    """One row (model, score): the highest score, the first candidate on ties."""
    known = table.where(F.col("score").isNotNull())
    return known.agg(F.max_by("model", F.struct("score", -F.col("order"))).alias("model"), F.max("score").alias("score"))


def select_model(data: Prepared, models: dict[str, Pipeline], folds: int = FOLDS, parallelism: int = 4) -> Selection:
    """Score every candidate: folds for Bayes and the logistic model, the held-out fifth for the others."""
    spark: SparkSession = data.frame.sparkSession
    rows = []
    for order, (name, pipeline) in enumerate(models.items()):
        begin = time.monotonic()
        if name in (NAIVE_BAYES, LOGISTIC):
            protocol, value = f"{folds}-fold", cross_validated_score(pipeline, data, folds, parallelism).head()["score"]
        else:
            _, found = held_out_score(pipeline, data)
            protocol, value = "hold-out", score(found, data.mode, data.classes).head()["score"]
        rows.append((order, name, protocol, value, time.monotonic() - begin))
    table = spark.createDataFrame(rows, "order int, model string, protocol string, score double, seconds double")
    best = best_of(table).head()
    return Selection(best["model"], best["score"], table, models[best["model"]])


def train_one(data: Prepared, name: str) -> tuple[PipelineModel, dict[str, float | None]]:
    """Fit one named model on the training part; accuracy and ROC-AUC, or R2, on the rest."""
    plain = {NAIVE_BAYES: GaussianBayes, TREE: lambda: decision_tree(data.mode),
             FOREST: lambda: random_forest(data.mode), LOGISTIC: logistic_regression}
    if name not in plain:
        raise ValueError(f"invalid model choice: {name}")
    if data.mode == "regression" and name in (NAIVE_BAYES, LOGISTIC):
        raise ValueError(f"{name} cannot fit a continuous target")
    pipeline = scaled(plain[name]()) if name == LOGISTIC else single(plain[name]())
    model, found = held_out_score(pipeline, data)
    found = found.persist()
    scores = {
        "accuracy": metrics.accuracy(found).head()[0] if data.mode == "classification" else None,
        "score": score(found, data.mode, data.classes).head()["score"],
    }
    found.unpersist()
    return model, scores


def full_model(data: Prepared, model: PipelineModel) -> PipelineModel:
    """Feature stages, model and label names in one savable pipeline."""
    stages = [*data.stages.stages, *model.stages]
    if data.labels is not None:
        stages.append(IndexToString(inputCol="prediction", outputCol="predicted_label", labels=data.labels))
    return PipelineModel(stages)
