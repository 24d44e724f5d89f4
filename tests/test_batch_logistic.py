"""Logistic regressions fitted together, against one fit after the other."""

import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabulon.operators import batch_logistic as B
from tabulon.operators import tuning
from tabulon.operators.logistic import logistic_regression

FEATURES = [f"x{i}" for i in range(5)]
STRENGTHS = [0.02, 0.7, 6.0]


@pytest.fixture(scope="module")
def rows(spark):
    noise = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 250
    label = F.pmod(F.xxhash64("id"), F.lit(3)).cast("int")
    df = spark.range(700).select("id", label.cast("double").alias("label"), F.pmod(F.xxhash64("id", F.lit(99)), F.lit(3)).cast("int").alias("fold"),
                                 *[(noise(i) * (i + 1) + (label == i % 3).cast("int") * 2).alias(c) for i, c in enumerate(FEATURES[:4])], F.lit(3.0).alias("x4"))
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df).repartition(4).persist()


def test_same_as_single_fits(rows):
    blocks = B.pack(rows)
    fits = B.fit_many(blocks, 3, STRENGTHS, 3)
    assert np.abs(fits.gradients).max() < 1e-4
    got = B.fold_accuracies(blocks, fits)
    measure = MulticlassClassificationEvaluator(metricName="accuracy")
    for fold in range(3):
        for d in (0, 2):
            model = tuning.scaled(logistic_regression(STRENGTHS[d], 200)).fit(rows.where(F.col("fold") != fold))
            assert abs(measure.evaluate(model.transform(rows.where(F.col("fold") == fold))) - got[fold, d]) < 1e-3
            own = fits.weights[fold, d][:, :-1]
            theirs = model.stages[1].coefficientMatrix.toArray()
            assert np.abs((own - own.mean(axis=0)) - (theirs - theirs.mean(axis=0))).max() < 5e-3


def test_passes_do_not_grow_with_the_models(rows, monkeypatch):
    blocks = B.pack(rows)
    few = B.fit_many(blocks, 3, [0.02, 6.0], 3)
    many = B.fit_many(blocks, 3, [0.02 + 0.2 * i for i in range(30)], 3)
    assert many.passes <= 1.5 * few.passes
    # More weights than fit at once, sums that are added up in between, and small blocks give the same.
    monkeypatch.setattr(B, "MAX_WEIGHTS", 40)
    monkeypatch.setattr(B, "DIRECT_BYTES", 0)
    monkeypatch.setattr(B, "SCORES", 50)
    again = B.fit_many(blocks, 3, [0.02, 6.0], 3)
    assert np.abs(again.weights - few.weights).max() < 1e-4


def test_one_fold_and_scaler(rows):
    fits = B.fit_many(B.pack(rows), 3, [0.1])
    model = tuning.scaled(logistic_regression(0.1, 300)).fit(rows)
    scaler, fitted = model.stages
    x = np.array([r.features.toArray() for r in rows.select("features").collect()])
    assert np.allclose(scaler.std.toArray(), x.std(axis=0)) and np.allclose(scaler.mean.toArray(), x.mean(axis=0))
    assert np.allclose(1 / fits.scales[0][:4], x.std(axis=0)[:4]) and fits.scales[0][4] == 0
    weights = np.hstack((fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()[:, None]))
    scaled = scaler.transform(rows).withColumn("fold", F.lit(0))
    assert np.abs(B.gradient_at(B.pack(scaled, "scaled"), weights, 0.1)).max() < 1e-4
    assert np.abs(B.gradient_at(B.pack(scaled, "scaled"), weights + 0.3, 0.1)).max() > 1e-3


def test_scaled_model_can_be_saved(rows, tmp_path):
    from pyspark.ml import PipelineModel
    model = tuning.scaled(logistic_regression(0.1, 20)).fit(rows)
    model.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(rows).select("id", "prediction")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, model.transform(rows).select("id", "prediction").collect()))


def test_no_rows(spark, rows):
    fits = B.fit_many(B.pack(rows.limit(0)), 3, [0.1, 1.0], 2)
    assert not fits.weights.any() and np.isnan(B.fold_accuracies(B.pack(rows.limit(0)), fits)).all()
