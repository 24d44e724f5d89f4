"""Classification and regression scores from grouped counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators.ordered import with_running_totals


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(label) == F.col(prediction)).cast("int")).alias("accuracy"))


def r2(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """1 - SSE / SST in one aggregation."""
    y, p = F.col(label), F.col(prediction)
    return df.groupBy(*by).agg((1 - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))).alias("r2"))


def adjusted_rand(df: DataFrame, first: str, second: str) -> DataFrame:
    """One row (adjusted_rand): how far two labellings agree on which rows belong together, 1 for the same partition, about 0
    for unrelated ones. Rows without one of the labels are left out; without any pair of rows the partitions are the same."""
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2.0
    cells = df.where(F.col(first).isNotNull() & F.col(second).isNotNull()).groupBy(F.col(first).alias("a"), F.col(second).alias("b")) \
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    sums = lambda by: F.coalesce(cells.groupBy(by).agg(F.sum("n").alias("n")).agg(F.sum(pairs("n"))).scalar(), F.lit(0.0))
    found = cells.agg(F.sum("n").alias("n"), F.coalesce(F.sum(pairs("n")), F.lit(0.0)).alias("both")).select(
        "both", F.coalesce(pairs("n"), F.lit(0.0)).alias("all"), sums("a").alias("in_a"), sums("b").alias("in_b"))
    expected = F.coalesce(F.try_divide(F.col("in_a") * F.col("in_b"), F.col("all")), F.lit(0.0))
    most = (F.col("in_a") + F.col("in_b")) / 2
    return found.select(F.coalesce(F.try_divide(F.col("both") - expected, most - expected), F.lit(1.0)).alias("adjusted_rand"))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n): the only pass over the rows; all rates come from this small table."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def one_vs_rest(pairs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(label, tp, tn, fp, fn). With a `labels` frame (label), other true labels are left out and absent ones get zeros."""
    if labels is not None:
        pairs = pairs.join(labels.select("label"), "label", "left_semi")
    hit = F.col("label") == F.col("prediction")
    actual = pairs.groupBy("label").agg(F.sum("n").alias("actual_n"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"))
    predicted = pairs.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted_n"))
    base = actual if labels is None else labels.select("label").join(actual, "label", "left")
    total = F.coalesce(pairs.agg(F.sum("n")).scalar(), F.lit(0))
    counted = base.join(predicted, "label", "left").na.fill(0, ["actual_n", "tp", "predicted_n"])
    tp, actual_n, predicted_n = F.col("tp"), F.col("actual_n"), F.col("predicted_n")
    return counted.select(
        "label", "tp", (total - actual_n - predicted_n + tp).alias("tn"), (predicted_n - tp).alias("fp"),
        (actual_n - tp).alias("fn"))


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def rate_columns(tp="tp", tn="tn", fp="fp", fn="fn") -> dict[str, Column]:
    """Rates of a 2 x 2 table; 0 where a denominator is 0."""
    tp, tn, fp, fn = (F.col(c) if isinstance(c, str) else c for c in (tp, tn, fp, fn))
    sensitivity, precision = _rate(tp, tp + fn), _rate(tp, tp + fp)
    return {
        "sensitivity": sensitivity,
        "specificity": _rate(tn, tn + fp),
        "precision": precision,
        "npv": _rate(tn, tn + fn),
        "accuracy": _rate(tp + tn, tp + tn + fp + fn),
        "f_score": _rate(2 * precision * sensitivity, precision + sensitivity),
    }


def binary_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns(rate_columns())


def macro_average(counts: DataFrame) -> DataFrame:
    rates = rate_columns()
    return counts.agg(*[
        F.avg(rates[r]).alias(f"macro_{r}") for r in ("precision", "sensitivity", "specificity", "f_score")])


def micro_average(counts: DataFrame) -> DataFrame:
    sums = counts.agg(*[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")])
    rates = rate_columns()
    return sums.select(*[
        rates[r].alias(f"micro_{r}") for r in ("precision", "sensitivity", "specificity", "f_score")])


def weighted_f1(counts: DataFrame) -> DataFrame:
    """Mean of the per-class F scores, weighted by the number of true rows."""
    support = F.col("tp") + F.col("fn")
    return counts.agg((F.sum(rate_columns()["f_score"] * support) / F.sum(support)).alias("weighted_f1"))


def roc_auc(df: DataFrame, positive: Column, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by…, auc, positives, negatives); equal scores count one half.

    Equal scores are merged first, then a distributed running total gives the negatives below each score.
    """
    hit = F.when(positive, F.lit(1)).otherwise(F.lit(0)).cast("long")
    steps = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("_score")).agg(
        F.sum(hit).alias("_pos"), F.sum(1 - hit).alias("_neg"))
    ranked = with_running_totals(steps, by, ["_score"], {"_below": F.col("_neg")})
    won = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2))
    return ranked.groupBy(*by).agg(
        F.try_divide(won, F.sum("_pos").cast("double") * F.sum("_neg")).alias("auc"),
        F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives"))


def ovr_auc(df: DataFrame, label: str, probabilities: str, by: Sequence[str] = ()) -> DataFrame:
    """(by…, auc): one-vs-rest AUC per class of a probability array, weighted by the class's rows."""
    long = df.select(*by, F.col(label).cast("int").alias("_label"), F.posexplode(probabilities).alias("_class", "_p"))
    per_class = roc_auc(long, F.col("_label") == F.col("_class"), "_p", [*by, "_class"])
    return per_class.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("auc") * F.col("positives")),
                     F.sum(F.when(F.col("auc").isNotNull(), F.col("positives")))).alias("auc"))


def class_auc(df: DataFrame, label: str, probabilities: str, classes: int, by: Sequence[str] = ()) -> DataFrame:
    """AUC of P(class 1) for two classes, the weighted one-vs-rest AUC for more."""
    if classes > 2:
        return ovr_auc(df, label, probabilities, by)
    scored = df.withColumn("_p1", F.get(probabilities, F.lit(1)))
    return roc_auc(scored, F.col(label) == 1, "_p1", by).select(*by, "auc")
