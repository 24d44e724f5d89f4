"""The clustering run: clean, reduce, choose k, label, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators import clustering as C
from tabulon.operators.clean import clean_features
from tabulon.operators.reduce import (CORRELATION_LIMIT, EXPLAINED_VARIANCE, MAX_COMPONENTS, VARIANCE_LIMIT, plane_view,
                                      reduce_features)
from tabulon.operators.report import report_rows


@dataclass
class ClusterRun:
    """Input rows with label columns (and pc1, pc2 when asked for), and the tables of the report."""

    labelled: DataFrame
    k: int
    elbow: DataFrame
    silhouette: DataFrame
    loadings: DataFrame
    report: DataFrame


def cluster_table(df: DataFrame, algorithm: str = "k-Means",
                  correlation_limit: float = CORRELATION_LIMIT, variance_limit: float = VARIANCE_LIMIT,
                  explained_variance: float = EXPLAINED_VARIANCE, max_components: int = MAX_COMPONENTS,
                  plane: bool = False, k_max: int = C.K_MAX, parallelism: int = 5,
                  ignore: tuple[str, ...] = (), micro: int | None = C.MICRO_CLUSTERS) -> ClusterRun:
    """`micro` bounds what Ward's tree starts from; None is the exact tree over all rows."""
    spark = df.sparkSession
    clean, features, genders = clean_features(df, "_f_")
    features = [c for c in features if c.removeprefix("_f_") not in ignore]
    reduced = reduce_features(clean, features, correlation_limit, variance_limit, explained_variance, max_components)
    scores = reduced.components

    slim = reduced.frame.select(*scores).persist()
    try:
        found = C.sweep(slim, scores, k_max, parallelism)
        choice = C.elbow_point(found.curve).select("elbow_k", C.best_silhouette(found.curve).scalar().alias("silhouette_k"))
        row = choice.select(
            C.chosen_k(F.col("elbow_k"), F.col("silhouette_k")).alias("k"),
            C.choice_reason(F.col("elbow_k"), F.col("silhouette_k")).alias("reason"),
        ).head()
        k = max(row["k"], 2)
        labelled = C.cluster_labels(reduced.frame, scores, k, algorithm, found.models[k], micro)
        labels = [c for c in (C.KMEANS_COLUMN, C.WARD_COLUMN) if c in labelled.columns]
        rows_of_report = [
            ("reduction", "columns", ", ".join(c.removeprefix("_f_") for c in reduced.columns)), ("reduction", "info", reduced.info),
            ("clusters", "k", k), ("clusters", "reason", row["reason"]),
        ]
        if genders is not None:
            rows_of_report += [("encoding", r["label"], r["code"]) for r in genders.orderBy("code").collect()]
        for column in labels:
            value = _silhouette(labelled, scores, column, k, found)
            band = spark.range(1).select(C.silhouette_band(F.lit(value).cast("double"))).head()[0]
            rows_of_report += [(column, "silhouette", value), (column, "band", band)]
    finally:
        slim.unpersist()
    if plane:
        labelled = plane_view(labelled, scores)
    extra = ["pc1", "pc2"][: len(scores)] if plane else []
    result = labelled.select(*df.columns, *labels, *extra)
    loadings = reduced.loadings.withColumn("column_name", F.regexp_replace("column_name", "^_f_", ""))
    return ClusterRun(result, k, C.elbow_curve(found.curve), C.silhouette_curve(found.curve), loadings,
                      report_rows(spark, rows_of_report))


def _silhouette(labelled: DataFrame, scores: list[str], column: str, k: int, found: C.Sweep) -> float | None:
    """Each labelling gets its own score; the sweep already has the one of k-Means."""
    if column == C.KMEANS_COLUMN:
        return found.curve.where(F.col("k") == k).head()["silhouette"]
    featured = C.assemble(labelled.select(*scores, column), scores)
    return ClusteringEvaluator(predictionCol=column, featuresCol="features").evaluate(featured)
