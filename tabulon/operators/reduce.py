"""Feature reduction: correlation filter, variance filter, PCA."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators.clean import scale

CORRELATION_LIMIT = 0.85
VARIANCE_LIMIT = 0.02
EXPLAINED_VARIANCE = 0.95
MAX_COMPONENTS = 10


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col_i, pos_i, col_j, pos_j, r) for all pairs i < j, over the rows in which both values are present; NaN counts
    as missing. r is null where a column is constant in those rows, or where there are none.

    Two passes: the means, then the sums of all pairs around them, whatever the width. Each task adds up its own rows
    and sends one line for each pair of columns.
    """
    columns = list(columns)
    d = len(columns)
    if d < 2:
        raise ValueError("a correlation needs two columns")
    numbers = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"c{i}") for i, c in enumerate(columns)])
    means = numbers.agg(*[F.avg(c).alias(c) for c in numbers.columns]).head()
    centre = np.array([0.0 if m is None else m for m in means])
    first, second = np.triu_indices(d, 1)
    sums = ["n", "si", "sj", "qi", "qj", "p"]
    bounds = ["low_i", "high_i", "low_j", "high_j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, d, d))
        low, high = np.full((d, d), np.inf), np.full((d, d), -np.inf)
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float) - centre
            there = ~np.isnan(x)
            y, m = np.where(there, x, 0.0), there.astype(float)
            total += (m.T @ m, y.T @ m, (y * y).T @ m, y.T @ y)
            for j in range(d):
                own = x[there[:, j]]
                if len(own):
                    low[:, j] = np.fmin(low[:, j], np.fmin.reduce(own, axis=0))
                    high[:, j] = np.fmax(high[:, j], np.fmax.reduce(own, axis=0))
        n, s, q, p = total
        values = [n[first, second], s[first, second], s[second, first], q[first, second], q[second, first], p[first, second],
                  low[first, second], high[first, second], low[second, first], high[second, first]]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (first.astype(np.int32), second.astype(np.int32), *values)],
                                         ["pos_i", "pos_j", *sums, *bounds])

    schema = ", ".join(["pos_i int", "pos_j int", *[f"{c} double" for c in sums + bounds]])
    added = numbers.mapInArrow(run, schema).groupBy("pos_i", "pos_j").agg(
        *[F.sum(c).alias(c) for c in sums],
        *[(F.min if c.startswith("low") else F.max)(c).alias(c) for c in bounds])
    names = F.array(*[F.lit(c) for c in columns])
    # Rounding can leave a constant column a tiny deviation, so its bounds tell that it is constant.
    varied = (F.col("low_i") < F.col("high_i")) & (F.col("low_j") < F.col("high_j"))
    def around(square: str, one: str, other: str) -> Column:
        return F.col(square) - F.try_divide(F.col(one) * F.col(other), F.col("n"))

    spread = F.sqrt(around("qi", "si", "si") * around("qj", "sj", "sj"))
    r = F.when(varied, F.try_divide(around("p", "si", "sj"), spread))
    every = df.sparkSession.range(d).select(F.col("id").cast("int").alias("pos_i"))
    every = every.select("pos_i", F.explode(F.sequence(F.col("pos_i") + 1, F.lit(d))).alias("pos_j")).where(F.col("pos_j") < d)
    return every.join(added, ["pos_i", "pos_j"], "left").select(
        F.get(names, "pos_i").alias("col_i"), "pos_i", F.get(names, "pos_j").alias("col_j"), "pos_j", r.alias("r"))


def correlated_columns(pairs: DataFrame, limit: float = CORRELATION_LIMIT) -> DataFrame:
    """Columns whose signed correlation with any earlier column, dropped or not, is above the limit."""
    return pairs.where(F.col("r") > limit).select(F.col("col_j").alias("column_name")).distinct()


def drop_correlated(df: DataFrame, columns: Sequence[str], limit: float = CORRELATION_LIMIT) -> list[str]:
    if len(columns) < 2:
        return list(columns)
    dropped = {r[0] for r in correlated_columns(correlation_pairs(df, columns), limit).collect()}
    return [c for c in columns if c not in dropped]


def column_variances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, variance) with the population variance."""
    wide = df.agg(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.var_pop(c).alias("variance")) for c in columns
    ]).alias("v"))
    return wide.select(F.inline("v"))


def drop_low_variance(df: DataFrame, columns: Sequence[str], limit: float = VARIANCE_LIMIT) -> list[str]:
    kept = {r[0] for r in column_variances(df, columns).where(F.col("variance") > limit).collect()}
    if not kept:
        raise ValueError(f"no column has a variance above {limit}")
    return [c for c in columns if c in kept]


@dataclass
class Reduced:
    """Scores PC1..PCn next to the input columns, with the loadings and the variance shares."""

    frame: DataFrame
    components: list[str]
    columns: list[str]
    ratios: list[float]
    loadings: DataFrame
    info: str


def component_count(ratios: Sequence[float], threshold: float = EXPLAINED_VARIANCE,
                    limit: int = MAX_COMPONENTS) -> int:
    """Components below the cumulative threshold plus one, at most `limit`, at least two."""
    features = len(ratios)
    if features < 2:
        return 1
    wanted = int((np.cumsum(ratios) < threshold).sum()) + 1
    return max(min(wanted, limit, features), 2)


def project(df: DataFrame, columns: Sequence[str], threshold: float = EXPLAINED_VARIANCE,
            limit: int = MAX_COMPONENTS, prefix: str = "PC", count: int | None = None) -> Reduced:
    """Centred PCA scores. One covariance pass fits all components; the first n are kept."""
    columns = list(columns)
    spark = df.sparkSession
    if not columns:
        raise ValueError("no numeric column is left")
    if len(columns) == 1:
        name = f"{prefix}1"
        loadings = spark.createDataFrame([(columns[0], name, 1.0)], "column_name string, component string, weight double")
        return Reduced(df.withColumn(name, F.col(columns[0]).cast("double")), [name], columns, [1.0], loadings,
                       "Insufficient features after filtering. Returning original data.")
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).head()
    centred = df.withColumns({f"_centred_{i}": F.col(c) - means[c] for i, c in enumerate(columns)})
    assembler = VectorAssembler(inputCols=[f"_centred_{i}" for i in range(len(columns))], outputCol="_centred")
    assembled = assembler.transform(centred).drop(*assembler.getInputCols())
    model: PCAModel = PCA(k=len(columns), inputCol="_centred", outputCol="_scores").fit(assembled.select("_centred"))
    ratios = [float(x) for x in model.explainedVariance.toArray()]
    n = count or component_count(ratios, threshold, limit)
    weights = model.pc.toArray()
    names = [f"{prefix}{i + 1}" for i in range(n)]
    scores = model.transform(assembled).withColumn("_scores", vector_to_array("_scores"))
    frame = scores.withColumns({c: F.col("_scores")[i] for i, c in enumerate(names)}).drop("_centred", "_scores")
    loadings = spark.createDataFrame(
        [(c, names[j], float(weights[i, j])) for j in range(n) for i, c in enumerate(columns)],
        "column_name string, component string, weight double",
    )
    return Reduced(frame, names, columns, ratios, loadings, f"(explained variance threshold: {threshold * 100}%).")


def reduce_features(df: DataFrame, columns: Sequence[str], correlation_limit: float = CORRELATION_LIMIT,
                    variance_limit: float = VARIANCE_LIMIT, explained_variance: float = EXPLAINED_VARIANCE,
                    max_components: int = MAX_COMPONENTS) -> Reduced:
    """Correlation filter, then variance filter, then PCA."""
    kept = drop_correlated(df, columns, correlation_limit)
    kept = drop_low_variance(df, kept, variance_limit)
    return project(df, kept, explained_variance, max_components)


def plane_view(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two scores (pc1, pc2) of the z-scored columns, in the same row as everything else."""
    scaled = scale(df, columns, "_z_")
    names = [f"_z_{c}" for c in columns]
    return project(scaled, names, prefix="pc", count=min(2, len(names))).frame.drop(*names)
