"""Row filters, projections and previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROMPT_IGNORE = ("ID", "Timestamp")
SCORING_IGNORE = ("ID", "Timestamp", "target", "label")


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not is_numeric(f)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """One missing value: NaN becomes null, because Spark sorts NaN above every number."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def drop_all_null_rows(df: DataFrame) -> DataFrame:
    """NaN counts as missing here, so this runs before `nan_to_null` and its filter stays on plain columns."""
    return df.na.drop(how="all")


def drop_any_null_rows(df: DataFrame, enabled: bool = False) -> DataFrame:
    """Off by default: the described analysis keeps rows with missing values and imputes them."""
    return df.na.drop(how="any") if enabled else df


def features_and_target(df: DataFrame, target: str) -> tuple[list[str], str]:
    if target not in df.columns:
        raise ValueError(f"no target column {target!r}")
    return [c for c in df.columns if c != target], target


def without_columns(df: DataFrame, ignore: Sequence[str] = PROMPT_IGNORE) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in ignore])


def of_class(df: DataFrame, label: str, value) -> DataFrame:
    return df.where(F.col(label) == F.lit(value))


def split_side(value: Column, threshold) -> Column:
    """Training side of a threshold: left at or below, right above, neither for a missing value."""
    return (
        F.when(value.isNull() | F.isnan(value.cast("double")), F.lit(None).cast("string"))
        .when(value <= threshold, F.lit("left"))
        .otherwise(F.lit("right"))
    )


def walk_side(value: Column, threshold) -> Column:
    """Prediction side of a threshold: whatever is not at or below it goes right."""
    return F.when((value <= threshold) & ~F.isnan(value.cast("double")), F.lit("left")).otherwise(F.lit("right"))


def preview(df: DataFrame, key: Sequence[str] | str, n: int = 5) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*keys).limit(n)
