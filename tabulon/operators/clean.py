"""Cleaning and encoding: coercion, mean imputation, gender values, label codes, z-scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators.ordered import with_position
from tabulon.operators.rows import drop_all_null_rows, is_numeric, nan_to_null, numeric_columns

# Accepted spellings of the two genders.
FEMALE = ["female", "woman", "girl"]
MALE = ["male", "man", "boy"]
GENDER_COLUMNS = ["sex", "gender"]


def to_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cast to double where the text is a number, null where it is not."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def _value(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def column_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(_value(c)).alias(c) for c in columns])


def impute_mean(df: DataFrame, columns: Sequence[str] | None = None, prefix: str = "") -> DataFrame:
    """Null and NaN become the column mean, in place or under a prefixed name. One aggregation gives all means;
    the rows are then only projected."""
    columns = list(numeric_columns(df) if columns is None else columns)
    if not columns:
        return df
    means = column_means(df, columns).head()
    return df.withColumns({prefix + c: F.coalesce(_value(c), F.lit(means[c]).cast("double")) for c in columns})


def scale(df: DataFrame, columns: Sequence[str] | None = None, prefix: str = "") -> DataFrame:
    """(x - mean) / population deviation; a constant column is only centred."""
    columns = list(numeric_columns(df) if columns is None else columns)
    if not columns:
        return df
    stats = df.agg(*[
        F.struct(F.avg(c).alias("mean"), F.when(F.min(c) < F.max(c), F.stddev_pop(c)).alias("std")).alias(c) for c in columns
    ]).head()
    return df.withColumns({
        prefix + c: (F.col(c) - F.lit(stats[c]["mean"])) / F.lit(stats[c]["std"] or 1.0) for c in columns
    })


def standardise_gender(value: Column) -> Column:
    value = F.lower(value.cast("string"))
    return F.when(value.isin(FEMALE), "female").when(value.isin(MALE), "male").otherwise("unknown")


def gender_column(columns: Sequence[str]) -> str | None:
    return next((c for c in GENDER_COLUMNS if c in columns), None)


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(label, code): codes 0, 1, … in the order of the labels."""
    labels = df.where(F.col(column).isNotNull()).select(F.col(column).alias("label")).distinct()
    return with_position(labels, [], ["label"], "code")


def label_codes_by_frequency(df: DataFrame, column: str) -> DataFrame:
    """(label, code): the most frequent label gets 0, equal counts go by label."""
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("label"))
        .agg((-F.count(F.lit(1))).alias("rank_key"))
    )
    return with_position(counts, [], ["rank_key", "label"], "code").select("label", "code")


def encode(df: DataFrame, column: str, codes: DataFrame, out: str | None = None) -> DataFrame:
    """Replace labels by codes. The optimiser broadcasts the mapping while it is small."""
    keyed = codes.select(F.col("label").alias("_label"), F.col("code").alias("_code"))
    joined = df.join(keyed, F.col(column) == F.col("_label"), "left")
    return joined.withColumn(out or column, F.col("_code")).drop("_label", "_code")


def decode(df: DataFrame, column: str, codes: DataFrame, out: str | None = None) -> DataFrame:
    """The inverse of `encode`."""
    keyed = codes.select(F.col("label").alias("_label"), F.col("code").alias("_code"))
    joined = df.join(keyed, F.col(column) == F.col("_code"), "left")
    return joined.withColumn(out or column, F.col("_label")).drop("_label", "_code")


def map_target(df: DataFrame, targets: Sequence[str] | str) -> tuple[DataFrame, DataFrame | None]:
    """Codes for a text target; a numeric target passes unchanged and has no mapping."""
    targets = [targets] if isinstance(targets, str) else list(targets)
    if len(targets) != 1:
        raise ValueError(f"the target must be one column, not {targets}")
    target = targets[0]
    if is_numeric(df.schema[target]):
        return df, None
    codes = label_codes(df, target)
    return encode(df, target, codes), codes


def encode_gender(df: DataFrame, out: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Standardise and encode `sex`, else `gender`; the mapping (label, code) goes into the report."""
    column = gender_column(df.columns)
    if column is None:
        return df, None
    df = df.withColumn(out or column, standardise_gender(F.col(column)))
    codes = label_codes(df, out or column)
    return encode(df, out or column, codes), codes


def clean_table(df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """All-null rows out, numbers imputed with the mean, gender encoded; other text is left alone."""
    df = nan_to_null(drop_all_null_rows(df))
    return encode_gender(impute_mean(df))


def clean_features(df: DataFrame, prefix: str) -> tuple[DataFrame, list[str], DataFrame | None]:
    """Like `clean_table`, but next to the input columns: the cleaned numbers get prefixed names.

    Rows so carry their input along and labels never have to be matched by position. Input columns keep
    their plain names; a renamed copy of each would make the optimiser rewrite the all-null filter once
    per combination of copies.
    """
    df = drop_all_null_rows(df)
    gender = gender_column(df.columns)
    numbers = [c for c in numeric_columns(df) if c != gender]
    df, codes = encode_gender(impute_mean(df, numbers, prefix), prefix + gender if gender else None)
    order = [c for c in df.columns if c in numbers or c == gender]
    return df, [prefix + c for c in order], codes
