"""Column profile and the rules that read roles (id, text, target) from it.

Two aggregations per table, whatever its width: one row of plain statistics, and one count per
(column, value) that gives distinct counts and top shares together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.text import word_count
from tabulon.operators.rows import is_numeric

# Names of a target column, sentiment labels, and marks of an address or a tag.
TARGET_NAMES = ["target", "label", "class", "output", "result", "y"]
SENTIMENTS = ["Positive", "Neutral", "Negative", "Extremely Positive", "Extremely Negative"]
ADDRESS_MARKS = "http|www|#|@"

ID_SHARE = 0.8
LOW_CARDINALITY_SHARE = 0.05
FEW_VALUES = 10
TOP_SHARE = 0.5
LONG_TEXT = 100
TEXT_WORDS = 2
TEXT_COLUMN_SHARE = 0.6
MAX_CLASSES = 20
#: Relative error of a sketch, how many of them are taken as safe, and up to how many values a column is counted anyway.
SKETCH_ERROR = 0.01
SAFE_ERRORS = 6
COUNTED_VALUES = 60
#: Bits of a value's hash, and how many of them tell its bucket.
HASH_BITS = 52
BUCKET_BITS = 12


def column_kind(field: T.StructField) -> str:
    if is_numeric(field):
        return "numeric"
    return "boolean" if isinstance(field.dataType, T.BooleanType) else "string"


def numeric_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, mean, min, max) of numeric columns from one aggregation."""
    return _one_row_each(df, {
        c: [F.avg(c).alias("mean"), F.min(F.col(c).cast("double")).alias("min"),
            F.max(F.col(c).cast("double")).alias("max")]
        for c in columns
    })


def _counted_value(field: T.StructField) -> Column:
    """The value as it counts: NaN is missing, and zero has one sign."""
    value = F.col(field.name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), value + F.lit(0.0).cast(field.dataType))
    return value


def value_counts(df: DataFrame, columns: Sequence[str], digests: bool = False) -> DataFrame:
    """(column_name, value, n) for all columns at once; missing values and NaN are left out, and zero has one sign.

    With `digests`, a SHA-256 digest stands for a long text, so that counting never shuffles whole documents.
    """
    def shown(c: str) -> Column:
        text = _counted_value(df.schema[c]).cast("string")
        if digests and column_kind(df.schema[c]) == "string":
            text = F.when(F.length(text) > LONG_TEXT, F.sha2(text, 256)).otherwise(text)
        return text.alias(c)

    long = df.select(*[shown(c) for c in columns]).unpivot([], list(columns), "column_name", "value")
    present = long.where(F.col("value").isNotNull())
    return present.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share); the total comes from the grouped counts, not from a second scan."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("value", "n", (F.col("n") / total).alias("share"))


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """(column_name, n_distinct, top_count). The approximate form needs no shuffle of values and has no top count."""
    if approximate:
        return _one_row_each(df, {
            c: [F.approx_count_distinct(c).alias("n_distinct"), F.lit(None).cast("long").alias("top_count")]
            for c in columns
        })
    return value_counts(df, columns, digests=True).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_distinct"), F.max("n").alias("top_count")
    )


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column with everything the role rules need."""
    stats = _one_row_each(df, {f.name: _column_statistics(pos, f) for pos, f in enumerate(df.schema)})
    counts = distinct_counts(df, df.columns, approximate)
    return _with_roles(stats.join(counts, "column_name", "left").na.fill({"n_distinct": 0}))


def _column_statistics(position: int, field: T.StructField) -> list[Column]:
    kind = column_kind(field)
    return [F.lit(position).alias("position"), F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n_rows"),
            F.count(field.name).alias("n_present"), *_text_statistics(field.name, kind)]


def role_profile(df: DataFrame) -> DataFrame:
    """The columns of `column_profile`, and `counted`, with the same roles, without a shuffle of all values.

    The hashes of all columns stand below each other, so that a sketch is one aggregation by column, however many there are:
    the counts by the leading bits, and a HyperLogLog for columns in which these take many values. A value in more than half of
    the rows lies in the bucket with the most of them; the hashes in that bucket are counted, which decides the rule on the most
    frequent value. Only columns whose estimate is so near to the border of a rule that the sketch could mislead, or which have
    few values, are counted exactly (`counted`); of the others, `n_distinct` is the estimate, and `top_count` the largest count
    in the bucket."""
    if not df.columns:
        return column_profile(df)
    sketched = _one_row_each(df, {f.name: _column_statistics(pos, f) for pos, f in enumerate(df.schema)}).collect()
    hashes = _value_hashes(df)
    buckets = hashes.groupBy("column_name", _bucket(F.col("hash")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    fullest = buckets.groupBy("column_name").agg(F.max_by("bucket", F.struct("n", "bucket")).alias("bucket"), F.count(F.lit(1)).alias("used"))
    # One row a column from here on.
    likely, distinct = {}, {}
    for r in fullest.collect():
        likely[r.column_name], distinct[r.column_name] = r.bucket, r.used
    wide = [c for c in df.columns if distinct.get(c, 0) > COUNTED_VALUES]
    if wide:
        estimates = _value_hashes(df.select(*wide)).groupBy("column_name").agg(F.approx_count_distinct("hash", SKETCH_ERROR).alias("n"))
        distinct |= {r.column_name: r.n for r in estimates.collect()}
    counted = _value_hashes(df, likely).groupBy("column_name", "hash").agg(F.count(F.lit(1)).alias("n"))
    top = {r.column_name: r.n for r in counted.groupBy("column_name").agg(F.max("n").alias("n")).collect()}

    def near(r) -> bool:
        margin = SAFE_ERRORS * SKETCH_ERROR
        borders = (r.n_rows * ID_SHARE, r.n_rows * LOW_CARDINALITY_SHARE)
        n = distinct.get(r.column_name, 0)
        return n <= COUNTED_VALUES or any(b * (1 - margin) <= n <= b * (1 + margin) + 1 for b in borders)

    border = [r.column_name for r in sketched if near(r)]
    exact = {r.column_name: (r.n_distinct, r.top_count) for r in distinct_counts(df, border).collect()} if border else {}
    spark = df.sparkSession
    shape = "column_name string, n_distinct long, top_count long, counted boolean"
    counts = spark.createDataFrame([
        (r.column_name, *exact.get(r.column_name, (0, None)), True) if r.column_name in border
        else (r.column_name, distinct[r.column_name], top[r.column_name], False) for r in sketched], shape)
    kinds = ("column_name string, position int, kind string, n_rows long, n_present long, mean_length double, has_address_mark boolean, "
             "has_sentiment boolean, mean_words double")
    stats = spark.createDataFrame([tuple(r) for r in sketched], kinds)
    return _with_roles(stats.join(F.broadcast(counts), "column_name"))


def _bucket(hashed: Column) -> Column:
    return F.shiftright(hashed, HASH_BITS - BUCKET_BITS)


def _value_hashes(df: DataFrame, buckets: dict[str, int] | None = None) -> DataFrame:
    """(column_name, hash) of all present values; with `buckets`, of those in the column's bucket."""
    def shown(field: T.StructField) -> Column:
        value = _counted_value(field)
        hashed = F.shiftrightunsigned(F.xxhash64(value.cast("string")), 64 - HASH_BITS)
        wanted = value.isNotNull()
        if buckets is not None:
            wanted &= _bucket(hashed) == F.lit(buckets.get(field.name))
        return F.when(wanted, hashed).alias(field.name)

    return df.select(*[shown(f) for f in df.schema]).unpivot([], df.columns, "column_name", "hash").where(F.col("hash").isNotNull())


def _with_roles(joined: DataFrame) -> DataFrame:
    enough = F.col("n_distinct") > F.col("n_rows") * ID_SHARE
    return joined.withColumns({
        "top_share": F.col("top_count") / F.col("n_present"),
        "is_text": F.col("mean_words") > TEXT_WORDS,
        "is_low_cardinality": F.col("n_distinct") < F.col("n_rows") * LOW_CARDINALITY_SHARE,
        "is_id": F.when(F.col("kind") == "numeric", enough)
        .when(F.col("kind") == "string",
              enough & (F.coalesce(F.col("mean_length"), F.lit(0.0)) <= LONG_TEXT) & ~F.col("has_address_mark"))
        .otherwise(F.lit(False)),
    })


def id_columns(profile: DataFrame) -> DataFrame:
    return profile.where("is_id").select("position", "column_name")


def text_columns(profile: DataFrame, target: str | None = None) -> DataFrame:
    return profile.where("is_text").where(F.col("column_name") != (target or "")).select("position", "column_name")


def text_dataset(profile: DataFrame, target: str | None = None) -> DataFrame:
    """One row: is the table mainly text, and which columns are text."""
    rest = profile.where(F.col("column_name") != (target or ""))
    found = F.count_if("is_text")
    return rest.agg(
        ((found > 0) & (found / F.count(F.lit(1)) > TEXT_COLUMN_SHARE)).alias("is_text_data"),
        _names(F.col("is_text")).alias("text_columns"),
    )


def target_candidates(profile: DataFrame) -> DataFrame:
    """One row (rule, candidates): the first rule that finds anything, with all columns it finds."""
    few = (F.col("kind") == "string") | (F.col("n_distinct") < FEW_VALUES)
    low = _names(F.col("is_low_cardinality"))
    text = _names(F.col("is_text"))
    found = profile.agg(
        F.slice(_names(F.lower("column_name").isin(TARGET_NAMES)), 1, 1).alias("name"),
        _names(F.col("kind") != "numeric").alias("categorical"),
        F.when(F.size(low) == 1, low).otherwise(F.array().cast("array<string>")).alias("low_cardinality"),
        F.slice(_names(few & (F.col("top_share") > TOP_SHARE)), 1, 1).alias("imbalanced"),
        F.slice(_names(F.col("has_sentiment")), 1, 1).alias("sentiment"),
        F.when(F.size(text) == 1, text).otherwise(F.array().cast("array<string>")).alias("text"),
    )
    rule = F.lit("none")
    names = F.array().cast("array<string>")
    for c in reversed(found.columns):
        rule = F.when(F.size(c) > 0, F.lit(c)).otherwise(rule)
        names = F.when(F.size(c) > 0, F.col(c)).otherwise(names)
    return found.select(rule.alias("rule"), names.alias("candidates"))


def detect_target(profile: DataFrame) -> str | None:
    """The target column; an error that names the candidates where a rule finds more than one."""
    row = target_candidates(profile).head()
    if len(row["candidates"]) > 1:
        raise ValueError(f"rule {row['rule']!r} finds more than one target column: {row['candidates']}")
    return row["candidates"][0] if row["candidates"] else None


def target_kind(df: DataFrame, targets: Sequence[str]) -> str:
    return "numerical" if all(is_numeric(df.schema[c]) for c in targets) else "categorical"


def is_continuous(df: DataFrame, target: str) -> DataFrame:
    """One row: more than one distinct value in a numeric column. Two bounds say it without a distinct count."""
    numeric = F.lit(is_numeric(df.schema[target]))
    return df.agg((numeric & (F.min(target) < F.max(target))).alias("is_continuous"))


def choose_mode(df: DataFrame, target: str, max_classes: int = MAX_CLASSES) -> str:
    """Regression for a numeric target with more than `max_classes` values, else classification."""
    if not is_numeric(df.schema[target]):
        return "classification"
    some = df.select(target).where(F.col(target).isNotNull()).distinct().limit(max_classes + 1).count()
    return "regression" if some > max_classes else "classification"


def _names(condition: Column) -> Column:
    """Names of the profile rows that meet the condition, by position."""
    kept = F.collect_list(F.when(condition, F.struct("position", "column_name")))
    return F.transform(F.array_sort(kept), lambda x: x["column_name"])


def _text_statistics(c: str, kind: str) -> list[Column]:
    if kind != "string":
        return [F.lit(None).cast("double").alias("mean_length"), F.lit(False).alias("has_address_mark"),
                F.lit(False).alias("has_sentiment"), F.avg((F.col(c).isNotNull()).cast("double")).alias("mean_words")]
    text = F.col(c).cast("string")
    return [
        F.avg(F.length(text)).alias("mean_length"),
        F.coalesce(F.bool_or(text.rlike(ADDRESS_MARKS)), F.lit(False)).alias("has_address_mark"),
        F.coalesce(F.bool_or(text.isin(SENTIMENTS)), F.lit(False)).alias("has_sentiment"),
        F.avg(word_count(F.coalesce(text, F.lit("")))).alias("mean_words"),
    ]


def _one_row_each(df: DataFrame, statistics: dict[str, list[Column]]) -> DataFrame:
    """Run all statistics of all columns in one aggregation and turn the single row into one row per column."""
    wide = df.agg(*[
        F.struct(F.lit(c).alias("column_name"), *columns).alias(f"s{i}")
        for i, (c, columns) in enumerate(statistics.items())
    ])
    return wide.select(F.inline(F.array(*wide.columns)))
