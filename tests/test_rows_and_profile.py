import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabulon.operators import profile as P
from tabulon.operators import rows as R


def test_nan_and_null_rows(spark):
    df = spark.createDataFrame([(None, None), (1.0, None), (float("nan"), None), (2.0, "x")], "a double, b string")
    kept = R.nan_to_null(R.drop_all_null_rows(df)).collect()
    assert [tuple(r) for r in kept] == [(1.0, None), (2.0, "x")]
    assert R.drop_any_null_rows(df).count() == 4
    assert R.drop_any_null_rows(df, True).count() == 1


def test_column_kinds(spark):
    df = spark.createDataFrame([("1", True, dt.datetime(2024, 1, 1), 2)], "a string, b boolean, c timestamp, d long")
    assert R.numeric_columns(df) == ["d"]
    assert R.categorical_columns(df) == ["a", "b", "c"]
    assert P.target_kind(df, ["d"]) == "numerical"
    assert P.target_kind(df, ["b"]) == "categorical"


def test_threshold_sides_of_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,)], "x double")
    got = df.select(R.split_side(F.col("x"), 1.5).alias("t"), R.walk_side(F.col("x"), 1.5).alias("w")).collect()
    assert [tuple(r) for r in got] == [("left", "left"), ("right", "right"), (None, "right"), (None, "right")]


def test_id_rules(spark):
    long = "word " * 30
    df = spark.createDataFrame(
        [(i, f"c{i}", f"http://x/{i}", long + str(i), "ab"[i % 2], dt.datetime(2024, 1, 1 + i)) for i in range(20)],
        "cust_id long, code string, site string, bio string, grp string, at timestamp")
    ids = [r["column_name"] for r in P.id_columns(P.column_profile(df)).orderBy("position").collect()]
    assert ids == ["cust_id", "code", "at"]


def target(spark, rows, schema):
    row = P.target_candidates(P.column_profile(spark.createDataFrame(rows, schema))).head()
    return row["rule"], row["candidates"]


def test_target_rules_in_order(spark):
    assert target(spark, [(1, "a", 0)], "Class long, s string, y long") == ("name", ["Class"])
    assert target(spark, [(1, "a", "b")], "n long, s string, t string") == ("categorical", ["s", "t"])
    rows = [(i, i % 2, i / 3) for i in range(100)]
    assert target(spark, rows, "a long, b long, c double") == ("low_cardinality", ["b"])
    rows = [(i, 0 if i < 8 else i, 0 if i < 7 else 1) for i in range(10)]
    assert target(spark, rows, "a long, b long, c long") == ("imbalanced", ["b"])
    rows = [(i, i + 1) for i in range(12)]
    assert target(spark, rows, "a long, b long") == ("none", [])


def test_two_candidates_are_an_error_that_names_them(spark):
    df = spark.createDataFrame([("a", "b")], "s string, t string")
    with pytest.raises(ValueError, match="'s', 't'"):
        P.detect_target(P.column_profile(df))


def test_text_columns_and_mode(spark):
    df = spark.createDataFrame([("one two three", "x", None), ("four five six seven", "y", 1.0)], "t string, u string, v double")
    profile = P.column_profile(df)
    assert P.text_dataset(profile, "u").head()["text_columns"] == ["t"]
    assert P.text_dataset(profile, "u").head()["is_text_data"] is False
    many = spark.range(50)
    assert P.choose_mode(many, "id") == "regression"
    assert P.choose_mode(many.select((F.col("id") % 2).alias("id")), "id") == "classification"


def test_approximate_profile_runs_without_value_counts(spark):
    found = P.column_profile(spark.range(100), approximate=True).head()
    assert abs(found["n_distinct"] - 100) <= 10 and found["top_count"] is None


def test_floats_count_once(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (1.0,), (None,)], "x double")
    assert [(r["n_distinct"], r["top_count"]) for r in P.distinct_counts(df, ["x"]).collect()] == [(2, 2)]
