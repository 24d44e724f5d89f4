import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import clean as C
from tabulon.operators import ordered as O
from tabulon.operators import reduce as R


def test_clean_people(spark):
    people = spark.createDataFrame(
        [("Male", 1.0, 10), ("FEMALE", None, None), ("woman", 3.0, 20), ("boy", float("nan"), 30), ("x", 2.0, 40), (None, 2.0, 0), (None, None, None)],
        "gender string, age double, income long")
    found, codes = C.clean_table(people)
    assert {r["label"]: r["code"] for r in codes.collect()} == {"female": 0, "male": 1, "unknown": 2}
    rows = found.orderBy("income").collect()
    assert len(rows) == 6
    assert sorted(r["gender"] for r in rows) == [0, 0, 1, 1, 2, 2]
    assert all(r["age"] is not None for r in rows)
    assert [r["income"] for r in rows] == [0.0, 10.0, 20.0, 20.0, 30.0, 40.0]


def test_gender_column_choice():
    assert C.gender_column(["a", "gender", "sex"]) == "sex"
    assert C.gender_column(["a", "gender"]) == "gender"
    assert C.gender_column(["a"]) is None


def test_target_mapping(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c")], "k long, y string")
    mapped, codes = C.map_target(df, "y")
    assert [r["y"] for r in mapped.orderBy("k").collect()] == [1, 0, 2]
    assert [r["y"] for r in C.decode(mapped, "y", codes).orderBy("k").collect()] == ["b", "a", "c"]
    same, none = C.map_target(df.select("k"), "k")
    assert none is None and same.columns == ["k"]
    with pytest.raises(ValueError):
        C.map_target(df, ["k", "y"])


def test_correlated_frame(spark):
    rng = np.random.default_rng(3)
    a, e = rng.normal(size=200), rng.normal(size=200)
    rows = [(float(x), float(2 * x), float(-x), 7.0, float(y)) for x, y in zip(a, e)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    assert R.drop_correlated(df, df.columns) == ["a", "c", "d", "e"]
    assert R.drop_low_variance(df, ["a", "d", "e"]) == ["a", "e"]
    with pytest.raises(ValueError):
        R.drop_low_variance(df, ["d"])
    found = {(r["col_i"], r["col_j"]): r["r"] for r in R.correlation_pairs(df, df.columns).collect()}
    assert len(found) == 10
    assert all(found[p] is None for p in found if "d" in p)
    assert abs(found["a", "b"] - 1) < 1e-12 and abs(found["a", "c"] + 1) < 1e-12
    assert abs(found["a", "e"] - np.corrcoef(a, e)[0, 1]) < 1e-12


def test_correlation_takes_rows_with_both_values(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 45)) + 1e6
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 40] = np.where(rng.random(150) < 0.5, -0.0, 0.0)
    x[:, 41] = np.nan
    x[:, 42] = np.where(np.isnan(x[:, 0]), x[:, 42], 0.1)
    names = [f"x{i}" for i in range(45)]
    rows = [tuple(None if np.isnan(v) and (i + j) % 2 else float(v) for j, v in enumerate(row)) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(4)
    found = {(r["pos_i"], r["pos_j"]): r["r"] for r in R.correlation_pairs(df, names).collect()}
    assert len(found) == 45 * 44 // 2
    for (i, j), value in found.items():
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        a, b = x[both, i], x[both, j]
        if len(a) and a.min() < a.max() and b.min() < b.max():
            assert abs(value - np.corrcoef(a, b)[0, 1]) < 1e-8
        else:
            assert value is None
    empty = R.correlation_pairs(df.where("false"), names[:3]).collect()
    assert len(empty) == 3 and all(r["r"] is None for r in empty)


def test_component_count():
    assert R.component_count([1.0]) == 1
    assert R.component_count([0.99, 0.01]) == 2
    assert R.component_count([0.5, 0.3, 0.1, 0.06, 0.04]) == 4
    assert R.component_count([1 / 20] * 20) == 10


def test_projection_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 4)) @ rng.normal(size=(4, 4)) + 3
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id long, a double, b double, c double, d double")
    found = R.project(df, ["a", "b", "c", "d"])
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    ratios = s ** 2 / (s ** 2).sum()
    assert np.allclose(found.ratios, ratios)
    n = len(found.components)
    assert n == R.component_count(list(ratios))
    got = np.array([[r[c] for c in found.components] for r in found.frame.orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs((x - x.mean(axis=0)) @ vt[:n].T))


def test_single_feature_passes_through(spark):
    found = R.project(spark.range(5).select(F.col("id").cast("double").alias("a")), ["a"])
    assert found.components == ["PC1"] and found.ratios == [1.0]


@pytest.mark.parametrize("buckets", [1, 3, 64])
def test_running_totals_with_a_hot_group(spark, buckets):
    rows = [("hot" if i % 3 else f"g{i}", (i * 7919) % 1000, i, i % 5) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, o long, id long, v long")
    found = O.with_running_totals(df, ["g"], ["o", "id"], {"before": F.col("v"), "place": F.lit(1).cast("long")}, buckets)
    got = {r["id"]: (r["before"], r["place"]) for r in found.collect()}
    for g in {r[0] for r in rows}:
        total = place = 0
        for row in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            assert got[row[2]] == (total, place)
            total, place = total + row[3], place + 1
