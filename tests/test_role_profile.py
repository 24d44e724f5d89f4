"""Roles from sketches against roles from exact counts."""

import random

import pytest
from pyspark.sql import functions as F

from tabulon.operators import profile as P

ROLES = ["column_name", "position", "kind", "is_id", "is_text", "is_low_cardinality", "has_sentiment"]


def roles(found):
    return sorted((*[r[c] for c in ROLES], (r.top_share or 0) > P.TOP_SHARE) for r in found.collect())


def same(df):
    exact, sketched = P.column_profile(df).persist(), P.role_profile(df).persist()
    assert roles(sketched) == roles(exact)
    assert P.target_candidates(sketched).collect() == P.target_candidates(exact).collect()
    assert P.text_dataset(sketched).collect() == P.text_dataset(exact).collect()
    counts = {r.column_name: r.n_distinct for r in exact.collect()}
    for r in sketched.collect():
        assert r.n_distinct == counts[r.column_name] if r.counted else abs(r.n_distinct - counts[r.column_name]) <= 0.06 * counts[r.column_name]
    return {r.column_name: r.counted for r in sketched.collect()}


def test_borders_of_the_rules(spark):
    n = 6000
    draw = random.Random(5)
    share = lambda s: [0 if draw.random() < s else i + 1 for i in range(n)]
    columns = {
        "id80": [i % 4800 for i in range(n)], "id81": [i % 4801 for i in range(n)], "unique": list(range(n)), "half": [i % 3000 for i in range(n)],
        "low5": [i % 300 for i in range(n)], "low4": [i % 299 for i in range(n)], "nine": [i % 9 for i in range(n)], "ten": [i % 10 for i in range(n)],
        "most": [i if i < n // 2 - 1 else -1 for i in range(n)], "even": [i if i < n // 2 else -1 for i in range(n)], "some": share(0.4), "many": share(0.9)}
    rows = list(zip(*columns.values()))
    numbers = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in columns))
    counted = same(numbers)
    assert counted["id80"] and counted["id81"] and counted["low4"] and not counted["unique"] and not counted["half"]
    same(numbers.select(*[F.concat(F.lit("v"), c).alias(c) for c in columns]))
    same(numbers.select(*[F.when(F.col("id80") % 3 != 0, F.col(c)).alias(c) for c in columns]))


@pytest.mark.parametrize("rows", [0, 1, 40])
def test_small_and_odd_tables(spark, rows):
    schema = "a double, b string, c boolean, d string, e int"
    data = [(float("nan") if i % 3 == 0 else -0.0 if i % 3 == 1 else 0.0, None, i % 2 == 0, "Positive" if i % 4 else "http://x.y a b c", None if i % 5 else i) for i in range(rows)]
    assert all(same(spark.createDataFrame(data, schema)).values())
