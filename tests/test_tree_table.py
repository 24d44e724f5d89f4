"""The table of a fitted tree's nodes, walked here, by MLlib and by DuckDB."""

import duckdb
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabulon.operators import tree_table as TT
from tabulon.operators import trees as T

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(900).select(
        "id", *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(97)) / 10).alias(c) for i, c in enumerate(FEATURES)])
    label = (F.col("a") > 4).cast("int") + (F.col("b") + F.col("c") > 9).cast("int") + (F.pmod(F.xxhash64("id"), F.lit(9)) == 0).cast("int")
    df = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df.withColumn("label", F.least(label, F.lit(2)).cast("double")))
    return df.persist()


def walk_in_duckdb(tmp_path, nodes, rows):
    nodes.select("tree", "node", "feature", "threshold", "left", "right").write.parquet(f"{tmp_path}/nodes")
    rows.select("id", F.array(*FEATURES).alias("v")).write.parquet(f"{tmp_path}/rows")
    found = duckdb.sql(f"""
        WITH RECURSIVE n AS (SELECT * FROM '{tmp_path}/nodes/*.parquet'),
        step AS (SELECT id, v, tree, 0 AS node FROM '{tmp_path}/rows/*.parquet', (SELECT DISTINCT tree FROM n)
            UNION ALL SELECT id, v, tree, CASE WHEN v[feature + 1] <= threshold THEN "left" ELSE "right" END FROM step JOIN n USING (tree, node) WHERE "left" >= 0)
        SELECT id, list(node ORDER BY tree) FROM step JOIN n USING (tree, node) WHERE "left" < 0 GROUP BY id""").fetchall()
    return {i: leaves for i, leaves in found}


@pytest.mark.parametrize("kind", ["tree", "forest"])
def test_walks_agree(spark, rows, tmp_path, kind):
    model = (T.decision_tree(max_depth=6) if kind == "tree" else T.random_forest(trees=7, max_depth=5)).fit(rows)
    nodes = TT.node_table(model, spark).persist()
    got = TT.with_leaves(TT.with_votes(model.transform(rows), nodes), nodes).collect()
    assert len(got) == 900 and all(r.walked == r.prediction for r in got)
    assert all(max(abs(x - y) for x, y in zip(r.walked_shares, r.probability.toArray())) < 1e-12 for r in got)
    assert {r.id: r.leaves for r in got} == walk_in_duckdb(tmp_path, nodes, rows)
    table = {(r.tree, r.node): r for r in nodes.collect()}
    for r in table.values():
        if r.parent is not None:
            up = table[r.tree, r.parent]
            assert r.path == up.path + r.side and r.depth == up.depth + 1 and r.node in (up.left, up.right)
        assert (r.left < 0) == (r.feature is None) == (r.gain is None)


def test_values_of_a_regression(spark, rows):
    numbers = rows.withColumn("label", F.col("a") * 2 + F.col("b"))
    for model in (T.decision_tree("regression", 4).fit(numbers), T.random_forest("regression", 5, 4).fit(numbers)):
        got = TT.with_votes(model.transform(numbers), TT.node_table(model, spark), mode="regression").collect()
        assert all(abs(r.walked - r.prediction) < 1e-9 for r in got)


def test_arrays_missing_values_and_a_lone_leaf(spark, rows):
    model = T.decision_tree(max_depth=3).fit(rows)
    nodes = TT.node_table(model, spark)
    odd = spark.createDataFrame([(1, [float("nan"), 5.0, 5.0]), (2, [0.0, 0.0, 0.0])], "id int, x array<double>")
    assert [len(r.leaves) for r in TT.with_leaves(odd, nodes, "x").collect()] == [1, 1]
    one = TT.node_table(T.decision_tree().fit(rows.withColumn("label", F.lit(1.0))), spark)
    assert one.count() == 1 and {r.walked for r in TT.with_votes(odd, one, "x").collect()} == {1.0}
    assert [(r.depth, r.rule) for r in TT.rules(one).collect()] == [(0, "Predict: 1.0")]
    with pytest.raises(ValueError):
        TT.with_leaves(odd.withColumn("_trees", F.lit(1)), nodes, "x")


def test_categories(spark):
    from pyspark.ml.feature import VectorIndexer
    df = spark.range(600).select("id", F.pmod(F.xxhash64("id"), F.lit(6)).cast("double").alias("k"))
    df = df.withColumn("label", F.col("k").isin(0.0, 3.0, 4.0).cast("double"))
    df = VectorAssembler(inputCols=["k"], outputCol="raw").transform(df)
    df = VectorIndexer(inputCol="raw", outputCol="features", maxCategories=10).fit(df).transform(df)
    model = T.decision_tree(max_depth=3).fit(df)
    nodes = TT.node_table(model, spark)
    assert nodes.where("categories is not null").count() > 0
    assert all(r.walked == r.prediction for r in TT.with_votes(model.transform(df), nodes).collect())
    assert any(" in {" in r.rule for r in TT.rules(nodes).collect())


def test_rules_are_those_of_the_model(spark, rows):
    model = T.decision_tree(max_depth=4).fit(rows)
    lines = [line for line in model.toDebugString.splitlines()[1:] if line.strip()]
    want = [(len(line) - len(line.lstrip()) - 2, line.strip()) for line in lines]
    got = [(r.depth, r.rule) for r in TT.rules(TT.node_table(model, spark)).orderBy("node").collect()]
    assert got == want
