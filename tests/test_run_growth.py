"""What the classification and regression runs move and repeat as tables grow."""

import time

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabulon.functions.text import SPACES, word_count
from tabulon.operators import profile as P
from tabulon.operators import trees as T
from tabulon.operators import tuning
from tabulon.operators.text_features import text_feature_stages


@pytest.fixture
def flowers_like(spark):
    rows = [(float(i % 50), float(i * 7919 % 31), float((i % 50 > 20) + (i * 7919 % 31 > 15))) for i in range(600)]
    df = spark.createDataFrame(rows, "x double, y double, label double")
    return VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(df).select("features", "label")


def test_words_are_counted_without_a_pattern(spark):
    texts = ["", " ", "a", " a  b\tc\n", "\u00e4\u3000\u00f6 x", "".join(f"{s}w" for s in SPACES), "\x01 \x02", None, "a\u200bb", "\x1c\x1d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(word_count("t")).collect()] == [0, 0, 1, 3, 3, len(SPACES), 2, None, 1, 0]
    long = spark.range(40, numPartitions=4).select(F.repeat(F.lit("some words here "), 50_000).alias("t"))
    begin = time.monotonic()
    assert long.agg(F.sum(word_count("t"))).head()[0] == 40 * 150_000
    assert time.monotonic() - begin < 20
    assert "regexp" not in df.select(word_count("t"))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_texts_stay_where_they_are_when_folds_are_dealt(spark):
    rows = [(f"{'good fine' if i % 2 else 'bad poor'} film number {i % 7}", "yes" if i % 2 else "no") for i in range(80)]
    df = spark.createDataFrame(rows, "review string, label string")
    stages, outputs, _ = text_feature_stages(df.withColumn("_key", F.md5("review")), ["review"], "_key", "label", 4)
    data = tuning.prepare(df, "label", [], "classification", None, stages, outputs)
    plan = data.frame._jdf.queryExecution().optimizedPlan()
    joins = [n for n in _nodes(plan) if n.nodeName() == "Join"]
    assert joins
    for join in joins:
        sides = [join.children().apply(i).output() for i in range(2)]
        assert not any(side.apply(i).name() == "review" for side in sides for i in range(side.size()))
    # Equal rows share a fold, and each label's distinct rows are dealt out evenly.
    got = data.frame.select("label", "fold", F.col("features").cast("string").alias("f")).distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(got) == 2 and data.frame.count() == 80


def _nodes(plan):
    found = [plan]
    for i in range(plan.children().size()):
        found += _nodes(plan.children().apply(i))
    return found


def test_roles_of_a_wide_table(spark):
    many, n = 120, 3000
    most = [F.when(F.col("id") % 100 < 51, F.lit(-1)).otherwise(F.col("id")).alias(f"m{i}") for i in range(2)]
    df = spark.range(n).select(*most, F.lit(None).cast("long").alias("none"), *[(F.col("id") * (i + 3)).alias(f"c{i}") for i in range(many)])
    begin = time.monotonic()
    got = {r.column_name: r for r in P.role_profile(df).collect()}
    assert time.monotonic() - begin < 60
    assert [got[f"m{i}"].top_count for i in range(2)] == [1530] * 2 and not got["m0"].counted
    assert got["none"].counted and got["none"].n_distinct == 0 and got["none"].top_count is None
    assert all(got[f"c{i}"].is_id and got[f"c{i}"].top_count == 1 for i in range(many))


def test_one_tree_is_walked(flowers_like):
    assert not T.decision_tree().getCacheNodeIds() and not T.decision_tree("regression").getCacheNodeIds()
    assert T.random_forest().getCacheNodeIds()
    kept = T.decision_tree().setCacheNodeIds(True).fit(flowers_like)
    text = lambda m: m.toDebugString.split("\n", 1)[1]
    assert text(T.decision_tree().fit(flowers_like)) == text(kept) and kept.depth > 1


def test_rows_are_held_by_a_task_a_core(spark, flowers_like):
    data = tuning.Prepared(flowers_like.repartition(64), None, "classification", ["a", "b", "c"])
    cores = spark.sparkContext.defaultParallelism
    with tuning.held(data) as held:
        assert held.frame.rdd.getNumPartitions() == cores
        stored = [i for i in spark.sparkContext._jsc.sc().getRDDStorageInfo() if i.numPartitions() == 64]
        assert stored and all(i.numCachedPartitions() == 64 for i in stored)
        assert sorted(map(str, held.frame.collect())) == sorted(map(str, flowers_like.collect()))
    assert not data.frame.storageLevel.useMemory
    narrow = tuning.Prepared(flowers_like.repartition(cores + 1), None, "classification", ["a", "b", "c"])
    with tuning.held(narrow) as held:
        assert held.frame.rdd.getNumPartitions() == cores + 1


def test_held_rows_bound_a_task(spark, flowers_like, monkeypatch):
    monkeypatch.setattr(tuning, "TASK_ROWS", 30)
    with tuning.held(tuning.Prepared(flowers_like.repartition(64), None, "classification", ["a", "b", "c"])) as held:
        assert held.frame.rdd.getNumPartitions() == 600 // 30
