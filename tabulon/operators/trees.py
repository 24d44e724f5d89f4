"""Impurities, best split, and the tree and forest estimators."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.operators.ordered import with_position
from tabulon.operators.tree_table import node_table, rules
from tabulon.session import cut_lineage

MANY_VALUES = 50
QUANTILES = [0.1 + 0.8 * i / 9 for i in range(10)]
MIN_GAIN = 0.01
LEAF_ROWS = 10
MAX_DEPTH = 30
FOREST_DEPTH = 25
DEFAULT_TREES = 100
SEED = 42


def class_shares(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by…, label, n, p) from grouped counts."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    if by:
        totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
        return counts.join(totals, list(by)).select(*by, label, "n", (F.col("n") / F.col("total")).alias("p"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(label, "n", (F.col("n") / total).alias("p"))


def entropy_term(p: Column) -> Column:
    return -p * F.log2(p + F.lit(1e-9))


def impurities(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by…, entropy, gini) of the class shares."""
    p = F.col("p")
    return class_shares(df, label, by).groupBy(*by).agg(
        F.sum(entropy_term(p)).alias("entropy"), (1 - F.sum(p * p)).alias("gini"))


def _value_counts(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(feature, x, label, n): the one shuffle over the rows; everything after it works on these counts."""
    long = df.select(F.col(label).alias("label"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ["label"], list(columns), "feature", "x")
    return long.groupBy("feature", "x", "label").agg(F.count(F.lit(1)).alias("n"))


def split_thresholds(values: DataFrame) -> DataFrame:
    """(feature, place, threshold): all distinct values if they are at most 50, else ten quantiles of them.

    A quantile needs the two values at its neighbouring ranks; ranks come from an exact distributed numbering.
    """
    distinct = values.where(F.col("x").isNotNull() & ~F.isnan("x")).select("feature", "x").distinct()
    ranked = with_position(distinct, ["feature"], ["x"], "rank")
    sizes = distinct.groupBy("feature").agg(F.count(F.lit(1)).alias("size"))
    few = F.col("size") <= MANY_VALUES
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("size") - 1),
                        lambda r: F.struct(r.cast("int").alias("place"), r.cast("double").alias("at")))
    some = F.array(*[
        F.struct(F.lit(i).alias("place"), (F.lit(q) * (F.col("size") - 1)).alias("at")) for i, q in enumerate(QUANTILES)
    ])
    wanted = sizes.select("feature", F.inline(F.when(few, every).otherwise(some)))
    wanted = wanted.withColumn("low", F.floor("at")).withColumn("high", F.ceil("at"))
    ends = wanted.select("feature", "place", "at", "low", F.explode(F.array_distinct(F.array("low", "high"))).alias("rank"))
    # At most fifty places per feature, whatever the number of rows: this side can always be sent to all tasks.
    found = ranked.join(F.broadcast(ends), ["feature", "rank"]).groupBy("feature", "place").agg(
        F.min("x").alias("x_low"), F.max("x").alias("x_high"), F.max(F.col("at") - F.col("low")).alias("part"))
    return found.select(
        "feature", "place", (F.col("x_low") + (F.col("x_high") - F.col("x_low")) * F.col("part")).alias("threshold"))


def split_gains(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(feature, position, threshold, gain) for every candidate threshold of every feature."""
    values = cut_lineage(_value_counts(df, columns, label))
    thresholds = split_thresholds(values)
    steps = thresholds.groupBy("feature").agg(F.array_sort(F.collect_list("threshold")).alias("steps"))
    present = values.where(F.col("x").isNotNull() & ~F.isnan("x")).join(F.broadcast(steps), "feature")
    slot = F.size(F.filter("steps", lambda t: t < F.col("x")))
    slots = present.groupBy("feature", "label", slot.alias("slot")).agg(F.sum("n").alias("n"))
    # From here on the tables have features x thresholds x classes rows.
    numbered = steps.select("feature", F.posexplode("steps").alias("slot", "threshold"))
    totals = values.groupBy("feature", "label").agg(F.sum("n").alias("all_n"))
    seen = slots.groupBy("feature", "label").agg(F.sum("n").alias("present_n"))
    grid = totals.join(seen, ["feature", "label"], "left").join(numbered, "feature")
    upto = Window.partitionBy("feature", "label").orderBy("slot")
    left = grid.join(slots, ["feature", "label", "slot"], "left").withColumn(
        "left_n", F.sum(F.coalesce("n", F.lit(0))).over(upto)
    ).withColumn("right_n", F.coalesce("present_n", F.lit(0)) - F.col("left_n"))
    sides = Window.partitionBy("feature", "slot")
    for side in ("left", "right"):
        left = left.withColumn(f"{side}_total", F.sum(f"{side}_n").over(sides))
    left = left.withColumn("total", F.sum("all_n").over(sides))

    def part(n: str, total: str) -> Column:
        p = F.try_divide(F.col(n), F.col(total))
        return F.sum(F.when(F.col(n) > 0, entropy_term(p)).otherwise(0.0))

    sums = left.groupBy("feature", "slot", "threshold").agg(
        part("all_n", "total").alias("parent"), part("left_n", "left_total").alias("left_entropy"),
        part("right_n", "right_total").alias("right_entropy"), F.max("left_total").alias("nl"),
        F.max("right_total").alias("nr"), F.max("total").alias("nt"),
    )
    gain = F.col("parent") - (F.col("nl") / F.col("nt") * F.col("left_entropy")
                              + F.col("nr") / F.col("nt") * F.col("right_entropy"))
    order = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("feature")) - 1
    return sums.select("feature", order.cast("int").alias("position"), "threshold", gain.alias("gain"))


def best_split(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """One row (feature, threshold, gain): the largest gain, on ties the first feature and the lowest threshold."""
    key = F.struct(F.round("gain", 12), -F.col("position"), -F.col("threshold"))
    best = F.max_by(F.struct("feature", "threshold", "gain"), key)
    return split_gains(df, columns, label).agg(best.alias("best")).select("best.*")


# A forest keeps node ids with the rows instead of walking every row down ever deeper trees, and more nodes fit one pass. One
# tree is walked: to write the ids of all rows anew for every level takes longer.
TREE_SETTINGS = {"cacheNodeIds": True, "maxMemoryInMB": 1024, "seed": SEED, "minInfoGain": MIN_GAIN,
                 "minInstancesPerNode": LEAF_ROWS}


def decision_tree(mode: str = "classification", max_depth: int = MAX_DEPTH, leaf_share: float = 0.0):
    """A leaf has LEAF_ROWS rows at least, whatever the table's size. A model of a very large table grows with it;
    `leaf_share`, the least share of all rows in a leaf, bounds it to 1 / leaf_share leaves."""
    settings = {**TREE_SETTINGS, "cacheNodeIds": False}
    if mode == "classification":
        return DecisionTreeClassifier(impurity="entropy", maxDepth=max_depth, minWeightFractionPerNode=leaf_share, **settings)
    return DecisionTreeRegressor(maxDepth=max_depth, minWeightFractionPerNode=leaf_share, **settings)


def random_forest(mode: str = "classification", trees: int = DEFAULT_TREES, max_depth: int = FOREST_DEPTH, leaf_share: float = 0.0):
    """`leaf_share` as for a tree."""
    if mode == "classification":
        return RandomForestClassifier(impurity="entropy", numTrees=trees, maxDepth=max_depth, minWeightFractionPerNode=leaf_share, **TREE_SETTINGS)
    return RandomForestRegressor(numTrees=trees, maxDepth=max_depth, minWeightFractionPerNode=leaf_share, **TREE_SETTINGS)


@dataclass
class ForestSearch:
    """Best forest, fitted on all rows, and (trees, max_depth, score) of every pair of the grid."""

    model: object
    trials: list[tuple[int, int, float]]


def first_trees(model, n: int):
    """The forest of the first n trees of a fitted one."""
    jvm = model._java_obj
    context = SparkContext._active_spark_context
    classifier = hasattr(model, "numClasses")
    kinds = context._jvm.org.apache.spark.ml
    kind = kinds.classification.DecisionTreeClassificationModel if classifier else kinds.regression.DecisionTreeRegressionModel
    trees = context._gateway.new_array(kind, n)
    for i, tree in enumerate(jvm.trees()):
        if i == n:
            break
        trees[i] = tree
    if classifier:
        made = kinds.classification.RandomForestClassificationModel(jvm.uid(), trees, model.numFeatures, model.numClasses)
    else:
        made = kinds.regression.RandomForestRegressionModel(jvm.uid(), trees, model.numFeatures)
    made.set(made.numTrees(), n)
    return RandomForestClassificationModel(made) if classifier else RandomForestRegressionModel(made)


def search_forest(df: DataFrame, mode: str = "classification", trees: Sequence[int] = tuple(range(10, 101, 10)),
                  depths: Sequence[int] = tuple(range(3, 21, 2)), parallelism: int = 4) -> ForestSearch:
    """Best (trees, depth) of the grid on a held-out fifth, by accuracy or R2; the first pair on ties. `df` has features
    and label. The largest forest of each depth is fitted once, smaller ones are its first trees."""
    evaluator = (MulticlassClassificationEvaluator(metricName="accuracy") if mode == "classification"
                 else RegressionEvaluator(metricName="r2"))
    train, test = (part.persist() for part in df.randomSplit([0.8, 0.2], SEED))

    def run(depth: int) -> list[tuple[int, int, float]]:
        model = random_forest(mode, max(trees), depth).fit(train)
        return [(n, depth, float(evaluator.evaluate(first_trees(model, n).transform(test)))) for n in trees]

    try:
        with ThreadPoolExecutor(parallelism) as pool:
            trials = sorted(t for found in pool.map(run, depths) for t in found)
    finally:
        train.unpersist()
        test.unpersist()
    best = max(trials, key=lambda t: t[2])
    return ForestSearch(random_forest(mode, *best[:2]).fit(df), trials)


def search_scores(found: ForestSearch, df: DataFrame) -> DataFrame:
    """(trees, max_depth, score) of a finished search."""
    return df.sparkSession.createDataFrame(found.trials, "trees int, max_depth int, score double")


def tree_dump(model, df: DataFrame) -> DataFrame:
    """(node, depth, rule): the fitted tree as a table, in the order of a walk."""
    return rules(node_table(model, df.sparkSession)).select("node", "depth", "rule")
