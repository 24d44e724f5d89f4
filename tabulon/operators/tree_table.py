"""Fitted trees as a relation: one row for each node, and prediction as a walk over that relation.

The rows come from the data that a saved model consists of. Rows to be scored walk all trees in one projection: the node
table, as one row of arrays, goes to the tasks just as the model itself does when it predicts.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabulon.session import shared_path

_PLACES = "tree int, node int, parent int, side string, depth int, path string"


def node_table(model, spark: SparkSession) -> DataFrame:
    """(tree, node, parent, side, depth, path, feature, threshold, categories, left, right, n, impurity, gain, prediction, stats)
    of a fitted tree or forest of MLlib.

    Nodes are numbered in the order of a walk, the root is 0. `side` is L or R, `path` the sides from the root on. A row goes
    left if its feature is at most `threshold` or, for a categorical feature, one of `categories`. Leaves have neither, no
    children (-1) and no gain. `stats` holds the class weights of a classifier."""
    path = shared_path(spark, "trees")
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    if "nodeData" in saved.columns:
        saved = saved.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        saved = saved.withColumn("tree", F.lit(0))
    split, inner = F.col("split"), F.col("leftChild") >= 0
    ordered = split["numCategories"] < 0
    nodes = saved.select(
        "tree", F.col("id").alias("node"), F.when(inner, split["featureIndex"]).alias("feature"),
        F.when(inner & ordered, F.get(split["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.when(inner & ~ordered, split["leftCategoriesOrThreshold"]).alias("categories"),
        F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("rawCount").alias("n"), "impurity",
        F.when(inner, F.col("gain")).alias("gain"), "prediction", F.col("impurityStats").alias("stats"))
    # One tree is what one task holds when it predicts.
    places = nodes.select("tree", "node", "left", "right").groupBy("tree").applyInPandas(_places, _PLACES)
    return places.join(nodes, ["tree", "node"])


def _places(tree: pd.DataFrame) -> pd.DataFrame:
    tree = tree.sort_values("node")
    found = {0: (None, None, 0, "")}
    for node, left, right in zip(tree["node"], tree["left"], tree["right"]):
        depth, path = found[node][2:]
        for child, side in ((left, "L"), (right, "R")):
            if child >= 0:
                found[child] = (node, side, depth + 1, path + side)
    rows = [(tree["tree"].iloc[0], node, *found[node]) for node in tree["node"]]
    return pd.DataFrame(rows, columns=["tree", "node", "parent", "side", "depth", "path"]).astype({"parent": "Int32"})


def _packed(nodes: DataFrame) -> DataFrame:
    """One row: `_trees`, the trees in order, each with its nodes by number and its depth."""
    total = F.aggregate("stats", F.lit(0.0), lambda a, v: a + v)
    shares = F.when(total > 0, F.transform("stats", lambda v: v / total)).otherwise(F.col("stats"))
    node = F.struct("node", "feature", "threshold", "categories", "left", "right", "prediction", shares.alias("shares"))
    trees = nodes.groupBy("tree").agg(F.array_sort(F.collect_list(node)).alias("nodes"), F.max("depth").alias("depth"))
    # array_sort compares the whole struct, of which the number comes first and decides.
    return trees.agg(F.array_sort(F.collect_list(F.struct("tree", "nodes", "depth"))).alias("_trees"))


def _leaf(tree: Column, features: Column) -> Column:
    def down(at: Column, _: Column) -> Column:
        node = F.get(tree["nodes"], at)
        value = F.get(features, node["feature"])
        left = F.when(node["categories"].isNull(), value <= node["threshold"]).otherwise(F.array_contains(node["categories"], value))
        return F.when(node["left"] < 0, at).when(left, node["left"]).otherwise(node["right"])

    steps = F.when(tree["depth"] > 0, F.sequence(F.lit(1), tree["depth"])).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0), down)


def with_leaves(rows: DataFrame, nodes: DataFrame, features: str = "features") -> DataFrame:
    """Add `leaves`: the leaf, by its number, that the row reaches in each tree."""
    joined, values = _with_trees(rows, nodes, features)
    return joined.select(*rows.columns, F.transform("_trees", lambda t: _leaf(t, values)).alias("leaves"))


def with_votes(rows: DataFrame, nodes: DataFrame, features: str = "features", mode: str = "classification") -> DataFrame:
    """Add `walked` and, for a classifier, `walked_shares`: of a forest, the class with the largest sum of the leaves' class
    shares (the first one on ties), or the mean of the leaves' values. Trees add up in their order."""
    joined, values = _with_trees(rows, nodes, features)
    leaves = F.transform("_trees", lambda t: F.get(t["nodes"], _leaf(t, values)))
    found = joined.select(*rows.columns, leaves.alias("_leaves"))
    if mode != "classification":
        total = F.aggregate("_leaves", F.lit(0.0), lambda a, v: a + v["prediction"])
        return found.select(*rows.columns, (total / F.size("_leaves")).alias("walked"))
    first = F.transform(F.get("_leaves", F.lit(0))["shares"], lambda v: v * 0.0)
    votes = F.aggregate("_leaves", first, lambda a, v: F.zip_with(a, v["shares"], lambda x, y: x + y))
    voted = found.select(*rows.columns, votes.alias("_votes"))
    most = (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double")
    total = F.aggregate("_votes", F.lit(0.0), lambda a, v: a + v)
    return voted.select(*rows.columns, most.alias("walked"), F.transform("_votes", lambda v: v / total).alias("walked_shares"))


def _with_trees(rows: DataFrame, nodes: DataFrame, features: str) -> tuple[DataFrame, Column]:
    clash = {"_trees", "_leaves", "_votes", "_values"} & set(rows.columns)
    if clash:
        raise ValueError(f"columns exist: {sorted(clash)}")
    vector = not isinstance(rows.schema[features].dataType, StructType) and rows.schema[features].dataType.typeName() != "array"
    values = vector_to_array(features) if vector else F.col(features)
    # The right side is one row.
    return rows.withColumn("_values", values).crossJoin(F.broadcast(_packed(nodes))), F.col("_values")


def feature_names(nodes: DataFrame, names: Sequence[str]) -> DataFrame:
    """The node table with the features' names in place of their numbers."""
    return nodes.withColumn("feature", F.get(F.array(*[F.lit(n) for n in names]), F.col("feature")))


def rules(nodes: DataFrame) -> DataFrame:
    """(tree, node, depth, rule): the tree as lines, in the order of a walk; `node` numbers the lines of a tree."""
    up = nodes.select("tree", F.col("node").alias("parent"), F.col("feature").alias("_feature"), F.col("threshold").alias("_threshold"),
                      F.col("categories").alias("_categories"))
    joined = nodes.join(up, ["tree", "parent"], "left")
    left = F.col("side") == "L"
    value = F.concat(F.lit("feature "), F.col("_feature").cast("string"))
    listed = F.concat(F.lit("{"), F.array_join(F.col("_categories").cast("array<string>"), ","), F.lit("}"))
    test = F.when(F.col("_categories").isNull(), F.concat(F.when(left, " <= ").otherwise(" > "), F.col("_threshold").cast("string"))) \
        .otherwise(F.concat(F.when(left, " in ").otherwise(" not in "), listed))
    entry = F.when(F.col("parent").isNotNull(), F.struct(
        (F.col("depth") - 1).alias("depth"), F.concat(F.when(left, "If (").otherwise("Else ("), value, test, F.lit(")")).alias("rule")))
    leaf = F.when(F.col("left") < 0, F.struct("depth", F.concat(F.lit("Predict: "), F.col("prediction").cast("string")).alias("rule")))
    lines = joined.select("tree", F.col("node").alias("_at"), F.posexplode(F.array(entry, leaf)).alias("_line", "_r")).filter("_r is not null")
    walk = lines.groupBy("tree").agg(F.array_sort(F.collect_list(F.struct("_at", "_line", "_r"))).alias("_walk"))
    return walk.select("tree", F.posexplode("_walk").alias("node", "_e")).select("tree", "node", "_e._r.depth", "_e._r.rule")
