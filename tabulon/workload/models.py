"""Bayes, impurities, splits, trees, forests and logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabulon.functions import vectors as V
from tabulon.operators import logistic as L
from tabulon.operators import naive_bayes as B
from tabulon.operators import tree_table as TT
from tabulon.operators import trees as T
from tabulon.operators import tuning
from tabulon.operators.batch_logistic import gradient_at, pack
from tabulon.operators.clean import encode, label_codes
from tabulon.session import cut_lineage, shared_path
from tabulon.sources.models import SavedModel, load_model, save_model
from tabulon.workload.clusters import EMBEDDED, flat_embeddings
from tabulon.sources.tables import bounded_tasks
from tabulon.workload.common import Registry, r, sql_r, table

queries = Registry()

EVENT_FEATURES = ["value", "hour"]
EVENTS = "(SELECT event_id, event_type, value, extract(hour FROM ts)::DOUBLE AS hour FROM events)"


def events(spark, d):
    return table(spark, d, "events").select(
        "event_id", "event_type", "value", F.hour("ts").cast("double").alias("hour"))


STATS = f"""(SELECT event_type AS label, count(*) AS n, column_name, avg(x) AS mean, greatest(stddev_pop(x), 1e-9) AS std
    FROM (SELECT event_type, unnest([struct_pack(column_name := 'value', x := value), struct_pack(column_name := 'hour', x := hour)], recursive := true)
          FROM {EVENTS}) GROUP BY ALL)"""


@queries.add("bayes_fit", f"SELECT label, n, column_name, {sql_r('mean')} AS mean, {sql_r('std')} AS std FROM {STATS}")
def bayes_fit(spark, d):
    found = B.class_statistics(events(spark, d), "event_type", EVENT_FEATURES)
    return found.select("label", "n", "column_name", r("mean").alias("mean"), r("std").alias("std"))


def bayes_sql(density: str) -> str:
    factor = "std / sqrt(2 * pi())" if density == "scaled" else "1 / (sqrt(2 * pi()) * std)"
    return f"""(
    WITH st AS {STATS},
    w AS (SELECT label, max(n) AS n, max(CASE WHEN column_name = 'value' THEN mean END) AS m1, max(CASE WHEN column_name = 'value' THEN std END) AS s1,
                 max(CASE WHEN column_name = 'hour' THEN mean END) AS m2, max(CASE WHEN column_name = 'hour' THEN std END) AS s2 FROM st GROUP BY label),
    l AS (SELECT event_id, event_type, label, ln(n / (SELECT count(*) FROM events))
            + ln({factor.replace('std', 's1')} * exp(-0.5 * ((value - m1) / s1) ** 2) + 1e-9)
            + ln({factor.replace('std', 's2')} * exp(-0.5 * ((hour - m2) / s2) ** 2) + 1e-9) AS score FROM {EVENTS}, w),
    e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY event_id)) AS x FROM l)
    SELECT event_id, event_type, label, x / sum(x) OVER (PARTITION BY event_id) AS p FROM e)"""


def _bayes(spark, d, density):
    df = events(spark, d)
    return B.with_class_probabilities(df, B.class_statistics(df, "event_type", EVENT_FEATURES), EVENT_FEATURES, density)


@queries.add("bayes_probabilities", f"SELECT event_id, label, {sql_r('p')} AS p FROM {bayes_sql('normal')}")
def bayes_probabilities(spark, d):
    return _bayes(spark, d, "normal").select("event_id", F.inline("probabilities")).select("event_id", "label", r("p").alias("p"))


@queries.add("bayes_probabilities_scaled", f"SELECT event_id, label, {sql_r('p')} AS p FROM {bayes_sql('scaled')}")
def bayes_probabilities_scaled(spark, d):
    return _bayes(spark, d, "scaled").select("event_id", F.inline("probabilities")).select("event_id", "label", r("p").alias("p"))


PREDICTED = f"(SELECT event_id, event_type, arg_max(label, p) AS predicted FROM {bayes_sql('normal')} GROUP BY ALL)"


@queries.add("bayes_predict", f"SELECT event_id, event_type, predicted FROM {PREDICTED}")
def bayes_predict(spark, d):
    return _bayes(spark, d, "normal").select("event_id", "event_type", "predicted")


@queries.add("impurities", f"""
    SELECT lang, {sql_r('sum(-p * log2(p + 1e-9))')} AS entropy, {sql_r('1 - sum(p * p)')} AS gini FROM (
        SELECT lang, source, count(*) / sum(count(*)) OVER (PARTITION BY lang) AS p FROM documents GROUP BY lang, source) GROUP BY lang
""")
def impurities(spark, d):
    found = T.impurities(table(spark, d, "documents"), "source", ["lang"])
    return found.select("lang", r("entropy").alias("entropy"), r("gini").alias("gini"))


SPLIT_FEATURES = ["value", "hour", "user_id"]
SPLIT_EVENTS = "(SELECT event_type AS label, value, extract(hour FROM ts)::DOUBLE AS hour, user_id::DOUBLE AS user_id FROM events)"
THRESHOLDS = " UNION ALL ".join(f"""
    SELECT '{c}' AS feature, {i} AS position, unnest(CASE WHEN count(*) <= 50 THEN list({c})
        ELSE quantile_cont({c}, [{', '.join(f'0.1 + 0.8 * {q} / 9.0' for q in range(10))}]) END) AS threshold
    FROM (SELECT DISTINCT {c} FROM {SPLIT_EVENTS})""" for i, c in enumerate(SPLIT_FEATURES))
GAINS = f"""(
    WITH t AS ({THRESHOLDS}),
    v AS (SELECT label, unnest([{', '.join(f"struct_pack(feature := '{c}', x := {c})" for c in SPLIT_FEATURES)}], recursive := true) FROM {SPLIT_EVENTS}),
    c AS (SELECT feature, x, label, count(*) AS n FROM v GROUP BY ALL),
    s AS (SELECT t.feature, position, threshold, label, sum(n) AS n_all, sum(CASE WHEN x <= threshold THEN n ELSE 0 END) AS n_left
          FROM t JOIN c USING (feature) GROUP BY ALL),
    p AS (SELECT *, n_all - n_left AS n_right, sum(n_all) OVER w AS t_all, sum(n_left) OVER w AS t_left, sum(n_all - n_left) OVER w AS t_right
          FROM s WINDOW w AS (PARTITION BY feature, threshold))
    SELECT feature, position, threshold,
        sum(-(n_all / t_all) * log2(n_all / t_all + 1e-9))
        - (max(t_left) / max(t_all) * sum(CASE WHEN n_left > 0 THEN -(n_left / t_left) * log2(n_left / t_left + 1e-9) ELSE 0 END)
         + max(t_right) / max(t_all) * sum(CASE WHEN n_right > 0 THEN -(n_right / t_right) * log2(n_right / t_right + 1e-9) ELSE 0 END)) AS gain
    FROM p GROUP BY ALL)"""


def _split_events(spark, d):
    return table(spark, d, "events").select(
        F.col("event_type").alias("label"), "value", F.hour("ts").cast("double").alias("hour"), F.col("user_id").cast("double"))


@queries.add("split_gains", f"SELECT feature, position, {sql_r('threshold')} AS threshold, {sql_r('gain')} AS gain FROM {GAINS}")
def split_gains(spark, d):
    found = T.split_gains(_split_events(spark, d), SPLIT_FEATURES, "label")
    return found.select("feature", "position", r("threshold").alias("threshold"), r("gain").alias("gain"))


@queries.add("best_split", f"""
    SELECT feature, {sql_r('threshold')} AS threshold, {sql_r('gain')} AS gain FROM {GAINS} ORDER BY round(gain, 12) DESC, position, threshold LIMIT 1
""")
def best_split(spark, d):
    found = T.best_split(_split_events(spark, d), SPLIT_FEATURES, "label")
    return found.select("feature", r("threshold").alias("threshold"), r("gain").alias("gain"))


# --- expressions of logistic regression ----------------------------------------------------------

LOGITS = "[(value - 25) / 10, hour / 12 - 1, 0.5]"


def _logits(spark, d):
    return events(spark, d).select(
        "event_id", F.array((F.col("value") - 25) / 10, F.col("hour") / 12 - 1, F.lit(0.5)).alias("z"))


@queries.add("sigmoid_softmax", f"""
    SELECT event_id, {sql_r('1 / (1 + exp(-z[1]))')} AS s, {sql_r('exp(z[1] - m) / t')} AS p0, {sql_r('exp(z[2] - m) / t')} AS p1, {sql_r('exp(z[3] - m) / t')} AS p2
    FROM (SELECT *, exp(z[1] - m) + exp(z[2] - m) + exp(z[3] - m) AS t FROM (SELECT *, list_max(z) AS m FROM (SELECT event_id, {LOGITS} AS z FROM {EVENTS})))
""")
def sigmoid_softmax(spark, d):
    found = _logits(spark, d).withColumn("p", V.softmax("z"))
    return found.select("event_id", r(V.sigmoid(F.col("z")[0])).alias("s"), *[r(F.col("p")[i]).alias(f"p{i}") for i in range(3)])


@queries.add("cross_entropy", f"""
    WITH z AS (SELECT event_id, {LOGITS} AS z FROM {EVENTS}),
    p AS (SELECT event_id, event_id % 3 AS label, list_transform(z, lambda x: exp(x)) AS e FROM z),
    q AS (SELECT label, least(greatest(e[label + 1] / list_sum(e), 1e-15), 1 - 1e-15) AS p,
                 least(greatest(e[1] / list_sum(e), 1e-15), 1 - 1e-15) AS p0 FROM p)
    SELECT {sql_r('avg(-ln(p)) + 0.01 * 2.5', 4)} AS loss, {sql_r('avg(CASE WHEN label = 1 THEN 2 ELSE 1 END * -ln(p))', 4)} AS weighted,
           {sql_r('avg(CASE WHEN label = 0 THEN -ln(p0) ELSE -ln(1 - p0) END)', 4)} AS binary_loss FROM q
""")
def cross_entropy(spark, d):
    label = F.col("event_id") % 3
    found = _logits(spark, d).select(label.alias("label"), V.softmax("z").alias("p"))
    loss = L.cross_entropy(F.col("p"), F.col("label"))
    first = L.binary_cross_entropy(F.col("p")[0], (F.col("label") == 0).cast("int"))
    parts = found.select(loss.alias("loss"), L.class_weight(F.col("label"), {1: 2.0}).alias("w"), first.alias("first"))
    plain = L.mean_loss(parts, F.col("loss"), 0.01, 2.5).scalar()
    weighted = L.mean_loss(parts, F.col("loss"), weight=F.col("w")).scalar()
    return L.mean_loss(parts, F.col("first")).select(
        r(plain, 4).alias("loss"), r(weighted, 4).alias("weighted"), r("loss", 4).alias("binary_loss"))


@queries.add("one_hot", """
    SELECT event_id, (code = 0)::INT AS c0, (code = 1)::INT AS c1, (code = 2)::INT AS c2, (code = 3)::INT AS c3, (code = 4)::INT AS c4
    FROM (SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM events)
""")
def one_hot(spark, d):
    df = events(spark, d)
    coded = encode(df, "event_type", label_codes(df, "event_type"), "code").withColumn("h", V.one_hot("code", 5))
    return coded.select("event_id", *[F.col("h")[i].alias(f"c{i}") for i in range(5)])


# --- fitted models -------------------------------------------------------------------------------


def _prepared(spark, d):
    return tuning.prepare(flat_embeddings(spark, d), "label", EMBEDDED, key="vec_id")


def _score(spark, d, name):
    data = _prepared(spark, d)
    data.frame.persist()
    _, scores = tuning.train_one(data, name)
    return spark.createDataFrame([(name, scores["accuracy"], scores["score"])], "model string, accuracy double, auc double")


@queries.add("tree_predict")
def tree_predict(spark, d):
    return _score(spark, d, tuning.TREE)


@queries.add("forest_predict")
def forest_predict(spark, d):
    return _score(spark, d, tuning.FOREST)


@queries.add("logistic_predict")
def logistic_predict(spark, d):
    return _score(spark, d, tuning.LOGISTIC)


@queries.add("bayes_model_predict")
def bayes_model_predict(spark, d):
    return _score(spark, d, tuning.NAIVE_BAYES)


@queries.add("tree_regression")
def tree_regression(spark, d):
    lineitem = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    data = tuning.prepare(lineitem, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], "regression")
    model = T.decision_tree("regression")
    _, found = tuning.held_out_score(tuning.single(model), data)
    return tuning.score(found, "regression", 0)


@queries.add("tree_dump")
def tree_dump(spark, d):
    data = _prepared(spark, d)
    model = T.decision_tree().fit(data.frame)
    return T.tree_dump(model, data.frame)


# A tree over three columns of few values, which SQL can grow level by level.
PIECE_FEATURES = ["discount", "tax", "line"]
PIECES = """(SELECT discount, tax, line, CASE WHEN l_orderkey % 7 = 0 THEN l_orderkey % 3 WHEN discount + line > 9 THEN 2 WHEN tax > line THEN 1 ELSE 0 END AS y
    FROM (SELECT l_orderkey, round(l_discount * 100) AS discount, round(l_tax * 100) AS tax, l_linenumber::DOUBLE AS line FROM lineitem))"""
TREE_DEPTH = 3


def _pieces(spark, d):
    line = bounded_tasks(table(spark, d, "lineitem").select("l_orderkey", "l_discount", "l_tax", "l_linenumber")).select(
        "l_orderkey", F.round(F.col("l_discount") * 100).alias("discount"), F.round(F.col("l_tax") * 100).alias("tax"), F.col("l_linenumber").cast("double").alias("line"))
    y = F.when(F.col("l_orderkey") % 7 == 0, F.col("l_orderkey") % 3).when(F.col("discount") + F.col("line") > 9, 2).when(F.col("tax") > F.col("line"), 1).otherwise(0)
    return line.select(F.array(*PIECE_FEATURES).alias("values"), array_to_vector(F.array(*PIECE_FEATURES)).alias("features"), y.cast("double").alias("label"))


def _grown_tree() -> str:
    """CTEs that grow the tree: level by level the best cut of every node, then from below the nodes whose two leaves agree."""
    h = lambda n, t: f"-sum(CASE WHEN {n} > 0 THEN {n} / {t} * log2({n} / {t}) ELSE 0 END)"
    value = "CASE f " + " ".join(f"WHEN '{c}' THEN {c}" for c in PIECE_FEATURES) + " END"
    parts = [
        f"cell0 AS (SELECT '' AS path, discount, tax, line, y, count(*) AS n FROM {PIECES} GROUP BY ALL)",
        "cut AS (SELECT * FROM (SELECT f, pos, (x + lead(x) OVER (PARTITION BY f ORDER BY x)) / 2 AS t FROM ("
        + " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS f, {i} AS pos, {c} AS x FROM cell0" for i, c in enumerate(PIECE_FEATURES)) + ")) WHERE t IS NOT NULL)"]
    for i in range(TREE_DEPTH + 1):
        parts.append(f"""node{i} AS (SELECT path, sum(n) AS n, arg_max(y, (n, -y)) AS prediction, {h('n', 't')} AS impurity
            FROM (SELECT *, sum(n) OVER (PARTITION BY path) AS t FROM (SELECT path, y, sum(n) AS n FROM cell{i} GROUP BY ALL)) GROUP BY path)""")
        if i == TREE_DEPTH:
            break
        long = " UNION ALL ".join(f"SELECT path, '{c}' AS f, {c} AS x, y, n FROM cell{i}" for c in PIECE_FEATURES)
        parts += [
            f"side{i} AS (SELECT path, f, pos, t, y, sum(n) AS a, sum(CASE WHEN x <= t THEN n ELSE 0 END) AS l FROM ({long}) JOIN cut USING (f) GROUP BY ALL)",
            f"sums{i} AS (SELECT *, a - l AS r, sum(a) OVER w AS ta, sum(l) OVER w AS tl, sum(a - l) OVER w AS tr FROM side{i} WINDOW w AS (PARTITION BY path, f, t))",
            f"""gain{i} AS (SELECT path, f, pos, t, max(tl) AS nl, max(tr) AS nr,
                {h('a', 'ta')} - max(tl) / max(ta) * ({h('l', 'tl')}) - max(tr) / max(ta) * ({h('r', 'tr')}) AS gain FROM sums{i} GROUP BY ALL)""",
            f"""best{i} AS (SELECT path, f, t, gain FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY gain DESC, pos, t) AS place FROM gain{i}
                WHERE nl >= {T.LEAF_ROWS} AND nr >= {T.LEAF_ROWS} AND gain >= {T.MIN_GAIN}) WHERE place = 1)""",
            f"cell{i + 1} AS (SELECT path || CASE WHEN {value} <= t THEN 'L' ELSE 'R' END AS path, discount, tax, line, y, n FROM cell{i} JOIN best{i} USING (path))"]
    parts.append(f"state{TREE_DEPTH} AS (SELECT path, prediction, false AS inner_node FROM node{TREE_DEPTH})")
    for i in reversed(range(TREE_DEPTH)):
        parts.append(f"""state{i} AS (SELECT n.path, n.prediction, b.path IS NOT NULL AND NOT (NOT l.inner_node AND NOT r.inner_node AND l.prediction = r.prediction) AS inner_node
            FROM node{i} n LEFT JOIN best{i} b USING (path) LEFT JOIN state{i + 1} l ON l.path = n.path || 'L' LEFT JOIN state{i + 1} r ON r.path = n.path || 'R')""")
    for i in range(TREE_DEPTH + 1):
        above = f"JOIN state{i - 1} p ON p.path = s.path[:{i - 1}] AND p.inner_node" if i else ""
        parts.append(f"kept{i} AS (SELECT s.* FROM state{i} s {above})")
    return ",\n".join(parts)


@queries.add("tree_nodes", f"WITH {_grown_tree()} " + " UNION ALL ".join(f"""
    SELECT k.path, CASE WHEN k.inner_node THEN f END AS feature, CASE WHEN k.inner_node THEN t END AS threshold, n::BIGINT AS n, k.prediction::DOUBLE AS prediction,
           {sql_r('impurity')} AS impurity, CASE WHEN k.inner_node THEN {sql_r('gain')} END AS gain
    FROM kept{i} k JOIN node{i} USING (path) LEFT JOIN {f'best{i}' if i < TREE_DEPTH else "(SELECT '' AS path, '' AS f, 0.0::DOUBLE AS t, 0.0::DOUBLE AS gain WHERE false)"} USING (path)"""
    for i in range(TREE_DEPTH + 1)))
def tree_nodes(spark, d):
    """The fitted tree as a table of nodes."""
    nodes = TT.feature_names(TT.node_table(T.decision_tree(max_depth=TREE_DEPTH).fit(_pieces(spark, d)), spark), PIECE_FEATURES)
    return nodes.select("path", "feature", "threshold", "n", "prediction", r("impurity").alias("impurity"), r("gain").alias("gain"))


@queries.add("tree_leaves", f"WITH {_grown_tree()} SELECT path, y::DOUBLE AS label, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join(
    f"SELECT path, y, n FROM cell{i} JOIN kept{i} USING (path) WHERE NOT inner_node" for i in range(TREE_DEPTH + 1)) + ") GROUP BY ALL")
def tree_leaves(spark, d):
    """Where the rows end when they walk the table of nodes."""
    rows = _pieces(spark, d)
    nodes = cut_lineage(TT.node_table(T.decision_tree(max_depth=TREE_DEPTH).fit(rows), spark))
    found = TT.with_leaves(rows.select("values", "label"), nodes, "values").select(F.get("leaves", F.lit(0)).alias("node"), "label")
    return found.join(nodes.select("node", "path"), "node").groupBy("path", "label").agg(F.count(F.lit(1)).alias("n"))


TEST_ROWS = "(SELECT count(*) FROM embeddings WHERE ('0x' || substr(md5('42:' || vec_id::VARCHAR), 1, 8))::BIGINT % 100 >= 80)"


def _walked(spark, d, estimator):
    """Over the held-out rows: trees, rows, rows for which the walk and the model agree, and nodes whose children do not add
    up to them or whose leaves are too small."""
    data = _prepared(spark, d)
    data.frame.persist()
    model = estimator.fit(data.frame.where(~F.col("is_test")))
    nodes = cut_lineage(TT.node_table(model, spark))
    found = TT.with_votes(model.transform(data.frame.where("is_test")), nodes)
    gap = F.aggregate(F.zip_with("walked_shares", vector_to_array("probability"), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, v: F.greatest(a, v))
    same = (F.col("walked") == F.col("prediction")) & (gap < 1e-12)
    children = nodes.where("parent is not null").groupBy("tree", F.col("parent").alias("node")).agg(F.sum("n").alias("below"), F.min("n").alias("least"))
    broken = nodes.join(children, ["tree", "node"], "left").where(
        (F.col("left") >= 0) & (F.coalesce("below", F.lit(0)) != F.col("n")) | (F.col("least") < T.LEAF_ROWS) | (F.col("depth") > T.MAX_DEPTH)).count()
    trees = nodes.agg(F.countDistinct("tree")).scalar()
    return found.agg(trees.alias("trees"), F.count(F.lit(1)).alias("n_rows"), F.count_if(same).alias("n_same"), F.lit(broken).cast("long").alias("n_broken"))


@queries.add("tree_walk", f"SELECT 1::BIGINT AS trees, {TEST_ROWS} AS n_rows, {TEST_ROWS} AS n_same, 0::BIGINT AS n_broken")
def tree_walk(spark, d):
    return _walked(spark, d, T.decision_tree())


@queries.add("forest_walk", f"SELECT {T.DEFAULT_TREES}::BIGINT AS trees, {TEST_ROWS} AS n_rows, {TEST_ROWS} AS n_same, 0::BIGINT AS n_broken")
def forest_walk(spark, d):
    return _walked(spark, d, T.random_forest())


@queries.add("forest_size_search")
def forest_size_search(spark, d):
    data = _prepared(spark, d)
    data.frame.persist()
    found = T.search_forest(data.frame)
    return T.search_scores(found, data.frame)


@queries.add("scaled_model")
def scaled_model(spark, d):
    data = _prepared(spark, d)
    model, found = tuning.held_out_score(tuning.scaled(L.logistic_regression()), data)
    return found.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


@queries.add("logistic_optimum", "SELECT 10::BIGINT AS classes, true AS at_optimum")
def logistic_optimum(spark, d):
    """The loss is convex, so weights are right if and only if its gradient vanishes there."""
    data = _prepared(spark, d)
    scaler, model = tuning.scaled(L.logistic_regression()).fit(data.frame).stages
    rows = scaler.transform(data.frame).withColumn("fold", F.lit(0))
    weights = np.hstack((model.coefficientMatrix.toArray(), model.interceptVector.toArray()[:, None]))
    gradient = gradient_at(pack(rows, "scaled"), weights, L.L2)
    return spark.createDataFrame([(len(weights), bool(abs(gradient).max() < 1e-4))], "classes long, at_optimum boolean")


@queries.add("model_store", f"""
    SELECT predicted AS predicted_label, count(*) AS n, 'event_type' AS target, 'Naive Bayes' AS model FROM {PREDICTED} GROUP BY 1
""")
def model_store(spark, d):
    df = events(spark, d)
    data = tuning.prepare(df, "event_type", EVENT_FEATURES, key="event_id")
    fitted = tuning.full_model(data, tuning.single(B.GaussianBayes()).fit(data.frame))
    root = shared_path(spark, "models")
    fields = [f for f in df.schema if f.name in EVENT_FEATURES]
    save_model(spark, root, SavedModel(fitted, "events", "Naive Bayes", 1, "event_type", "classification", fields,
                                       data.labels, {"score": None}))
    found = load_model(spark, root, "events", "Naive Bayes")
    return found.pipeline.transform(df).groupBy("predicted_label").agg(F.count(F.lit(1)).alias("n")).select(
        "predicted_label", "n", F.lit(found.target).alias("target"), F.lit(found.name).alias("model"))
