import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabulon.functions import vectors as V
from tabulon.operators import logistic as L
from tabulon.operators import metrics as M
from tabulon.operators import naive_bayes as B
from tabulon.operators import retrieval as R
from tabulon.operators import splits as S
from tabulon.operators import trees as T
from tabulon.operators import tuning
from tabulon.plans.classify_table import classify_table
from tabulon.session import shared_path
from tabulon.sources.models import load_model, save_model
from tabulon.workload.models import queries as model_queries
from tabulon.workload.runs import queries as run_queries


@pytest.fixture(scope="module")
def flowers(spark):
    rng = np.random.default_rng(2)
    centres = {"setosa": (5.0, 3.4, 1.5, 0.2), "versicolor": (5.9, 2.8, 4.3, 1.3), "virginica": (6.6, 3.0, 5.6, 2.0)}
    rows = [(i * 3 + j, *map(float, rng.normal(c, (0.4, 0.3, 0.3, 0.2))), s) for i in range(40) for j, (s, c) in enumerate(centres.items())]
    return spark.createDataFrame(
        rows, "id long, sepal_length double, sepal_width double, petal_length double, petal_width double, species string").persist()


NUMBERS = ["sepal_length", "sepal_width", "petal_length", "petal_width"]


def _bayes(x, y, density):
    classes = sorted(set(y))
    out = []
    for row in x:
        score = []
        for c in classes:
            part = x[y == c]
            s = math.log(len(part) / len(x))
            for v, m, d in zip(row, part.mean(axis=0), np.maximum(part.std(axis=0), 1e-9)):
                front = d / math.sqrt(2 * math.pi) if density == "scaled" else 1 / (math.sqrt(2 * math.pi) * d)
                s += math.log(front * math.exp(-0.5 * ((v - m) / d) ** 2) + 1e-9)
            score.append(s)
        e = np.exp(np.array(score) - max(score))
        out.append(e / e.sum())
    return np.array(out)


@pytest.mark.parametrize("density", B.DENSITIES)
def test_gaussian_bayes_model(spark, flowers, density):
    data = tuning.prepare(flowers, "species", NUMBERS, key="id")
    model = B.GaussianBayes(density=density).fit(data.frame)
    pdf = flowers.orderBy("id").toPandas()
    want = _bayes(pdf[NUMBERS].to_numpy(), pdf["species"].to_numpy(), density)
    rows = B.with_class_probabilities(flowers, B.class_statistics(flowers, "species", NUMBERS), NUMBERS, density)
    got = np.array([[p["p"] for p in r["probabilities"]] for r in rows.orderBy("id").collect()])
    assert np.allclose(got, want)
    fitted = tuning.full_model(data, PipelineModel([model])).transform(flowers).orderBy("id").collect()
    assert np.allclose([r["probability"].toArray() for r in fitted], want)
    assert [r["predicted_label"] for r in fitted] == [sorted(set(pdf["species"]))[i] for i in want.argmax(axis=1)]


def test_impurity_and_best_split(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(150, 2)), 6)
    few = rng.integers(0, 6, 150).astype(float)
    y = (x[:, 0] + few / 3 > 0.6).astype(int)
    df = spark.createDataFrame([(float(a), float(b), float(c), int(t)) for (a, b), c, t in zip(x, few, y)], "a double, b double, c double, y int")

    def entropy(v):
        p = np.unique(v, return_counts=True)[1] / max(len(v), 1)
        return -(p * np.log2(p + 1e-9)).sum()

    best = (-np.inf, None, None)
    for name, column in (("a", x[:, 0]), ("b", x[:, 1]), ("c", few)):
        values = np.unique(column)
        if len(values) > 50:
            values = np.quantile(values, np.linspace(0.1, 0.9, 10))
        for t in values:
            left, right = y[column <= t], y[column > t]
            gain = entropy(y) - len(left) / 150 * entropy(left) - len(right) / 150 * entropy(right)
            if gain > best[0] + 1e-12:
                best = (gain, name, t)
    got = T.best_split(df, ["a", "b", "c"], "y").head()
    assert got["feature"] == best[1] and abs(got["threshold"] - best[2]) < 1e-9 and abs(got["gain"] - best[0]) < 1e-9
    found = T.impurities(df, "y").head()
    p = np.bincount(y) / 150
    assert abs(found["entropy"] - entropy(y)) < 1e-9 and abs(found["gini"] - (1 - (p ** 2).sum())) < 1e-12


def test_softmax_argmax_one_hot(spark):
    df = spark.createDataFrame([([1000.0, 1000.0, 999.0],)], "z array<double>")
    row = df.select(V.softmax("z").alias("p"), V.argmax("z").alias("i"), V.one_hot(F.lit(1), 3).alias("h")).head()
    assert abs(sum(row["p"]) - 1) < 1e-12 and row["i"] == 0 and row["h"] == [0, 1, 0]


def test_logistic_solution_has_no_gradient(flowers):
    data = tuning.prepare(flowers, "species", NUMBERS, key="id")
    model = L.logistic_regression(0.1).fit(data.frame)
    rows = data.frame.collect()
    x, y = np.array([r["features"].toArray() for r in rows]), np.array([int(r["label"]) for r in rows])
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    z = x @ w.T + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    gradient = (p - np.eye(3)[y]).T @ x / len(y) + 0.1 * w
    assert np.abs(gradient).max() < 1e-3


def test_folds_and_split(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 < 7, "hot").otherwise("cold").alias("y"))
    counts = S.with_folds(df, "y", "id").groupBy("y", "fold").count().collect()
    assert len(counts) == 10 and {r["count"] for r in counts if r["y"] == "hot"} == {140} and {r["count"] for r in counts if r["y"] == "cold"} == {60}
    nulls = S.with_folds(df.withColumn("y", F.lit(None).cast("string")), "y", "id").groupBy("fold").count().collect()
    assert {r["count"] for r in nulls} == {200}
    bare = S.with_folds(df.withColumn("id", F.col("id") + 1), "y").groupBy("y", "fold").count().collect()
    assert {r["count"] for r in bare} == {140, 60}
    spread = S.with_folds(df, None, "id").groupBy("fold").count().collect()
    assert len(spread) == 5 and all(150 < r["count"] < 250 for r in spread)
    train, test = S.train_test(df, "id")
    assert train.count() + test.count() == 1000 and 150 < test.count() < 250
    assert sorted(r["id"] for r in test.collect()) == sorted(r["id"] for r in S.train_test(df.repartition(7), "id")[1].collect())
    assert S.train_test(df)[1].count() > 0


def _auc(pos, neg):
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def test_scores_with_ties_and_absent_classes(spark):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 3, 120)
    p = np.round(rng.dirichlet((1, 1, 1), 120), 1)
    pred = p.argmax(axis=1)
    df = spark.createDataFrame([(int(a), int(b), [float(v) for v in q]) for a, b, q in zip(y, pred, p)], "label int, prediction int, p array<double>")
    want = sum((y == c).mean() * _auc(p[y == c, c], p[y != c, c]) for c in range(3))
    assert abs(M.ovr_auc(df, "label", "p").head()["auc"] - want) < 1e-12
    labels = spark.createDataFrame([(0,), (1,), (3,)], "label int")
    got = {r["label"]: r for r in M.binary_rates(M.one_vs_rest(M.confusion(df), labels)).collect()}
    inside = np.isin(y, (0, 1, 3))
    for c in (0, 1, 3):
        tp, fp = ((y == c) & (pred == c)).sum(), (inside & (y != c) & (pred == c)).sum()
        fn, tn = ((y == c) & (pred != c)).sum(), (inside & (y != c) & (pred != c)).sum()
        assert tuple(got[c][k] for k in ("tp", "tn", "fp", "fn")) == (tp, tn, fp, fn)
    assert got[3]["sensitivity"] == 0 and got[3]["precision"] == 0 and got[3]["f_score"] == 0


def test_selection_run_and_store(spark, flowers):
    run = classify_table(flowers, key="id", search_draws=2, trees=5, forest_depth=5, dataset="flowers", ignore=("id",))
    table = run.scores.orderBy("order").collect()
    assert [r["model"] for r in table] == [
        "Naive Bayes", "Decision Tree classification", "Random Forest classification", "Logistic Regression", "Tuned Logistic Regression"]
    assert run.model.target == "species" and run.model.scores["score"] > 0.95
    assert run.model.name == max(table, key=lambda r: (r["score"], -r["order"]))["model"]
    root = shared_path(spark, "models")
    save_model(spark, root, run.model)
    back = load_model(spark, root, "flowers", run.model.name)
    assert [f.name for f in back.fields] == NUMBERS and back.labels == ["setosa", "versicolor", "virginica"]
    scored = back.pipeline.transform(flowers.drop("species")).join(flowers.select("id", "species"), "id")
    assert scored.where("predicted_label = species").count() > 110


@pytest.mark.parametrize("name", ["Naive Bayes", "Decision Tree", "Random Forest", "Logistic Regression"])
def test_single_models_beat_chance(flowers, name):
    data = tuning.prepare(flowers, "species", NUMBERS, key="id")
    _, scores = tuning.train_one(data, name)
    assert scores["accuracy"] > 0.8 and scores["score"] > 0.9


def test_regression_run(spark):
    df = spark.range(300).select((F.col("id") / 10).alias("x1"), (F.col("id") % 7).alias("x2"), (F.col("id") * 0.3 + 1).alias("y"))
    run = classify_table(df, search_draws=0, trees=5, forest_depth=6)
    assert run.model.mode == "regression" and run.model.scores["score"] > 0.9
    with pytest.raises(ValueError):
        classify_table(df, "Naive Bayes")


def test_text_run(spark):
    words = {"Positive": "good great fine", "Negative": "bad awful poor"}
    rows = [(f"{words[s]} film number {i % 5} {words[s].split()[i % 3]}", s) for i in range(60) for s in words]
    df = spark.createDataFrame(rows, "review string, label string")
    run = classify_table(df, "Naive Bayes", top_features=6)
    assert run.text_columns == ["review"] and set(run.vocabulary["review"]) == set("good great fine bad awful poor".split())
    assert run.model.scores["accuracy"] == 1.0


def test_first_trees_are_a_forest(flowers):
    for mode, target in (("classification", "species"), ("regression", "petal_length")):
        data = tuning.prepare(flowers, target, ["sepal_length", "petal_width"], mode, key="id")
        model = T.random_forest(mode, 6, 4).fit(data.frame)
        all_, three = T.first_trees(model, 6), T.first_trees(model, 3)
        assert three.getNumTrees == 3 and [t.toDebugString for t in three.trees] == [t.toDebugString for t in model.trees[:3]]
        both = [[r["prediction"] for r in m.transform(data.frame.orderBy("features")).collect()] for m in (model, all_)]
        assert both[0] == both[1]


def test_search_queries_try_the_declared_grid(spark, monkeypatch):
    tried = {}
    monkeypatch.setattr(T, "search_forest", lambda df, **sizes: T.ForestSearch(tried.setdefault("forest", sizes), [(1, 1, 1.0)]))
    monkeypatch.setattr(tuning, "random_search", lambda data, **sizes: SimpleNamespace(trials=tried.setdefault("search", sizes)))
    model_queries.queries["forest_size_search"](spark, "/root/testdata/sf0.001")
    run_queries.queries["random_search"](spark, "/root/testdata/sf0.001")
    assert tried == {"forest": {}, "search": {}}


def test_selection_queries_try_every_candidate(spark, monkeypatch):
    tried = []
    monkeypatch.setattr(tuning, "random_search", lambda data, *draws, **_: SimpleNamespace(estimator=L.logistic_regression(0.5)))

    def select(data, models, **_):
        forest = models["Random Forest classification"].getStages()[-1]
        tried.append((list(models), forest.getNumTrees(), forest.getMaxDepth()))
        table = spark.createDataFrame([(0, tuning.NAIVE_BAYES, "5-fold", 0.5, 0.0)], "order int, model string, protocol string, score double, seconds double")
        return tuning.Selection(tuning.NAIVE_BAYES, 0.5, table, models[tuning.NAIVE_BAYES])

    monkeypatch.setattr(tuning, "select_model", select)
    for name in ("model_selection", "best_model_run"):
        run_queries.queries[name](spark, "/root/testdata/sf0.001").collect()
    every = [tuning.NAIVE_BAYES, "Decision Tree classification", "Random Forest classification", tuning.LOGISTIC, tuning.TUNED]
    assert tried == [(every, 100, 25)] * 2


def test_model_queries_run_at_declared_sizes(spark, monkeypatch):
    seen = []

    class Stop(Exception):
        pass

    def recorded(name, module):
        def run(*args, **sizes):
            seen.append((name, args, sizes))
            raise Stop
        monkeypatch.setattr(module, name, run)

    recorded("logistic_regression", L)
    recorded("decision_tree", T)
    recorded("text_encoder", R)
    for queries, name in ((run_queries, "cross_validated_auc"), (model_queries, "scaled_model"), (model_queries, "tree_dump"),
                          (model_queries, "tree_regression"), (run_queries, "question_run")):
        with pytest.raises(Stop):
            queries.queries[name](spark, "/root/testdata/sf0.001")
    assert [(n, a) for n, a, _ in seen[:4]] == [("logistic_regression", ())] * 2 + [("decision_tree", ()), ("decision_tree", ("regression",))]
    assert seen[4][0] == "text_encoder" and not any(sizes for _, _, sizes in seen)


def test_forest_search_and_tree_dump(flowers):
    data = tuning.prepare(flowers, "species", NUMBERS, key="id")
    found = T.search_forest(data.frame, trees=(2, 4), depths=(3,))
    assert T.search_scores(found, data.frame).count() == 2
    dump = T.tree_dump(T.decision_tree().fit(data.frame), data.frame).orderBy("node").collect()
    assert dump[0]["depth"] == 0 and any("Predict" in r["rule"] for r in dump) and dump[1]["depth"] == 1


def test_words_are_features_and_the_key_is_not(spark):
    rows = [(i, ("red", "green", "blue")[i % 3], float(i * 7919 % 101), f"note {i} {i * i}", ("x", "y", "z")[i % 3]) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, color string, noise double, remark string, kind string")
    run = classify_table(df, "Decision Tree", target="kind", key="id", mode="classification")
    assert [f.name for f in run.model.fields] == ["color", "noise"]
    report = {r["key"]: r["value"] for r in run.report.collect()}
    assert float(report["accuracy"]) == 1.0 if "accuracy" in report else float(report["score"]) > 0.99
    assert report["unused columns"] == "id, remark"


def test_trees_stay_within_their_bound(spark):
    data = spark.range(4000).select(F.rand(1).alias("x"), (F.rand(2) < 0.5).cast("double").alias("label"))
    featured = VectorAssembler(inputCols=["x"], outputCol="features").transform(data)
    forest = T.random_forest(trees=3).fit(featured)
    assert all(t.numNodes <= 2 * 4000 / T.LEAF_ROWS for t in forest.trees)


def test_too_many_classes(spark, monkeypatch):
    monkeypatch.setattr(tuning, "MAX_CLASSES", 10)
    with pytest.raises(ValueError, match="more than 10 classes"):
        tuning.sorted_labels(spark.range(11).select(F.col("id").cast("string").alias("y")), "y")


@pytest.mark.parametrize("values", [45, 60])
def test_word_columns_stay_in_the_model_when_the_table_grows(spark, values):
    rows = [(f"w{i * 7919 % values}", float(i * 31 % 17), "yes" if (i * 7919 % values) % 2 else "no") for i in range(900)]
    df = spark.createDataFrame(rows, "word string, x double, answer string")
    run = classify_table(df, "Logistic Regression", "answer")
    report = {(r["section"], r["key"]): r["value"] for r in run.report.collect()}
    assert "word" in [f.name for f in run.model.fields] and report["data", "unused columns"] == ""
    assert report["data", "hashed columns"] == ("word" if values > 50 else "")
    # The word decides the answer, so a model without it could not know.
    assert run.model.scores["accuracy"] > 0.95
    assert run.model.pipeline.transform(df).where("predicted_label = answer").count() > 0.95 * 900


def test_every_row_of_questions_is_answered_once(spark):
    from tabulon.plans.answer_questions import answer_questions
    docs = spark.createDataFrame([(i, f"text {i}", [float(i), 0.0]) for i in range(6)], "doc_id long, text string, embedding array<double>")
    asked = [("q", "clustering", "why", [1.0, 0.0])] * 3 + [("q", "clustering", "other", [4.0, 0.0]), (None, "clustering", "null id", [2.0, 0.0]), ("v", "clustering", "no vector", None)]
    questions = spark.createDataFrame(asked, "query_id string, task string, question string, embedding array<double>")
    got = answer_questions(questions, docs, k=2).collect()
    assert sorted(r.query_id or "" for r in got) == ["", "q", "q", "q", "q", "v"]
    assert sum("text 1\ntext" in r.prompt for r in got) == 3 and all(r.prompt for r in got)
