import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabulon.functions.text import clean_answer, normalise, tokens, word_count
from tabulon.operators import text_features as X


def test_normalise_and_tokens(spark):
    df = spark.createDataFrame([("Café  Don't STOP now_1\n",), ("",), ("¡¿",)], "t string")
    got = [tuple(r) for r in df.select(normalise("t"), tokens("t"), word_count("t")).collect()]
    assert got[0][1] == ["caf", "dont", "stop", "now1"]
    assert got[0][2] == 4
    assert got[1] == ("", [], 0)
    assert got[2][1] == []


def test_clean_answer(spark):
    given = ["the the the cat", "fooBar12", "a   b\n\n\n\nc ", "ＡＢＣ１ xyz", "of of it it", "dog dogs dog", "été été été", None]
    want = ["the cat", "foo Bar 12", "a b\n\nc", "ABC 1 xyz", "of of it it", "dog dogs dog", "été", None]
    got = spark.createDataFrame([(g,) for g in given], "t string").select(clean_answer("t")).collect()
    assert [r[0] for r in got] == want


DOCS = ["good film good", "bad film", "good plot", "awful bad bad plot", ""]
LABELS = ["p", "n", "p", "n", "n"]


def _frame(spark):
    return spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(zip(DOCS, LABELS))], "id long, text string, label string")


def _expected():
    words = [d.split() for d in DOCS]
    vocabulary = list(dict.fromkeys(w for d in words for w in d))
    counts = np.array([[d.count(v) for v in vocabulary] for d in words], dtype=float)
    tf = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    idf = np.log((len(DOCS) + 1) / ((counts > 0).sum(axis=0) + 1)) + 1
    return vocabulary, tf * idf


def test_vocabulary_and_tfidf(spark):
    docs = X.document_tokens(_frame(spark), "id", "text")
    vocabulary, weights = _expected()
    got = {r["term"]: r["term_index"] for r in X.vocabulary(docs, "id").collect()}
    assert got == {v: i for i, v in enumerate(vocabulary)}
    for r in X.tfidf(docs, "id").collect():
        assert abs(r["tfidf"] - weights[r["id"], got[r["term"]]]) < 1e-12


def test_tfidf_beyond_the_broadcast_bound(spark, monkeypatch):
    docs = X.document_tokens(_frame(spark), "id", "text")
    want = sorted(map(tuple, X.tfidf(docs, "id").collect()))
    monkeypatch.setattr(X, "MAX_BROADCAST_BYTES", 0)
    assert sorted(map(tuple, X.tfidf(docs, "id").collect())) == want


def _chi2(weights):
    y = np.array([[l == c for c in sorted(set(LABELS))] for l in LABELS], dtype=float)
    observed, expected = y.T @ weights, np.outer(y.mean(axis=0), weights.sum(axis=0))
    return ((observed - expected) ** 2 / expected).sum(axis=0)


def test_chi2_and_feature_vectors(spark):
    df = _frame(spark)
    docs = X.document_tokens(df, "id", "text", "label")
    vocabulary, weights = _expected()
    want = dict(zip(vocabulary, _chi2(weights)))
    got = {r["term"]: r["chi2"] for r in X.chi2_scores(docs, "id", "label").collect()}
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in got)
    stages, (out,), terms = X.text_feature_stages(df, ["text"], "id", "label", k=3)
    best = sorted(vocabulary, key=lambda t: (-round(want[t], 9), t))[:3]
    assert terms["text"] == best
    rows = Pipeline(stages=stages).fit(df).transform(df).orderBy("id").select(vector_to_array(out).alias("v")).collect()
    assert np.allclose([r["v"] for r in rows], weights[:, [vocabulary.index(t) for t in best]])


def test_long_document_in_one_row(spark):
    text = " ".join(f"w{i % 997}" for i in range(20_000))
    docs = X.document_tokens(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text")
    bag = X.bag_of_words(docs, "id")
    assert bag.agg(F.sum("n"), F.count("*"), F.max("n_tokens")).head()[:] == (20_000, 997, 20_000)


def test_normalise_like_the_plain_rule(spark):
    import re

    texts = ["ÀÉÎ İstanbul K 1\u00a02\u20033", "中文 mixed Ｗide ñandú\tx\x1cy", "emoji 😀 ok", "a\u0301b\u2026c\u2028d", "ſ ß ﬁ"]
    plain = [re.sub(r"[^a-z0-9\s]", "", t.lower()) for t in texts]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(normalise("t").alias("n"), tokens("t").alias("w")).collect()
    assert [r["n"] for r in rows] == plain
    assert [r["w"] for r in rows] == [p.split() for p in plain]
