"""Values out of text, routing, and the classification runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import retrieval, scoring, tuning
from tabulon.operators import logistic as L
from tabulon.operators.batch_logistic import fit_many, pack
from tabulon.operators.naive_bayes import GaussianBayes
from tabulon.plans.answer_questions import answer_questions, predict_questions, route_questions
from tabulon.plans.classify_table import classify_table
from tabulon.sources.models import SavedModel
from tabulon.workload.clusters import EMBEDDED, flat_embeddings
from tabulon.workload.common import Registry, r, sql_r, table
from tabulon.workload.models import EVENT_FEATURES, PREDICTED, events

queries = Registry()

NUMBER = r"[-+]?[0-9]*\.[0-9]+|[0-9]+"


@queries.add("extract_numbers", f"""
    SELECT doc_id, len(x) AS n, {sql_r('ln(1 + abs(coalesce(list_sum(x), 0)))')} AS size, x[1] AS first
    FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '{NUMBER}'), lambda v: v::DOUBLE) AS x FROM documents)
""")
def extract_numbers(spark, d):
    found = table(spark, d, "documents").select("doc_id", scoring.extract_numbers("text").alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return found.select("doc_id", F.size("x").cast("long").alias("n"), r(F.log(1 + F.abs(total))).alias("size"), F.get("x", F.lit(0)).alias("first"))


@queries.add("has_number", r"SELECT doc_id, regexp_matches(text, '[0-9]+(\.[0-9]+)?') AS has_number FROM documents")
def has_number(spark, d):
    return table(spark, d, "documents").select("doc_id", scoring.has_number("text").alias("has_number"))


ENTRIES = "(SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ', ' || p_brand || ' ,' || p_size ELSE p_name || ' ' || p_brand || '; ' || p_retailprice END AS entry FROM part)"


@queries.add("extract_values", f"""
    SELECT p_partkey, array_to_string(v, '|') AS v, CASE WHEN len(v) <> 3 THEN 'Input count is different from feature count (3): [' ||
        array_to_string(list_transform(v, lambda x: '"' || x || '"'), ',') || ']' END AS error
    FROM (SELECT p_partkey, CASE WHEN contains(entry, ',') THEN list_transform(string_split(entry, ','), lambda x: trim(x))
                 ELSE regexp_extract_all(entry, '[A-Za-z0-9_][A-Za-z0-9_\\-.]*') END AS v FROM {ENTRIES})
""")
def extract_values(spark, d):
    parts = F.concat_ws(" ", "p_name", F.concat("p_brand", F.lit(";")), F.col("p_retailprice").cast("string"))
    listed = F.concat("p_name", F.lit(", "), "p_brand", F.lit(" ,"), F.col("p_size").cast("string"))
    entry = F.when(F.col("p_partkey") % 3 == 0, listed).otherwise(parts)
    found = table(spark, d, "part").select("p_partkey", scoring.extract_values(entry).alias("v"))
    return found.select("p_partkey", F.array_join("v", "|").alias("v"), scoring.value_error(F.col("v"), 3).alias("error"))


@queries.add("coerce_to_schema", """
    SELECT o_orderkey, try_cast(o_custkey::VARCHAR AS DOUBLE) AS o_custkey, o_orderkey::VARCHAR AS o_orderstatus,
           try_cast(o_orderpriority AS DOUBLE) AS o_totalprice FROM orders
""")
def coerce_to_schema(spark, d):
    orders = table(spark, d, "orders")
    fields = [f for f in scoring.model_inputs(orders.schema) if f.name in ("o_custkey", "o_orderstatus", "o_totalprice")]
    given = orders.select("o_orderkey", F.array(
        F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), "o_orderpriority").alias("values"))
    return scoring.values_to_columns(given, "values", fields).drop("values")


def _questions(spark, d):
    """One question per event: some hold values, some give them in a list, some hold none."""
    e = events(spark, d)
    said = F.concat(F.lit("what about "), F.col("value").cast("string"), F.lit(" at "), F.col("hour").cast("string"), F.lit("?"))
    return e.select(
        F.col("event_id").alias("query_id"),
        F.when(F.col("event_id") % 5 == 0, "clustering").otherwise("classification").alias("task"),
        F.when(F.col("event_id") % 3 == 0, "no digits here").when(F.col("event_id") % 7 == 0, "just 12").otherwise(said).alias("question"),
        F.when(F.col("event_id") % 4 == 0, F.array(F.col("value").cast("string"), F.col("hour").cast("string"))).alias("given"))


ROUTE = """CASE WHEN event_id % 5 = 0 THEN 'retrieval' WHEN event_id % 4 = 0 THEN 'input' WHEN event_id % 3 = 0 THEN 'retrieval' ELSE 'numbers' END"""


@queries.add("answer_routing", f"SELECT event_id AS query_id, {ROUTE} AS route FROM events")
def answer_routing(spark, d):
    return route_questions(_questions(spark, d)).select("query_id", "route")


@queries.add("batch_predict", f"""
    SELECT event_id AS query_id, route, CASE WHEN route = 'input' OR (route = 'numbers' AND event_id % 7 <> 0) THEN predicted END AS prediction,
           CASE WHEN route = 'input' OR (route = 'numbers' AND event_id % 7 <> 0) THEN 'Success' WHEN route = 'numbers' THEN 'Not enough values for prediction.' END AS status
    FROM (SELECT event_id, predicted, {ROUTE} AS route FROM {PREDICTED})
""")
def batch_predict(spark, d):
    return predict_questions(_questions(spark, d), _bayes_model(spark, d))


def _bayes_model(spark, d):
    df = events(spark, d)
    data = tuning.prepare(df, "event_type", EVENT_FEATURES, key="event_id")
    fitted = tuning.full_model(data, tuning.single(GaussianBayes()).fit(data.frame))
    return SavedModel(fitted, "events", "Naive Bayes", 1, "event_type", "classification",
                      [f for f in df.schema if f.name in EVENT_FEATURES], data.labels, {})


@queries.add("question_run")
def question_run(spark, d):
    """Every user turn as a question over the documents, with hashed TF-IDF vectors on both sides."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    encoder = retrieval.text_encoder(docs)
    asked = table(spark, d, "conversations").where("role = 'user'").select(
        F.concat("conv_id", F.lit(":"), "turn").alias("query_id"), F.col("text").alias("question"), F.lit("clustering").alias("task"))
    found = answer_questions(retrieval.encode_text(encoder, asked, "question"), retrieval.encode_text(encoder, docs))
    conv_id, turn = (F.split_part("query_id", F.lit(":"), F.lit(i)).cast("long") for i in (1, 2))
    return found.select(conv_id.alias("conv_id"), turn.alias("turn"), "route", F.length("prompt").alias("n"))


# --- selection -----------------------------------------------------------------------------------


def _data(spark, d):
    data = tuning.prepare(flat_embeddings(spark, d), "label", EMBEDDED, key="vec_id")
    data.frame.persist()
    return data


@queries.add("cross_validated_auc")
def cross_validated_auc(spark, d):
    return tuning.cross_validated_score(tuning.scaled(L.logistic_regression()), _data(spark, d))


@queries.add("random_search")
def random_search(spark, d):
    return tuning.random_search(_data(spark, d)).trials


@queries.add("search_optimum", f"SELECT {tuning.SEARCH_DRAWS * tuning.SEARCH_FOLDS}::BIGINT AS models, {tuning.SEARCH_DRAWS * tuning.SEARCH_FOLDS}::BIGINT AS at_optimum, true AS few_passes")
def search_optimum(spark, d):
    """All strengths on all folds, fitted together: each one's gradient vanishes, in fewer passes than there are models."""
    data = _data(spark, d)
    rows = data.frame.where(~F.col("is_test")).withColumn("fold", F.col("fold") % tuning.SEARCH_FOLDS)
    strengths = [0.01 + 10.0 * i / tuning.SEARCH_DRAWS for i in range(tuning.SEARCH_DRAWS)]
    fits = fit_many(pack(rows), data.classes, strengths, tuning.SEARCH_FOLDS)
    largest = abs(fits.gradients).max(axis=(2, 3))
    return spark.createDataFrame([(largest.size, int((largest < 1e-4).sum()), fits.passes < largest.size)],
                                 "models long, at_optimum long, few_passes boolean")


@queries.add("model_selection")
def model_selection(spark, d):
    data = _data(spark, d)
    models = tuning.candidates("classification", tuning.random_search(data).estimator)
    return tuning.select_model(data, models).table.select("order", "model", "protocol", "score")


@queries.add("best_candidate", f"""
    SELECT l_shipmode AS model, {sql_r('s')} AS score FROM (SELECT l_linestatus || l_returnflag AS l_shipmode, avg(l_discount) AS s FROM lineitem GROUP BY 1)
    ORDER BY s DESC, l_shipmode LIMIT 1
""")
def best_candidate(spark, d):
    scored = table(spark, d, "lineitem").groupBy(F.concat("l_linestatus", "l_returnflag").alias("model")).agg(
        F.avg("l_discount").alias("score"))
    ordered = scored.withColumn("order", F.ascii("model") * 256 + F.ascii(F.substring("model", 2, 1)))
    return tuning.best_of(ordered).select("model", r("score").alias("score"))


@queries.add("classification_run")
def classification_run(spark, d):
    run = classify_table(flat_embeddings(spark, d), "Decision Tree", "label", "vec_id", ignore=("vec_id",), dataset="embeddings")
    return run.report


@queries.add("best_model_run")
def best_model_run(spark, d):
    """All candidates at the declared sizes; the best one is fitted on all rows."""
    return classify_table(flat_embeddings(spark, d), target="label", key="vec_id", ignore=("vec_id",), dataset="embeddings").report


@queries.add("text_classification_run")
def text_classification_run(spark, d):
    docs = table(spark, d, "documents", spread=True).select("text", F.col("lang").alias("label"))
    run = classify_table(docs, "Naive Bayes")
    return run.report.where("section = 'score' OR section = 'model'")


@queries.add("regression_run")
def regression_run(spark, d):
    orders = table(spark, d, "lineitem", spread=True).select("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return classify_table(orders, "Decision Tree", "l_extendedprice", mode="regression").report
