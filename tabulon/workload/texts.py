"""Text normalising, terms, weights and term selection."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabulon.functions.text import normalise
from tabulon.functions.vectors import array_sum
from tabulon.operators import text_features as X
from tabulon.workload.common import Registry, r, sql_r, table

queries = Registry()

SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NORMAL = f"regexp_replace(lower(coalesce(text, '')), '[^a-z0-9{SPACE}]', '', 'g')"
TOKENS = f"list_filter(regexp_split_to_array({NORMAL}, '[{SPACE}]+'), lambda t: t <> '')"
BAG = f"""(SELECT doc_id, term, count(*) AS n, any_value(n_tokens) AS n_tokens FROM
    (SELECT doc_id, unnest(t) AS term, len(t) AS n_tokens FROM (SELECT doc_id, {TOKENS} AS t FROM documents)) GROUP BY doc_id, term)"""
IDF = "ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1"


def _docs(spark, d, *extra):
    return X.document_tokens(table(spark, d, "documents", spread=True), "doc_id", "text", *extra)


@queries.add("text_normalise", f"SELECT doc_id, md5({NORMAL}) AS digest, length({NORMAL}) AS n FROM documents")
def text_normalise(spark, d):
    clean = normalise(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents", spread=True).select("doc_id", F.md5(clean).alias("digest"), F.length(clean).cast("long").alias("n"))


@queries.add("text_tokens", f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, '|')) AS digest FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def text_tokens(spark, d):
    return _docs(spark, d).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"),
                                  F.md5(F.array_join("tokens", "|")).alias("digest"))


@queries.add("vocabulary", f"""
    SELECT term, row_number() OVER (ORDER BY first_doc, first_pos) - 1 AS term_index FROM (
        SELECT term, min(doc_id) AS first_doc, arg_min(pos, (doc_id, pos)) AS first_pos FROM (
            SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, {TOKENS} AS t FROM documents))
        GROUP BY term)
""")
def vocabulary(spark, d):
    return X.vocabulary(_docs(spark, d), "doc_id")


@queries.add("document_frequency", f"SELECT term, count(*) AS df FROM {BAG} GROUP BY term")
def document_frequency(spark, d):
    return X.document_frequency(_docs(spark, d))


@queries.add("bag_of_words", f"SELECT doc_id, term, n FROM {BAG}")
def bag_of_words(spark, d):
    return X.bag_of_words(_docs(spark, d), "doc_id").select("doc_id", "term", "n")


@queries.add("tfidf", f"""
    SELECT doc_id, term, {sql_r('n / n_tokens')} AS tf, {sql_r(f'n / n_tokens * ({IDF})')} AS tfidf
    FROM {BAG} b JOIN (SELECT term, count(*) AS df FROM {BAG} GROUP BY term) USING (term)
""")
def tfidf(spark, d):
    return X.tfidf(_docs(spark, d), "doc_id").select("doc_id", "term", r("tf").alias("tf"), r("tfidf").alias("tfidf"))


LABELLED_BAG = f"""(SELECT doc_id, lang AS label, term, count(*) AS n, any_value(n_tokens) AS n_tokens FROM
    (SELECT doc_id, lang, unnest(t) AS term, len(t) AS n_tokens FROM (SELECT doc_id, lang, {TOKENS} AS t FROM documents))
    GROUP BY doc_id, lang, term)"""
CHI2 = f"""(
    WITH b AS {LABELLED_BAG},
    k AS (SELECT lang AS label, count(*) / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY 1),
    f AS (SELECT term, count(*) AS df, sum(n / n_tokens) AS total FROM b GROUP BY term),
    o AS (SELECT term, label, sum(n / n_tokens) AS observed FROM b GROUP BY ALL),
    e AS (SELECT f.term, f.df, ({IDF}) AS idf, k.share * f.total AS expected, coalesce(o.observed, 0) AS observed
          FROM f CROSS JOIN k LEFT JOIN o ON o.term = f.term AND o.label = k.label)
    SELECT term, any_value(df) AS df, any_value(idf) AS idf, any_value(idf) * sum((observed - expected) ** 2 / expected) AS chi2
    FROM e GROUP BY term)"""


@queries.add("chi2_scores", f"SELECT term, df, {sql_r('idf')} AS idf, {sql_r('chi2')} AS chi2 FROM {CHI2}")
def chi2_scores(spark, d):
    found = X.chi2_scores(_docs(spark, d, "lang"), "doc_id", "lang")
    return found.select("term", "df", r("idf").alias("idf"), r("chi2").alias("chi2"))


@queries.add("chi2_top_terms", f"""
    SELECT term, {sql_r('chi2', 5)} AS chi2 FROM {CHI2} ORDER BY round(chi2, 9) DESC, term LIMIT 100
""")
def chi2_top_terms(spark, d):
    found = X.top_features(X.chi2_scores(_docs(spark, d, "lang"), "doc_id", "lang"))
    return found.select("term", r("chi2", 5).alias("chi2"))


@queries.add("chi2_columns", " UNION ALL ".join(f"""
    SELECT '{c}' AS column_name, {sql_r('sum((observed - expected) ** 2 / expected)', 4)} AS chi2 FROM (
        SELECT sum({c}) AS observed, count(*) / (SELECT count(*) FROM lineitem) * (SELECT sum({c}) FROM lineitem) AS expected
        FROM lineitem GROUP BY l_returnflag)""" for c in ("l_quantity", "l_linenumber", "l_discount")))
def chi2_columns(spark, d):
    found = X.chi2_of_columns(table(spark, d, "lineitem"), ["l_quantity", "l_linenumber", "l_discount"], "l_returnflag")
    return found.select("column_name", r("chi2", 4).alias("chi2"))


@queries.add("text_feature_vectors", f"""
    WITH best AS (SELECT term, idf FROM {CHI2} ORDER BY round(chi2, 9) DESC, term LIMIT 100)
    SELECT d.doc_id, {sql_r('coalesce(w, 0)')} AS weight, 100::BIGINT AS width FROM documents d LEFT JOIN
        (SELECT doc_id, sum(n / n_tokens * idf) AS w FROM {BAG} JOIN best USING (term) GROUP BY doc_id) USING (doc_id)
""")
def text_feature_vectors(spark, d):
    docs = table(spark, d, "documents", spread=True)
    stages, (out,), _ = X.text_feature_stages(docs, ["text"], "doc_id", "lang")
    found = Pipeline(stages=stages).fit(docs).transform(docs).select("doc_id", vector_to_array(out).alias("v"))
    return found.select("doc_id", r(array_sum("v")).alias("weight"), F.size("v").cast("long").alias("width"))
