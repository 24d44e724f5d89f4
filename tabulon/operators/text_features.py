"""Term counts, vocabulary, TF-IDF, chi-squared selection, and text columns as feature arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer, VectorSlicer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.text import sql_tokens, tokens
from tabulon.operators.ordered import with_position
from tabulon.session import cut_lineage

TOP_FEATURES = 100
MAX_BROADCAST_BYTES = 64 << 20


def document_tokens(df: DataFrame, key: str, text: str, *extra: str) -> DataFrame:
    """(key, tokens) of normalised text; a missing text has no token."""
    words = tokens(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return df.select(key, *extra, words.alias("tokens"))


def bag_of_words(docs: DataFrame, key: str, *extra: str) -> DataFrame:
    """(key, term, n, n_tokens). A document is one row, so its terms are counted inside the row: no shuffle.

    In the sorted tokens every term is one run; the run starts give the counts.
    """
    # No filter on empty documents: it would be pushed below the sort and repeat it.
    size = F.size("sorted")
    ordered = docs.select(key, *extra, F.sort_array("tokens").alias("sorted"))
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(
        places, lambda i: (i == 0) | (F.get(F.col("sorted"), i - 1) != F.get(F.col("sorted"), i)))
    marked = ordered.withColumn("starts", starts)
    runs = F.transform(
        F.col("starts"),
        lambda start, i: F.struct(
            F.get(F.col("sorted"), start).alias("term"),
            (F.coalesce(F.get(F.col("starts"), i + 1), size) - start).cast("long").alias("n"),
        ),
    )
    return marked.select(key, *extra, size.cast("long").alias("n_tokens"), F.inline(runs)).select(
        key, *extra, "term", "n", "n_tokens"
    )


def vocabulary(docs: DataFrame, key: str) -> DataFrame:
    """(term, term_index): terms numbered by first appearance, in the order of the key and the position.

    The distinct tokens of a document keep their order, so their places order first appearances as well.
    """
    places = docs.select(key, F.posexplode(F.array_distinct("tokens")).alias("pos", "term"))
    first = places.groupBy("term").agg(F.min(F.struct(key, "pos")).alias("first")).select("term", "first.*")
    return with_position(first, [], [key, "pos"], "term_index").select("term", "term_index")


def document_frequency(docs: DataFrame) -> DataFrame:
    """(term, df). A document is one row, so its distinct terms are found inside the row."""
    terms = docs.select(F.explode(F.array_distinct("tokens")).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def inverse_frequency(df: Column, documents) -> Column:
    return F.log((documents + 1) / (df + 1)) + 1


def tfidf(docs: DataFrame, key: str) -> DataFrame:
    """(key, term, tf, tfidf) with tf = n / tokens and idf = ln((N + 1) / (df + 1)) + 1.

    The document frequencies are written once; their measured size decides how they meet the postings.
    """
    documents = docs.agg(F.count(F.lit(1))).scalar()
    frequencies = cut_lineage(
        document_frequency(docs).select("term", inverse_frequency(F.col("df"), documents).alias("idf")))
    tf = F.col("n") / F.col("n_tokens")
    bag = bag_of_words(docs, key)
    size = frequencies.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).head()[0]
    if size <= MAX_BROADCAST_BYTES:
        joined = bag.join(F.broadcast(frequencies), "term")
    else:
        # A frequent term's postings are split over tasks by the adaptive skew join.
        joined = bag.hint("merge").join(frequencies, "term")
    return joined.select(key, "term", tf.alias("tf"), (tf * F.col("idf")).alias("tfidf"))


def chi2_scores(docs: DataFrame, key: str, label: str) -> DataFrame:
    """(term, df, idf, chi2) of the TF-IDF weights against the label.

    With observed sums O per class and a feature total T, expected counts are share * T and add up to T,
    so the statistic is sum(O^2 / share) / T - T: classes in which a term is absent need no rows.
    One shuffle of (term, label) sums; idf is constant per term and is applied afterwards.
    """
    classes = docs.groupBy(label).agg(F.count(F.lit(1)).alias("class_n"))
    documents = classes.agg(F.sum("class_n")).scalar()
    # One row per class.
    shares = classes.select(label, (F.col("class_n") / documents).alias("share"))
    per_class = bag_of_words(docs, key, label).groupBy("term", label).agg(
        F.sum(F.col("n") / F.col("n_tokens")).alias("tf_sum"), F.count(F.lit(1)).alias("df_part")
    )
    per_term = per_class.join(F.broadcast(shares), label).groupBy("term").agg(
        F.sum("df_part").alias("df"),
        F.sum("tf_sum").alias("total"),
        F.sum(F.col("tf_sum") * F.col("tf_sum") / F.col("share")).alias("weighted"),
    )
    scored = per_term.withColumn("idf", inverse_frequency(F.col("df"), documents))
    return scored.select(
        "term", "df", "idf",
        (F.col("idf") * (F.col("weighted") / F.col("total") - F.col("total"))).alias("chi2"),
    )


def top_features(scores: DataFrame, k: int = TOP_FEATURES) -> DataFrame:
    """The k best terms; equal scores go by term."""
    return scores.orderBy(F.round("chi2", 9).desc(), "term").limit(k)


def chi2_of_columns(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(column_name, chi2) for non-negative numeric columns of a wide table."""
    classes = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("class_n"), *[F.sum(F.col(c).cast("double")).alias(c) for c in columns]
    )
    documents = classes.agg(F.sum("class_n")).scalar()
    long = classes.unpivot([label, "class_n"], list(columns), "column_name", "observed")
    total = F.sum("observed")
    weighted = F.sum(F.col("observed") * F.col("observed") / (F.col("class_n") / documents))
    return long.groupBy("column_name").agg((weighted / total - total).alias("chi2"))


def text_feature_stages(df: DataFrame, columns: Sequence[str], key: str, label: str, k: int = TOP_FEATURES,
                        prefix: str = "_text") -> tuple[list, list[str], dict[str, list[str]]]:
    """Transformers that turn each text column into one vector of its k best terms' TF-IDF weights.

    Only the k terms and their idf (a bounded table) come to the driver. All stages are built-in
    transformers, so they are saved and loaded together with the model. All other tokens share one
    placeholder slot, so that an L1 norm divides every count by the number of tokens.
    """
    stages, outputs, terms = [], [], {}
    for i, c in enumerate(columns):
        docs = document_tokens(df, key, c, label)
        best = top_features(chi2_scores(docs, key, label), k).select("term", "idf").collect()
        if not best:
            continue
        terms[c] = [r["term"] for r in best]
        words, counts, shares, weights, out = (
            f"{prefix}_{i}_{part}" for part in ("words", "counts", "shares", "weights", "tfidf")
        )
        kept = ", ".join(f"'{t}'" for t in terms[c])
        every = sql_tokens(f"coalesce(cast(`{c}` AS string), '')")
        stages += [
            SQLTransformer(statement=f"SELECT *, transform({every}, t -> IF(t IN ({kept}), t, '')) AS {words} FROM __THIS__"),
            CountVectorizerModel.from_vocabulary([*terms[c], ""], inputCol=words, outputCol=counts),
            Normalizer(p=1.0, inputCol=counts, outputCol=shares),
            ElementwiseProduct(inputCol=shares, outputCol=weights,
                               scalingVec=Vectors.dense([*[r["idf"] for r in best], 0.0])),
            VectorSlicer(inputCol=weights, outputCol=out, indices=list(range(len(best)))),
        ]
        outputs.append(out)
    return stages, outputs, terms
