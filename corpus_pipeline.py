"""From raw documents to token ids: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents, the last one token ids.
`run` writes each stage's result as Parquet to the shared folder and gives the reread table to the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.bpe import encode_texts, read_ranks
from tabulon.llm.decontaminate import benchmark_hits
from tabulon.llm.jaccard_regions import near_duplicates
from tabulon.llm.language_crf import UNKNOWN, fit_languages, label_languages
from tabulon.llm.line_spread import remove_spread_lines
from tabulon.llm.queries import contaminated, held_out
from tabulon.session import shared_path

#: Documents whose best language has a lower mean marginal are no language's text.
MIN_SCORE = 0.35
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those that are no learned language, go. Without any learned language all stay."""
    model = fit_languages(docs.filter(~held_out()))
    if not model.languages:
        return docs.select(*COLUMNS)
    labelled = label_languages(docs.select(*COLUMNS), model, keep_text=True)
    return labelled.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that spread over many sites stay only where they stand first. Documents left without any text of their own go."""
    kept = remove_spread_lines(docs.select(*COLUMNS))
    return kept.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\S")) \
        .withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text")).cast("long")).select(*COLUMNS)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group stays; rows that repeat it in id and text are one document."""
    found = near_duplicates(docs.select("doc_id", "text"))
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover one word in twenty or more go."""
    marked = benchmark_hits(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))
    return marked.filter(~contaminated()).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as little-endian unsigned 32-bit integers, their number, and whether they decode to the text's bytes."""
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    both = encode_texts(rows, ranks, public_tokenizers.PATTERN, decoded="decoded")
    return both.select("doc_id", "lang", "source", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "text_sha256",
                       (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicate_groups),
    ("decontaminate", decontaminate),
    ("encode", encode),
]
#: The first stage is a fitted model, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
