"""Row documents, vectors, search, prompts, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions.text import clean_answer
from tabulon.operators import retrieval as R
from tabulon.session import shared_path
from tabulon.sources.index import read_index, write_index
from tabulon.workload.common import Registry, r, sql_r, table

queries = Registry()


@queries.add("row_documents", """
    SELECT c_custkey::VARCHAR AS doc_id, 'row' AS kind,
           'c_custkey: ' || c_custkey || chr(10) || 'c_name: ' || c_name || chr(10) || 'c_nationkey: ' || c_nationkey || chr(10) ||
           'c_acctbal: ' || c_acctbal || chr(10) || 'c_mktsegment: ' || coalesce(nullif(c_mktsegment, 'BUILDING'), 'nan') AS text
    FROM customer
""")
def row_documents(spark, d):
    customer = table(spark, d, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return R.row_documents(customer, "c_custkey")


@queries.add("dataset_summary", """
    WITH h AS (SELECT * FROM part ORDER BY p_partkey LIMIT 2),
    c AS (SELECT p_partkey, p_partkey::VARCHAR AS a, p_name AS b, p_brand AS c, p_type AS e, p_size::VARCHAR AS f FROM h),
    w AS (SELECT greatest(10, max(length(a))) AS wa, greatest(6, max(length(b))) AS wb, greatest(7, max(length(c))) AS wc,
                 greatest(6, max(length(e))) AS we, greatest(7, max(length(f))) AS wf FROM c)
    SELECT 'This dataset appears to contain structured information.' || chr(10) || 'It has ' || (SELECT count(*) FROM part) ||
           ' rows and 5 columns.' || chr(10) || 'Here are the columns: p_partkey, p_name, p_brand, p_type, p_size' || chr(10) ||
           'Here are a few sample rows:' || chr(10) ||
           any_value(lpad('p_partkey', wa::INT, ' ') || ' ' || lpad('p_name', wb::INT, ' ') || ' ' || lpad('p_brand', wc::INT, ' ') || ' ' ||
               lpad('p_type', we::INT, ' ') || ' ' || lpad('p_size', wf::INT, ' ')) || chr(10) ||
           string_agg(lpad(a, wa::INT, ' ') || ' ' || lpad(b, wb::INT, ' ') || ' ' || lpad(c, wc::INT, ' ') || ' ' || lpad(e, we::INT, ' ') || ' ' ||
               lpad(f, wf::INT, ' '), chr(10) ORDER BY p_partkey) AS text
    FROM c, w
""")
def dataset_summary(spark, d):
    part = table(spark, d, "part").drop("p_retailprice")
    return R.dataset_summary(part, "p_partkey").select("text")


@queries.add("encode_documents")
def encode_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return R.encode_text(R.text_encoder(docs), docs).select(
        "doc_id", F.size("embedding").alias("width"),
        r(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 3).alias("norm"))


DISTANCES = """(SELECT a.vec_id AS query_id, b.vec_id AS doc_id,
    round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS distance
    FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a, (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) b)"""
HITS = f"""(SELECT query_id, doc_id, distance, (row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id))::INT AS rank
    FROM {DISTANCES} QUALIFY rank <= 4)"""


def _hits(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    return R.top_k_documents(vectors, vectors, query_key="vec_id", doc_key="vec_id")


@queries.add("nearest_documents", f"SELECT query_id, rank, doc_id, {sql_r('distance')} AS distance FROM {HITS}")
def nearest_documents(spark, d):
    return _hits(spark, d).select("query_id", "rank", "doc_id", r("distance").alias("distance"))


@queries.add("nearest_documents_blocks", f"SELECT query_id, rank, doc_id, {sql_r('distance')} AS distance FROM {HITS}")
def nearest_documents_blocks(spark, d):
    """The way for more queries than can be sent to every task."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    found = R.top_k_documents(vectors, vectors, query_key="vec_id", doc_key="vec_id", max_broadcast_bytes=0)
    return found.select("query_id", "rank", "doc_id", r("distance").alias("distance"))


CONTEXT = f"""(SELECT query_id, string_agg(text, chr(10) ORDER BY rank) AS context FROM {HITS} JOIN documents USING (doc_id) GROUP BY query_id)"""


def _contexts(spark, d):
    return R.contexts(_hits(spark, d), table(spark, d, "documents"))


@queries.add("context_assembly", f"SELECT query_id, md5(context) AS digest, length(context) AS n FROM {CONTEXT}")
def context_assembly(spark, d):
    return _contexts(spark, d).select("query_id", F.md5("context").alias("digest"), F.length("context").cast("long").alias("n"))


@queries.add("prompt_assembly", f"""
    SELECT conv_id AS query_id, md5('You are a helpful AI assistant. Use the context below to answer the user''s question.' || chr(10) || chr(10) ||
        'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question:' || chr(10) || question || chr(10) || chr(10) || 'Answer:') AS digest
    FROM (SELECT conv_id, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id)
    JOIN {CONTEXT} ON conv_id = query_id
""")
def prompt_assembly(spark, d):
    first = table(spark, d, "conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("query_id")).agg(
        F.min_by("text", "turn").alias("question"))
    # The check SQL wants only conversations that have a vector of their number; question_run asks every user turn.
    found = first.join(_contexts(spark, d), "query_id")
    return found.select("query_id", F.md5(R.prompt_text(F.col("context"), F.col("question"))).alias("digest"))


@queries.add("vector_index", """
    SELECT 'customer' AS dataset_id, c_custkey::VARCHAR AS doc_id, 16 AS width FROM customer
""")
def vector_index(spark, d):
    path = shared_path(spark, "index")
    # A dataset that is written twice is stored once.
    for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("customer", "c_custkey")):
        docs = R.row_documents(table(spark, d, name), key)
        write_index(R.encode_text(R.text_encoder(docs, size=16), docs), path, name)
    return read_index(spark, path, "customer").select("dataset_id", "doc_id", F.size("embedding").alias("width"))


@queries.add("index_snapshots", """
    SELECT 'before' AS seen, c_custkey::VARCHAR AS doc_id, 1024 AS width FROM customer
    UNION ALL SELECT 'after', s_suppkey::VARCHAR, 1024 FROM supplier
    UNION ALL SELECT 'beside', s_suppkey::VARCHAR, 1024 FROM supplier
""")
def index_snapshots(spark, d):
    """A dataset is written anew while a reader holds it: the reader keeps what it saw, the next one sees the new rows."""
    path = shared_path(spark, "index")
    # Encoding is heavy per row, and a scan may have fewer tasks with rows than there are cores.
    wide = 2 * spark.sparkContext.defaultParallelism
    docs = {name: R.row_documents(table(spark, d, name).repartition(wide), key) for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey"))}
    vectors = {name: R.encode_text(R.text_encoder(rows), rows) for name, rows in docs.items()}
    write_index(vectors["customer"], path, "people")
    write_index(vectors["supplier"], path, "others")
    before = read_index(spark, path, "people")
    write_index(vectors["supplier"], path, "people")
    parts = {"before": before, "after": read_index(spark, path, "people"), "beside": read_index(spark, path, "others")}
    shown = [found.select(F.lit(name).alias("seen"), "doc_id", F.size("embedding").alias("width")) for name, found in parts.items()]
    return shown[0].union(shown[1]).union(shown[2])


@queries.add("encoded_batches", """
    SELECT doc_id, length(text)::FLOAT AS characters, length(regexp_replace(text, '[^ ]', '', 'g'))::FLOAT AS blanks, (length(text) - length(replace(text, 'e', '')))::FLOAT AS es
    FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
""")
def encoded_batches(spark, d):
    """Any encoder of batches of texts; this one counts."""
    import numpy as np

    def encoder(texts):
        return np.array([[len(t), t.count(" "), t.count("e")] for t in texts])

    found = R.encode_with(table(spark, d, "documents").select("doc_id", "text"), encoder)
    return found.select("doc_id", *[F.col("embedding")[i].alias(c) for i, c in enumerate(("characters", "blanks", "es"))])


def prompt_sql(context: str, question: str) -> str:
    before, rest = R.PROMPT.replace("'", "''").split("{context}")
    between, after = rest.split("{question}")
    return f"'{before}' || {context} || '{between}' || {question} || '{after}'"


TURNS = "(SELECT conv_id, turn, text, (conv_id * 31 + turn) % 700 AS vec FROM (SELECT conv_id, turn, coalesce(text, '') AS text, role FROM conversations) WHERE role = 'user')"


@queries.add("prompt_every_turn", f"""
    SELECT conv_id, turn, md5({prompt_sql("coalesce(context, '')", "text")}) AS digest, context IS NOT NULL AS has_context
    FROM {TURNS} t LEFT JOIN {CONTEXT} c ON c.query_id = t.vec
""")
def prompt_every_turn(spark, d):
    """A prompt for every user turn. Turns take the hits of a vector by number; some numbers have none, and their prompts no context."""
    asked = table(spark, d, "conversations").where("role = 'user'").select(
        F.concat("conv_id", F.lit(":"), "turn").alias("query_id"), "conv_id", "turn", F.coalesce("text", F.lit("")).alias("question"),
        ((F.col("conv_id") * 31 + F.col("turn")) % 700).alias("vec"))
    found = asked.select("query_id", "vec").join(_contexts(spark, d).withColumnRenamed("query_id", "vec"), "vec").select("query_id", "context")
    written = R.prompts(asked, found)
    return asked.join(written, "query_id").join(found.select("query_id", F.lit(True).alias("_has")), "query_id", "left").select(
        "conv_id", "turn", F.md5("prompt").alias("digest"), F.coalesce("_has", F.lit(False)).alias("has_context"))


@queries.add("prompt_corpus", """
    SELECT 0 AS copy, event_id AS row_key, 'user_id: ' || user_id || chr(10) || 'event_type: ' || event_type AS text FROM events
""")
def prompt_corpus(spark, d):
    events = table(spark, d, "events").select(
        F.col("event_id").alias("ID"), F.col("ts").alias("Timestamp"), "user_id", "event_type")
    return R.prompt_corpus(events, "ID")


@queries.add("prompt_corpus_small", """
    SELECT copy::INT AS copy, r_regionkey AS row_key, 'r_regionkey: ' || r_regionkey || chr(10) || 'r_name: ' || r_name AS text
    FROM region, (SELECT unnest(range(0, 3)) AS copy) ORDER BY copy, r_regionkey LIMIT 10
""")
def prompt_corpus_small(spark, d):
    return R.prompt_corpus(table(spark, d, "region"), "r_regionkey")


# RE2 has no back-references: the check splits a text into words and single other characters and drops a
# word of 3 to 20 characters, with the blank before it, where the word before that blank is the same.
ANSWERS = """(SELECT conv_id, turn, text || '  ' || text || 'x' || turn || ' word word word' || chr(10) || chr(10) || chr(10) || 'endHere' AS t FROM conversations)"""
PIECES = f"(SELECT conv_id, turn, regexp_extract_all(t, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_]') AS p FROM {ANSWERS})"
KEPT = """list_filter(p, lambda x, i: NOT (
    (i > 2 AND regexp_full_match(x, '[\\p{L}\\p{M}\\p{N}_]{3,20}') AND p[i - 1] = ' ' AND p[i - 2] = x)
    OR (i > 1 AND x = ' ' AND i < len(p) AND regexp_full_match(p[i - 1], '[\\p{L}\\p{M}\\p{N}_]{3,20}') AND p[i - 1] = p[i + 1])))"""
CLEANED = f"""(SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(array_to_string({KEPT}, ''),
    '([a-z])([A-Z])', '\\1 \\2', 'g'), '([a-zA-Z])([0-9])', '\\1 \\2', 'g'), ' +', ' ', 'g'), '\\n{{2,}}', chr(10) || chr(10), 'g') AS c FROM {PIECES})"""


@queries.add("answer_cleanup", f"SELECT conv_id, turn, md5(trim(c)) AS digest, length(trim(c)) AS n FROM {CLEANED}")
def answer_cleanup(spark, d):
    text = F.concat("text", F.lit("  "), "text", F.lit("x"), F.col("turn").cast("string"),
                    F.lit(" word word word\n\n\nendHere"))
    found = table(spark, d, "conversations").select("conv_id", "turn", clean_answer(text).alias("c"))
    return found.select("conv_id", "turn", F.md5("c").alias("digest"), F.length("c").cast("long").alias("n"))
