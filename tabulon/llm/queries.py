"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tabulon.llm.bpe import encode_texts, read_ranks, token_digests
from tabulon.llm.chat_repair import repair_roles
from tabulon.llm.decontaminate import benchmark_hits
from tabulon.llm.fingerprints import edited_fingerprints, entropy_histogram, rarity_ranks
from tabulon.llm.jaccard_regions import near_duplicates
from tabulon.llm.language_crf import fit_languages, label_languages
from tabulon.llm.lexical_search import ranked_search
from tabulon.llm.line_spread import MIN_SITES, remove_spread_lines
from tabulon.llm.secret_scan import find_secrets, spans_text
from tabulon.llm.sharding import shard_by_bytes, text_size
from tabulon.llm.simhash_pivots import simhash_groups
from tabulon.llm.source_audit import source_divergence
from tabulon.llm.suffix_repeats import repeated_spans
from tabulon.workload.common import Registry, table

queries = Registry()
SHARDS = 24


@queries.add("op1_sampled_splitters")
def op1_sampled_splitters(spark, d):
    docs = table(spark, d, "documents")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", text_size("text").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                        F.xxhash64(text).alias("same_text"))
    placed = shard_by_bytes(sized, SHARDS, "size", F.col("same_text"), "doc_id")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@queries.add("op2_randomness_battery")
def op2_randomness_battery(spark, d):
    found = find_secrets(table(spark, d, "documents").select("doc_id", "text"))
    number = lambda kind: F.size(F.filter("base_spans", lambda s: s.kind == kind)).cast("long")
    return found.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
                        F.sha2(spans_text("base_spans"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


@queries.add("op3_improbable_features")
def op3_improbable_features(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = edited_fingerprints(docs, rarity_ranks(entropy_histogram(docs)))
    return found.select("doc_id", "n_chars", F.col("edited").alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                        "near_edited", "near_next")


@queries.add("op4_bucket_refinement")
def op4_bucket_refinement(spark, d):
    found = repeated_spans(table(spark, d, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.begin)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@queries.add("op5_wu_manber", f"""
    WITH pattern AS (
        SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM (
            SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM (
                SELECT item_id, w, least(13, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)) WHERE k > 0)),
    doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    occurrence AS (
        SELECT doc_id, item_id, i, k FROM (
            SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM (
                SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
                FROM doc, (SELECT DISTINCT k FROM pattern))) JOIN pattern USING (k, s)),
    hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (
        SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS j FROM occurrence) GROUP BY doc_id),
    item AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (
        SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM occurrence) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
    FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
""")
def op5_wu_manber(spark, d):
    found = benchmark_hits(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def held_out():
    """Rows that no model may learn from. A null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


@queries.add("op6_chain_field")
def op6_chain_field(spark, d):
    docs = table(spark, d, "documents")
    model = fit_languages(docs.filter(~held_out()))
    return label_languages(docs.select("doc_id", held_out().alias("held_out"), "text"), model)


_SHINGLES = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""


@queries.add("op7_metric_regions", f"""
    WITH RECURSIVE word AS (SELECT doc_id, {_SHINGLES} AS w FROM documents),
    shingle AS (
        SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (
            SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM word WHERE len(w) > 0)),
    size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
    pair AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    link AS (SELECT x, y FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
    reach AS (SELECT doc_id, doc_id AS other FROM word UNION SELECT reach.doc_id, y FROM reach JOIN link ON x = other)
    SELECT doc_id, any_value(coalesce(n, 0)) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN size USING (doc_id) GROUP BY doc_id
""")
def op7_metric_regions(spark, d):
    return near_duplicates(table(spark, d, "documents").select("doc_id", "text"))


@queries.add("op8_role_repair")
def op8_role_repair(spark, d):
    return repair_roles(table(spark, d, "conversations"))


@queries.add("op9_backtracking_bpe")
def op9_backtracking_bpe(spark, d):
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    return token_digests(encode_texts(docs, ranks, public_tokenizers.PATTERN, decoded="decoded"))


@queries.add("op10_site_spread", f"""
    WITH line AS (
        SELECT doc_id, generate_subscripts(l, 1) AS number, unnest(l) AS raw, source FROM (
            SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
    spread AS (
        SELECT trim(raw) AS t, min((doc_id, number)) AS first FROM line WHERE trim(raw) <> ''
        GROUP BY 1 HAVING count(DISTINCT coalesce('s' || source, 'n')) >= {MIN_SITES}),
    mark AS (SELECT line.*, spread.t IS NOT NULL AND (doc_id, number) <> spread.first AS out
             FROM line LEFT JOIN spread ON trim(raw) = spread.t)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (out) AS n_removed,
           md5(coalesce(string_agg(raw, chr(10) ORDER BY number) FILTER (NOT out), '')) AS kept_md5
    FROM mark GROUP BY doc_id
    UNION ALL SELECT doc_id, 0, 0, md5('') FROM documents WHERE text IS NULL
""")
def op10_site_spread(spark, d):
    kept = remove_spread_lines(table(spark, d, "documents").select("doc_id", "text", "source"))
    return kept.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


_TERMS = r"""regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"""


@queries.add("op11_count_cells", f"""
    WITH doc AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
    word AS (SELECT id, lang, source, unnest({_TERMS}) AS term FROM doc),
    kept AS (SELECT lang, term, count(*) AS n FROM word GROUP BY ALL HAVING count(DISTINCT id) >= 10),
    size AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
    own AS (SELECT lang, source, term, count(*) AS n FROM word JOIN kept USING (lang, term) GROUP BY ALL),
    total AS (SELECT lang, source, sum(n) AS total FROM own GROUP BY ALL),
    grp AS (SELECT DISTINCT lang, source FROM doc),
    share AS (
        SELECT lang, source, term, coalesce(own.n, 0) AS n,
               1 + 1000000000::HUGEINT * (coalesce(own.n, 0) + 2) // (coalesce(total.total, 0) + 2 * v) AS p,
               1 + 1000000000::HUGEINT * (kept.n + 2) // (size.total + 2 * v) AS q
        FROM grp JOIN kept USING (lang) JOIN size USING (lang) LEFT JOIN own USING (lang, source, term) LEFT JOIN total USING (lang, source)),
    pair AS (
        SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
        FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL)
    SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM (
        SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
        FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source)
    UNION ALL
    SELECT * FROM (
        SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value,
               row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // (p + q) DESC, term)::INTEGER AS rank
        FROM share WHERE n > 0 AND p > q) WHERE rank <= 10
""")
def op11_count_cells(spark, d):
    return source_divergence(table(spark, d, "documents").select("text", "lang", "source"))


@queries.add("op12_pivot_tables")
def op12_pivot_tables(spark, d):
    return simhash_groups(table(spark, d, "documents").select("doc_id", "text"))


_SEARCH_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


@queries.add("op13_block_max", f"""
    WITH word AS (SELECT doc_id, row, unnest(w) AS term FROM (SELECT doc_id, row_number() OVER () AS row, {_SEARCH_TERMS} AS w FROM documents)),
    size AS (SELECT row, any_value(doc_id) AS doc_id, count(*) AS n FROM word GROUP BY row),
    whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM size),
    posting AS (SELECT row, term, count(*) AS tf FROM word GROUP BY ALL),
    query AS (SELECT DISTINCT item, item_id, term FROM (
        SELECT item, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS item, item_id, {_SEARCH_TERMS} AS w FROM benchmark))),
    weight AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM posting, whole GROUP BY term),
    scored AS (
        SELECT item, item_id, doc_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
        FROM query JOIN weight USING (term) JOIN posting USING (term) JOIN size USING (row), whole GROUP BY ALL)
    SELECT item_id, rank, doc_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0) WHERE rank <= 50
""")
def op13_block_max(spark, d):
    return ranked_search(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))
