"""Column profiles and role rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import profile as P
from tabulon.workload.common import Registry, r, sql_r, table

queries = Registry()


def _roles_sql(source: str, columns: dict[str, str]) -> str:
    """Roles of the columns by exact counts; the columns' kinds are given."""
    parts = []
    for c, kind in columns.items():
        long = f"avg(length({c})) <= 100 AND NOT bool_or(regexp_matches({c}, 'http|www|#|@'))" if kind == "string" else "true"
        parts.append(f"""SELECT '{source}' AS source, '{c}' AS column_name, count(DISTINCT {c}) > 0.8 * count(*) AND {long} AS is_id,
            count(DISTINCT {c}) < 0.05 * count(*) AS is_low_cardinality, (SELECT max(n) FROM (SELECT count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c})) > 0.5 * count({c}) AS has_majority
            FROM {source}""")
    return " UNION ALL ".join(parts)


ROLE_TABLES = {
    "customer": {"c_custkey": "number", "c_name": "string", "c_nationkey": "number", "c_acctbal": "number", "c_mktsegment": "string"},
    "orders": {"o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "string", "o_totalprice": "number", "o_orderpriority": "string"},
    "events": {"event_id": "number", "user_id": "number", "event_type": "string", "value": "number", "props": "string"},
    "documents": {"doc_id": "number", "text": "string", "lang": "string", "source": "string", "n_chars": "number"},
}


@queries.add("roles_by_sketch", " UNION ALL ".join(_roles_sql(t, c) for t, c in ROLE_TABLES.items()))
def roles_by_sketch(spark, d):
    """Roles from sketches, with exact counts only where a rule's border is near."""
    out = None
    for name, columns in ROLE_TABLES.items():
        found = P.role_profile(table(spark, d, name).select(*columns)).select(
            F.lit(name).alias("source"), "column_name", "is_id", "is_low_cardinality", (F.col("top_share") > P.TOP_SHARE).alias("has_majority"))
        out = found if out is None else out.union(found)
    return out

MARKS = "http|www|#|@"


def profile_sql(source: str, columns: list[tuple[str, str]]) -> str:
    """Plain SQL for the profile of a table, one branch per column."""
    parts = []
    for pos, (c, kind) in enumerate(columns):
        text = kind == "string"
        parts.append(f"""
        SELECT '{c}' AS column_name, {pos} AS position, '{kind}' AS kind, count(*) AS n_rows, count({c}) AS n_present,
               count(DISTINCT {c}) AS n_distinct,
               (SELECT max(n) FROM (SELECT count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c})) AS top_count,
               {f"avg(length({c}::VARCHAR))" if text else "NULL::DOUBLE"} AS mean_length,
               {f"coalesce(bool_or(regexp_matches({c}::VARCHAR, '{MARKS}')), false)" if text else "false"} AS has_address_mark,
               {f"avg(len(list_filter(regexp_split_to_array(coalesce({c}::VARCHAR, ''), '[\\s]+'), lambda x: x <> '')))"
                if text else f"avg(CASE WHEN {c} IS NULL THEN 0.0 ELSE 1.0 END)"} AS mean_words
        FROM {source}""")
    return f"""SELECT *, n_distinct < n_rows * 0.05 AS is_low_cardinality, mean_words > 2 AS is_text,
        CASE WHEN kind = 'numeric' THEN n_distinct > n_rows * 0.8
             WHEN kind = 'string' THEN n_distinct > n_rows * 0.8 AND coalesce(mean_length, 0) <= 100 AND NOT has_address_mark
             ELSE false END AS is_id,
        top_count / n_present AS top_share
        FROM ({' UNION ALL '.join(parts)})"""


def shown(sql: str) -> str:
    return f"""SELECT column_name, position, kind, n_rows, n_present, n_distinct, top_count, {sql_r('mean_length')} AS mean_length,
        has_address_mark, {sql_r('mean_words')} AS mean_words, is_low_cardinality, is_text, is_id,
        {sql_r('top_share')} AS top_share FROM ({sql})"""


def show(profile):
    return profile.select(
        "column_name", "position", "kind", "n_rows", "n_present", "n_distinct", "top_count", r("mean_length").alias("mean_length"),
        "has_address_mark", r("mean_words").alias("mean_words"), "is_low_cardinality", "is_text", "is_id",
        r("top_share").alias("top_share"))


CUSTOMER = [("c_custkey", "numeric"), ("c_name", "string"), ("c_nationkey", "numeric"), ("c_acctbal", "numeric"),
            ("c_mktsegment", "string")]
PAGES = [("page_id", "numeric"), ("url", "string"), ("html", "string")]
DOCUMENTS = [("doc_id", "numeric"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "numeric")]
LABELS = [("doc_id", "numeric"), ("quality", "numeric"), ("toxic", "numeric")]


@queries.add("profile_customer", shown(profile_sql("customer", CUSTOMER)))
def profile_customer(spark, d):
    return show(P.column_profile(table(spark, d, "customer")))


@queries.add("profile_pages", shown(profile_sql("pages", PAGES)))
def profile_pages(spark, d):
    return show(P.column_profile(table(spark, d, "pages")))


@queries.add("numeric_statistics", " UNION ALL ".join(f"""
    SELECT '{c}' AS column_name, {sql_r(f'avg({c})', 4)} AS mean, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM lineitem"""
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")))
def numeric_statistics(spark, d):
    found = P.numeric_statistics(
        table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"])
    return found.select("column_name", r("mean", 4).alias("mean"), "min", "max")


@queries.add("value_distribution", f"""
    SELECT o_orderpriority AS value, count(*) AS n, {sql_r('count(*) / (SELECT count(o_orderpriority) FROM orders)')} AS share
    FROM orders GROUP BY 1
""")
def value_distribution(spark, d):
    return P.value_distribution(table(spark, d, "orders"), "o_orderpriority").select("value", "n", r("share").alias("share"))


ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@queries.add("distinct_counts", " UNION ALL ".join(f"""
    SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct,
           (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY {c})) AS top_count FROM orders""" for c in ORDER_COLUMNS))
def distinct_counts(spark, d):
    return P.distinct_counts(table(spark, d, "orders"), list(ORDER_COLUMNS)).select("column_name", "n_distinct", "top_count")


@queries.add("id_columns", f"""
    SELECT 'customer' AS source, column_name FROM ({profile_sql('customer', CUSTOMER)}) WHERE is_id
    UNION ALL SELECT 'pages', column_name FROM ({profile_sql('pages', PAGES)}) WHERE is_id
    UNION ALL SELECT 'documents', column_name FROM ({profile_sql('documents', DOCUMENTS)}) WHERE is_id
""")
def id_columns(spark, d):
    out = None
    for name in ("customer", "pages", "documents"):
        found = P.id_columns(P.column_profile(table(spark, d, name))).select(F.lit(name).alias("source"), "column_name")
        out = found if out is None else out.unionByName(found)
    return out


@queries.add("text_columns", f"SELECT position, column_name FROM ({profile_sql('documents', DOCUMENTS)}) WHERE is_text AND column_name <> 'lang'")
def text_columns(spark, d):
    return P.text_columns(P.column_profile(table(spark, d, "documents")), "lang")


@queries.add("text_dataset", f"""
    SELECT count(*) FILTER (is_text) > 0 AND count(*) FILTER (is_text) / count(*) > 0.6 AS is_text_data,
           coalesce(string_agg(column_name, ',' ORDER BY position) FILTER (is_text), '') AS text_columns
    FROM ({profile_sql('documents', [c for c in DOCUMENTS if c[0] in ('text', 'lang')])}) WHERE column_name <> 'lang'
""")
def text_dataset(spark, d):
    found = P.text_dataset(P.column_profile(table(spark, d, "documents").select("text", "lang")), "lang")
    return found.select("is_text_data", F.array_join("text_columns", ",").alias("text_columns"))


def rule_sql(name: str, source: str, columns: list[tuple[str, str]]) -> str:
    """The ordered target rules as plain SQL over a profile."""
    return f"""SELECT '{name}' AS source, unnest([struct_pack(rule := rule, candidates := array_to_string(names, ','))], recursive := true) FROM (
        SELECT CASE WHEN len(a) > 0 THEN 'name' WHEN len(b) > 0 THEN 'categorical' WHEN len(c) = 1 THEN 'low_cardinality'
                    WHEN len(e) > 0 THEN 'imbalanced' WHEN len(f) = 1 THEN 'text' ELSE 'none' END AS rule,
               CASE WHEN len(a) > 0 THEN a[1:1] WHEN len(b) > 0 THEN b WHEN len(c) = 1 THEN c
                    WHEN len(e) > 0 THEN e[1:1] WHEN len(f) = 1 THEN f ELSE []::VARCHAR[] END AS names
        FROM (SELECT
            coalesce(list(column_name ORDER BY position) FILTER (lower(column_name) IN ('target','label','class','output','result','y')), []) AS a,
            coalesce(list(column_name ORDER BY position) FILTER (kind <> 'numeric'), []) AS b,
            coalesce(list(column_name ORDER BY position) FILTER (is_low_cardinality), []) AS c,
            coalesce(list(column_name ORDER BY position) FILTER ((kind = 'string' OR n_distinct < 10) AND top_share > 0.5), []) AS e,
            coalesce(list(column_name ORDER BY position) FILTER (is_text), []) AS f
        FROM ({profile_sql(source, columns)})))"""


PART_NUMBERS = [("p_partkey", "numeric"), ("p_size", "numeric"), ("p_retailprice", "numeric")]
EMBEDDING_LABELS = [("vec_id", "numeric"), ("label", "numeric")]


@queries.add("target_candidates", " UNION ALL ".join([
    rule_sql("customer", "customer", CUSTOMER), rule_sql("labels", "labels", LABELS),
    rule_sql("part", "part", PART_NUMBERS), rule_sql("embeddings", "embeddings", EMBEDDING_LABELS),
]))
def target_candidates(spark, d):
    frames = {
        "customer": table(spark, d, "customer"), "labels": table(spark, d, "labels"),
        "part": table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"),
        "embeddings": table(spark, d, "embeddings").select("vec_id", "label"),
    }
    out = None
    for name, df in frames.items():
        found = P.target_candidates(P.column_profile(df)).select(
            F.lit(name).alias("source"), "rule", F.array_join("candidates", ",").alias("candidates"))
        out = found if out is None else out.unionByName(found)
    return out


@queries.add("target_kind", """
    SELECT 'o_orderstatus' AS target, 'categorical' AS kind, false AS is_continuous FROM orders HAVING count(*) > 0
    UNION ALL SELECT 'o_totalprice', 'numerical', count(DISTINCT o_totalprice) > 1 FROM orders
""")
def target_kind(spark, d):
    orders = table(spark, d, "orders")
    out = None
    for c in ("o_orderstatus", "o_totalprice"):
        found = P.is_continuous(orders, c).select(
            F.lit(c).alias("target"), F.lit(P.target_kind(orders, [c])).alias("kind"), "is_continuous")
        out = found if out is None else out.unionByName(found)
    return out


@queries.add("low_cardinality_columns", f"SELECT column_name, n_distinct FROM ({profile_sql('customer', CUSTOMER)}) WHERE is_low_cardinality")
def low_cardinality_columns(spark, d):
    found = P.column_profile(table(spark, d, "customer"))
    return found.where("is_low_cardinality").select("column_name", "n_distinct")
