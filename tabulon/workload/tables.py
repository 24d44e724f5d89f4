"""Sources and sinks, row filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import rows
from tabulon.operators.clean import encode, label_codes
from tabulon.session import shared_path
from tabulon.sources.logs import read_log
from tabulon.sources.tables import load_table, read_csv, read_json, write_table
from tabulon.workload.common import Registry, r, sql_r, table

queries = Registry()


@queries.add("csv_round_trip", """
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
""")
def csv_round_trip(spark, d):
    customer = table(spark, d, "customer")
    path = shared_path(spark, "customer") + ".csv"
    write_table(customer, path)
    found = read_csv(spark, path)
    return found.select(F.col("c_custkey").cast("long"), "c_name", F.col("c_nationkey").cast("int"),
                        F.col("c_acctbal").cast("double"), "c_mktsegment")


@queries.add("csv_of_many_blocks", """
    SELECT doc_id, source, md5(text) AS digest, length(text) AS n FROM (
        SELECT doc_id, source, text || chr(10) || '"quoted", ' || chr(13) || chr(10) || lang || chr(10) AS text FROM documents)
""")
def csv_of_many_blocks(spark, d):
    """Texts with line breaks, quotes and commas, written as one file and read in blocks that end anywhere in them."""
    text = F.concat("text", F.lit('\n"quoted", \r\n'), "lang", F.lit("\n"))
    path = shared_path(spark, "texts") + ".csv"
    write_table(table(spark, d, "documents").select("doc_id", "source", text.alias("text")), path)
    found = read_csv(spark, path, block_bytes=1 << 18)
    return found.select(F.col("doc_id").cast("long"), "source", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))


@queries.add("json_round_trip", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def json_round_trip(spark, d):
    supplier = table(spark, d, "supplier")
    path = shared_path(spark, "supplier") + ".json"
    write_table(supplier, path, "json")
    found = read_json(spark, path)
    return found.select("s_suppkey", "s_name", F.col("s_nationkey").cast("int"), "s_acctbal")


@queries.add("format_dispatch", """
    SELECT fmt, count(*) AS n, sum(o_orderkey)::BIGINT AS key_sum, round(sum(o_totalprice), 2) AS price_sum
    FROM orders, (VALUES ('csv'), ('json'), ('parquet')) AS f(fmt) GROUP BY fmt
""")
def format_dispatch(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    out = None
    for fmt in ("csv", "json", "parquet"):
        path = f"{shared_path(spark, 'orders')}.{fmt.upper()}"
        write_table(orders, path, fmt)
        # A given schema spares the pass that infers the types.
        part = load_table(spark, path, schema=orders.schema).withColumn("fmt", F.lit(fmt))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("fmt").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"),
                                  F.round(F.sum("o_totalprice"), 2).alias("price_sum"))


@queries.add("result_sink", """
    SELECT event_id, event_type, value, dense_rank() OVER (ORDER BY event_type) - 1 AS cluster FROM events
""")
def result_sink(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "value")
    labelled = encode(events, "event_type", label_codes(events, "event_type"), "cluster")
    path = shared_path(spark, "labelled") + ".csv"
    write_table(labelled, path)
    return read_csv(spark, path, labelled.schema)


@queries.add("log_table", """
    SELECT upper(event_type) AS level, count(*) AS n, min(date_trunc('second', ts))::TIMESTAMP AS first_ts,
           (max(date_trunc('second', ts)) + INTERVAL 9 HOUR)::TIMESTAMP AS last_local_ts,
           count(DISTINCT 'user ' || user_id::VARCHAR || ' - ' || props) AS messages
    FROM events GROUP BY 1
""")
def log_table(spark, d):
    events = table(spark, d, "events")
    lines = events.select(F.concat_ws(" - ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.upper("event_type"),
                                      F.concat(F.lit("user "), F.col("user_id").cast("string")), "props").alias("value"))
    path = shared_path(spark, "log")
    lines.write.text(path)
    log = read_log(spark, path, "Asia/Seoul")
    return log.groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").cast("timestamp_ntz").alias("first_ts"),
        F.max("local_ts").cast("timestamp_ntz").alias("last_local_ts"), F.countDistinct("message").alias("messages"))


def _gappy_customers(spark, d):
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.when(key % 7 != 0, key).alias("k"),
        F.when((key % 7 != 0) & (key % 5 != 0), F.col("c_acctbal")).alias("balance"),
        F.when(key % 7 != 0, F.col("c_mktsegment")).alias("segment"),
    )


GAPPY = """(SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS k,
    CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 THEN c_acctbal END AS balance,
    CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS segment FROM customer) g"""


@queries.add("drop_all_null_rows", f"SELECT * FROM {GAPPY} WHERE NOT (k IS NULL AND balance IS NULL AND segment IS NULL)")
def drop_all_null_rows(spark, d):
    return rows.drop_all_null_rows(_gappy_customers(spark, d))


@queries.add("drop_any_null_rows", f"SELECT * FROM {GAPPY} WHERE k IS NOT NULL AND balance IS NOT NULL AND segment IS NOT NULL")
def drop_any_null_rows(spark, d):
    return rows.drop_any_null_rows(_gappy_customers(spark, d), enabled=True)


@queries.add("features_and_target", """
    SELECT p_partkey, p_name, p_brand, p_size, p_retailprice, p_type AS target FROM part
""")
def features_and_target(spark, d):
    part = table(spark, d, "part")
    features, target = rows.features_and_target(part, "p_type")
    return part.select(*features, F.col(target).alias("target"))


@queries.add("ignore_list_projection", """
    SELECT user_id, value, event_type AS label, user_id AS scoring_user_id, value AS scoring_value FROM events
""")
def ignore_list_projection(spark, d):
    events = table(spark, d, "events").select(
        F.col("event_id").alias("ID"), F.col("ts").alias("Timestamp"), "user_id", "value", F.col("event_type").alias("label"))
    prompt = rows.without_columns(events)
    scoring = rows.without_columns(events, rows.SCORING_IGNORE)
    return prompt.select("*", *[F.col(c).alias(f"scoring_{c}") for c in scoring.columns])


@queries.add("class_filter", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'")
def class_filter(spark, d):
    return rows.of_class(table(spark, d, "events"), "event_type", "purchase").select("event_id", "user_id", "value")


@queries.add("threshold_sides", """
    WITH x AS (SELECT CASE WHEN l_orderkey % 11 <> 0 THEN l_quantity END AS q FROM lineitem)
    SELECT CASE WHEN q IS NULL THEN NULL WHEN q <= 25 THEN 'left' ELSE 'right' END AS train_side,
           CASE WHEN q <= 25 THEN 'left' ELSE 'right' END AS walk_side, count(*) AS n
    FROM x GROUP BY ALL
""")
def threshold_sides(spark, d):
    q = F.when(F.col("l_orderkey") % 11 != 0, F.col("l_quantity"))
    lineitem = table(spark, d, "lineitem").select(q.alias("q"))
    return lineitem.groupBy(
        rows.split_side(F.col("q"), 25.0).alias("train_side"), rows.walk_side(F.col("q"), 25.0).alias("walk_side"),
    ).agg(F.count(F.lit(1)).alias("n"))


@queries.add("preview_rows", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def preview_rows(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return rows.preview(orders, "o_orderkey", 5)


@queries.add("columns_by_type", """
    SELECT 'numeric' AS kind, 'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax' AS names,
           count(*) AS n FROM lineitem
    UNION ALL SELECT 'categorical', 'l_returnflag,l_linestatus,l_shipdate', count(*) FROM lineitem
""")
def columns_by_type(spark, d):
    lineitem = table(spark, d, "lineitem")
    kinds = {"numeric": rows.numeric_columns(lineitem), "categorical": rows.categorical_columns(lineitem)}
    named = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(",".join(v)).alias("names")) for k, v in kinds.items()])
    counted = lineitem.agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.inline(named), "n")


@queries.add("nan_to_null", f"""
    SELECT count(*) AS n, count(CASE WHEN l_linenumber <> 3 THEN l_tax END) AS present,
           {sql_r("avg(CASE WHEN l_linenumber <> 3 THEN l_tax END)")} AS mean FROM lineitem
""")
def nan_to_null(spark, d):
    x = F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    found = rows.nan_to_null(table(spark, d, "lineitem").select(x.alias("x")))
    return found.agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("present"), r(F.avg("x")).alias("mean"))
