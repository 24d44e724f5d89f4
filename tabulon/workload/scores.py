"""Splits, folds and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import metrics as M
from tabulon.operators import splits as S
from tabulon.operators.clean import encode, label_codes
from tabulon.session import shuffle_width
from tabulon.workload.common import Registry, r, sql_r, table

queries = Registry()


@queries.add("hash_split", """
    SELECT o_orderkey, ('0x' || substr(md5('42:' || o_orderkey::VARCHAR), 1, 8))::BIGINT % 100 >= 80 AS is_test FROM orders
""")
def hash_split(spark, d):
    return S.with_split(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", "is_test")


@queries.add("stratified_folds", """
    SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:' || o_orderkey::VARCHAR), o_orderkey) - 1) % 5)::INT AS fold
    FROM orders
""")
def stratified_folds(spark, d):
    return S.with_folds(table(spark, d, "orders"), "o_orderstatus", "o_orderkey").select("o_orderkey", "fold")


def drawn_sql(draw: int) -> str:
    bounds = ", ".join(f"{p!r}e0" for p in S.DRAW_BOUNDS)
    return f"""(SELECT o_orderkey, o_orderstatus, len(list_filter([{bounds}], lambda p: p <= u))::BIGINT AS n FROM (
        SELECT o_orderkey, o_orderstatus, ('0x' || substr(md5('42/{draw}:' || o_orderkey::VARCHAR), 1, 12))::BIGINT / 281474976710656e0 AS u FROM orders))"""


@queries.add("bootstrap_sample", f"SELECT o_orderstatus, sum(n)::BIGINT AS n FROM {drawn_sql(0)} GROUP BY 1")
def bootstrap_sample(spark, d):
    return S.bootstrap(table(spark, d, "orders"), "o_orderkey").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@queries.add("bootstrap_rows", f"""
    SELECT 0 AS draw, o_orderkey, n FROM {drawn_sql(0)} WHERE n > 0 UNION ALL SELECT 1, o_orderkey, n FROM {drawn_sql(1)} WHERE n > 0
""")
def bootstrap_rows(spark, d):
    """How often each order is drawn in two samples; the rows are dealt anew before each one."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    width = shuffle_width(spark)
    parts = [S.bootstrap(orders.repartition(width + 3 + 4 * i), "o_orderkey", i).withColumn("draw", F.lit(i)) for i in range(2)]
    return parts[0].union(parts[1]).groupBy("draw", "o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@queries.add("adjusted_rand", f"""
    WITH c AS (SELECT o_orderstatus AS a, o_totalprice > 100000 AS b, count(*)::DOUBLE AS n FROM orders GROUP BY ALL),
    s AS (SELECT sum(n * (n - 1) / 2) AS in_both, sum(n) * (sum(n) - 1) / 2 AS total,
        (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS in_a, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS in_b FROM c)
    SELECT {sql_r('(in_both - in_a * in_b / total) / ((in_a + in_b) / 2 - in_a * in_b / total)')} AS adjusted_rand FROM s
""")
def adjusted_rand(spark, d):
    orders = table(spark, d, "orders").select("o_orderstatus", (F.col("o_totalprice") > 100000).alias("dear"))
    return M.adjusted_rand(orders, "o_orderstatus", "dear").select(r("adjusted_rand").alias("adjusted_rand"))


# Labels and predictions with all kinds of hits and misses, from the events.
CODES = "(SELECT event_id, (dense_rank() OVER (ORDER BY event_type) - 1)::INT AS label, ((user_id + event_id) % 6)::INT AS prediction FROM events)"


def codes(spark, d):
    events = table(spark, d, "events")
    coded = encode(events, "event_type", label_codes(events, "event_type"), "label")
    return coded.select("event_id", F.col("label").cast("int").alias("label"),
                        ((F.col("user_id") + F.col("event_id")) % 6).cast("int").alias("prediction"))


@queries.add("accuracy", f"SELECT {sql_r('avg((label = prediction)::INT)')} AS accuracy FROM {CODES}")
def accuracy(spark, d):
    return M.accuracy(codes(spark, d)).select(r("accuracy").alias("accuracy"))


OVR = f"""(SELECT l.label, count(*) FILTER (c.label = l.label AND c.prediction = l.label) AS tp,
    count(*) FILTER (c.label <> l.label AND c.prediction <> l.label) AS tn,
    count(*) FILTER (c.label <> l.label AND c.prediction = l.label) AS fp,
    count(*) FILTER (c.label = l.label AND c.prediction <> l.label) AS fn
    FROM {CODES} c, (SELECT DISTINCT label FROM {CODES}) l GROUP BY l.label)"""


def rates(tp="tp", tn="tn", fp="fp", fn="fn"):
    def rate(a, b):
        return f"(CASE WHEN ({b}) = 0 THEN 0 ELSE ({a})::DOUBLE / ({b}) END)"

    sens, prec = rate(tp, f"{tp} + {fn}"), rate(tp, f"{tp} + {fp}")
    return {"sensitivity": sens, "specificity": rate(tn, f"{tn} + {fp}"), "precision": prec, "npv": rate(tn, f"{tn} + {fn}"),
            "accuracy": rate(f"{tp} + {tn}", f"{tp} + {tn} + {fp} + {fn}"), "f_score": rate(f"2 * {prec} * {sens}", f"{prec} + {sens}")}


def _ovr(spark, d):
    return M.one_vs_rest(M.confusion(codes(spark, d)))


@queries.add("confusion_counts", f"SELECT label, prediction, count(*) AS n FROM {CODES} GROUP BY ALL")
def confusion_counts(spark, d):
    return M.confusion(codes(spark, d))


@queries.add("one_vs_rest_counts", f"SELECT * FROM {OVR}")
def one_vs_rest_counts(spark, d):
    return _ovr(spark, d)


@queries.add("binary_rates", f"SELECT label, {', '.join(f'{sql_r(v)} AS {k}' for k, v in rates().items())} FROM {OVR}")
def binary_rates(spark, d):
    return M.binary_rates(_ovr(spark, d)).select("label", *[r(c).alias(c) for c in rates()])


@queries.add("weighted_f1", f"SELECT {sql_r('sum(' + rates()['f_score'] + ' * (tp + fn)) / sum(tp + fn)')} AS weighted_f1 FROM {OVR}")
def weighted_f1(spark, d):
    return M.weighted_f1(_ovr(spark, d)).select(r("weighted_f1").alias("weighted_f1"))


AVERAGED = ("precision", "sensitivity", "specificity", "f_score")


@queries.add("macro_average", f"SELECT {', '.join(sql_r('avg(' + rates()[c] + ')') + f' AS macro_{c}' for c in AVERAGED)} FROM {OVR}")
def macro_average(spark, d):
    return M.macro_average(_ovr(spark, d)).select(*[r(f"macro_{c}").alias(f"macro_{c}") for c in AVERAGED])


@queries.add("micro_average", f"""
    SELECT {', '.join(sql_r(rates()[c]) + f' AS micro_{c}' for c in AVERAGED)}
    FROM (SELECT sum(tp) AS tp, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn FROM {OVR})
""")
def micro_average(spark, d):
    return M.micro_average(_ovr(spark, d)).select(*[r(f"micro_{c}").alias(f"micro_{c}") for c in AVERAGED])


def auc_sql(source: str) -> str:
    """Pairs of a positive and a negative: won ones count 1, equal ones 1/2, from ranks with ties at their middle."""
    return f"""(SELECT g, (sum(CASE WHEN pos THEN mid END) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0)
            / (count(*) FILTER (pos)::DOUBLE * count(*) FILTER (NOT pos)) AS auc, count(*) FILTER (pos) AS positives,
            count(*) FILTER (NOT pos) AS negatives
        FROM (SELECT g, pos, rank() OVER (PARTITION BY g ORDER BY s) + (count(*) OVER (PARTITION BY g, s) - 1) / 2.0 AS mid FROM {source}) GROUP BY g)"""


@queries.add("roc_auc", f"""
    SELECT {sql_r('auc')} AS auc, positives, negatives
    FROM {auc_sql("(SELECT 1 AS g, event_type = 'purchase' AS pos, value AS s FROM events)")}
""")
def roc_auc(spark, d):
    events = table(spark, d, "events")
    found = M.roc_auc(events, F.col("event_type") == "purchase", "value")
    return found.select(r("auc").alias("auc"), "positives", "negatives")


OVR_SCORES = "(SELECT label, [v1 / t, v2 / t, v3 / t] AS p FROM (SELECT *, v1 + v2 + v3 AS t FROM (SELECT l_linenumber % 3 AS label, l_quantity AS v1, l_linenumber * 4.0::DOUBLE AS v2, l_tax * 300 AS v3 FROM lineitem)))"


@queries.add("ovr_auc", f"""
    SELECT {sql_r('sum(auc * positives) / sum(positives)')} AS auc FROM {auc_sql(
        f"(SELECT c AS g, label = c - 1 AS pos, p[c] AS s FROM {OVR_SCORES}, (SELECT unnest([1, 2, 3]) AS c))")}
""")
def ovr_auc(spark, d):
    v1, v2, v3 = F.col("l_quantity"), F.col("l_linenumber") * 4.0, F.col("l_tax") * 300
    total = v1 + v2 + v3
    scored = table(spark, d, "lineitem").select(
        (F.col("l_linenumber") % 3).alias("label"), F.array(v1 / total, v2 / total, v3 / total).alias("p"))
    return M.ovr_auc(scored, "label", "p").select(r("auc").alias("auc"))


@queries.add("r2", f"""
    SELECT l_returnflag, {sql_r('1 - sum((y - p) ** 2) / sum((y - m) ** 2)')} AS r2
    FROM (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 2100 AS p, avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS m FROM lineitem)
    GROUP BY 1
""")
def r2(spark, d):
    df = table(spark, d, "lineitem").select(
        "l_returnflag", F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 2100).alias("prediction"))
    return M.r2(df, by=["l_returnflag"]).select("l_returnflag", r("r2").alias("r2"))
