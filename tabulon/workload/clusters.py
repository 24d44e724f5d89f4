"""Clustering: curves, choices, silhouettes, labels, the full run."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabulon.operators import clustering as C
from tabulon.operators import metrics as M
from tabulon.operators.report import combine, report_metrics
from tabulon.plans.cluster_table import cluster_table
from tabulon.session import cut_lineage, shared_path
from tabulon.sources.tables import load_table, write_table
from tabulon.workload.common import Registry, r, sql_r, table

queries = Registry()

DIMENSIONS = 64


def flat_embeddings(spark, d):
    """vec_id, label and one column per dimension, as a file: the analysis works on flat tables that were uploaded."""
    flat = table(spark, d, "embeddings").select(
        "vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(DIMENSIONS)])
    path = shared_path(spark, "embeddings") + ".parquet"
    write_table(flat, path, "parquet")
    return load_table(spark, path)


EMBEDDED = [f"e{i}" for i in range(DIMENSIONS)]
ORDER_FEATURES = ["price", "day"]


def _order_points(spark, d):
    """Two comparable numeric columns per order."""
    day = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date"))
    return table(spark, d, "orders", spread=True).select(
        "o_orderkey", (F.col("o_totalprice") / 1000).alias("price"), (day / 10.0).alias("day"))


@queries.add("kmeans_labels", "SELECT o_orderkey, true AS nearest FROM orders")
def kmeans_labels(spark, d):
    """Every row's label is the centre that is nearest to it."""
    points = _order_points(spark, d)
    model = C.kmeans_model(C.assemble(points, ORDER_FEATURES), 5)
    labelled = C.cluster_labels(points, ORDER_FEATURES, 5, "k-Means", model)
    gaps = [sum((F.col(c) - float(v)) ** 2 for c, v in zip(ORDER_FEATURES, centre)) for centre in model.clusterCenters()]
    own = F.element_at(F.array(*gaps), F.col(C.KMEANS_COLUMN) + 1)
    return labelled.select("o_orderkey", (own <= F.least(*gaps) * (1 + 1e-9)).alias("nearest"))


@queries.add("label_attach", "SELECT o_orderkey, 1::BIGINT AS n, true AS labelled FROM orders")
def label_attach(spark, d):
    labelled = C.cluster_labels(_order_points(spark, d), ORDER_FEATURES, 4, "k-Means")
    found = labelled.groupBy("o_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col(C.KMEANS_COLUMN).between(0, 3)).alias("labelled"))
    return found


@queries.add("total_spread", f"""
    SELECT {sql_r('var_pop(price) * count(*) + var_pop(day) * count(*)', 1)} AS wcss
    FROM (SELECT o_totalprice / 1000 AS price, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) / 10.0::DOUBLE AS day FROM orders)
""")
def total_spread(spark, d):
    return C.total_spread(_order_points(spark, d), ORDER_FEATURES).select(r("wcss", 1).alias("wcss"))


ORDER_POINTS = "(SELECT o_totalprice / 1000 AS price, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) / 10.0::DOUBLE AS day FROM orders)"


@queries.add("kmeans_sweep", f"""
    SELECT unnest(range(1, 11))::INT AS k, {sql_r('var_pop(price) * count(*) + var_pop(day) * count(*)', 1)} AS single_cost,
        true AS cost_falls, true AS score_in_range FROM {ORDER_POINTS}
""")
def kmeans_sweep(spark, d):
    """The curve of all k with what must hold for it: one cluster costs the whole spread, more cost less, scores lie in -1 to 1."""
    points = _order_points(spark, d).persist()
    curve = C.sweep(points, ORDER_FEATURES).curve
    points.unpersist()
    whole = curve.where("k = 1").select("wcss").scalar()
    scored = F.when(F.col("k") == 1, F.col("silhouette").isNull()).otherwise(F.col("silhouette").between(-1, 1))
    return curve.select("k", r(whole, 1).alias("single_cost"), F.when(F.col("k") == 1, True).otherwise(F.col("wcss") < whole).alias("cost_falls"),
                        F.coalesce(scored, F.lit(False)).alias("score_in_range"))


# Curves with the shape of a sweep, aggregated from line items: a cost that falls, a score that varies.
CURVE = """(SELECT k, sum(CASE WHEN l_linenumber >= k THEN l_extendedprice ELSE 0 END) / 1000 AS wcss,
    avg(CASE WHEN l_linenumber = k THEN l_discount END) AS silhouette
    FROM lineitem, (SELECT DISTINCT l_linenumber AS k FROM lineitem) GROUP BY k)"""


def _curve(spark, d):
    per = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(
        F.sum("l_extendedprice").alias("p"), F.avg("l_discount").alias("silhouette"))
    # One row per line number, so this window sees a handful of rows.
    upward = F.sum("p").over(Window.partitionBy(F.lit(0)).orderBy(F.col("k").desc()))
    return per.select("k", (upward / 1000).alias("wcss"), "silhouette")


CURVE_ENDS = f"(SELECT *, first_value(wcss) OVER (ORDER BY k) AS y1, first_value(wcss) OVER (ORDER BY k DESC) AS y2, min(k) OVER () AS x1, max(k) OVER () AS x2 FROM {CURVE})"
DISTANCES = f"""(SELECT k, wcss, abs((y2 - y1) * k - (x2 - x1) * wcss + x2 * y1 - y2 * x1) / sqrt((y2 - y1) ** 2 + (x2 - x1) ** 2) AS distance
    FROM {CURVE_ENDS} WHERE k > x1 AND k < x2)"""


@queries.add("elbow_point", f"SELECT k AS elbow_k FROM {DISTANCES} ORDER BY distance DESC, k LIMIT 1")
def elbow_point(spark, d):
    return C.elbow_point(_curve(spark, d))


@queries.add("elbow_curve", f"""
    SELECT k, {sql_r('wcss', 3)} AS wcss, k = (SELECT k FROM {DISTANCES} ORDER BY distance DESC, k LIMIT 1) AS is_elbow FROM {CURVE}
""")
def elbow_curve(spark, d):
    return C.elbow_curve(_curve(spark, d)).select("k", r("wcss", 3).alias("wcss"), "is_elbow")


@queries.add("silhouette_best", f"SELECT k AS silhouette_k FROM {CURVE} ORDER BY silhouette DESC, k LIMIT 1")
def silhouette_best(spark, d):
    return C.best_silhouette(_curve(spark, d))


@queries.add("silhouette_curve", f"""
    SELECT k, {sql_r('silhouette', 5)} AS silhouette, k = (SELECT k FROM {CURVE} ORDER BY silhouette DESC, k LIMIT 1) AS is_best
    FROM {CURVE} WHERE k > 1
""")
def silhouette_curve(spark, d):
    return C.silhouette_curve(_curve(spark, d)).select("k", r("silhouette", 5).alias("silhouette"), "is_best")


PAIRS = "(SELECT p_partkey, (p_size % 9 + 2)::INT AS e, (p_partkey % 9 + 2)::INT AS s FROM part)"


@queries.add("choose_k", f"""
    SELECT p_partkey, CASE WHEN abs(e - s) > 1 THEN s ELSE ((e + s) // 2)::INT END AS k,
           CASE WHEN e = s THEN 'Both methods suggest the same number of clusters: ' || e || '.' || chr(10)
                ELSE 'Elbow method suggests ' || e || ' clusters.' || chr(10) || 'Silhouette method suggests ' || s || ' clusters.' || chr(10) ||
                    CASE WHEN abs(e - s) > 1 THEN 'The difference between the two methods is significant.' || chr(10) || ' Choosing the number of clusters based on silhouette method.' || chr(10)
                         ELSE 'The difference between the two methods is not significant. Choosing the number of clusters based on their average.' END
           END AS reason FROM {PAIRS}
""")
def choose_k(spark, d):
    e, s = (F.col("p_size") % 9 + 2).cast("int"), (F.col("p_partkey") % 9 + 2).cast("int")
    return table(spark, d, "part").select("p_partkey", C.chosen_k(e, s).alias("k"), C.choice_reason(e, s).alias("reason"))


@queries.add("silhouette_band", """
    SELECT CASE WHEN x >= 0.5 THEN 'STRONG' WHEN x >= 0.25 THEN 'MODERATE' WHEN x > -0.25 THEN 'WEAK' WHEN x > -0.5 THEN 'May'
                ELSE 'Strong' END AS band, count(*) AS n
    FROM (SELECT round(c_acctbal / 10000, 2) AS x FROM customer) GROUP BY 1
""")
def silhouette_band(spark, d):
    score = F.round(F.col("c_acctbal") / 10000, 2)
    word = F.regexp_extract(C.silhouette_band(score), "STRONG|MODERATE|WEAK|May|Strong", 0)
    return table(spark, d, "customer").groupBy(word.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@queries.add("exact_silhouette", f"""
    WITH p AS (SELECT vec_id, label, embedding::DOUBLE[64] AS v FROM embeddings),
    m AS (SELECT a.vec_id, a.label, b.label AS other, sum(array_distance(a.v, b.v)) AS total, count(*) AS size FROM p a, p b GROUP BY ALL),
    s AS (SELECT vec_id, label, max(CASE WHEN other = label THEN total / (size - 1) END) AS a,
                 min(CASE WHEN other <> label THEN total / size END) AS b FROM m GROUP BY ALL)
    SELECT label, count(*) AS n, {sql_r('avg((b - a) / greatest(a, b))', 5)} AS silhouette FROM s GROUP BY label
""")
def exact_silhouette(spark, d):
    points = table(spark, d, "embeddings")
    found = C.exact_silhouettes(points, "vec_id", "embedding", "label").join(points.select("vec_id", "label"), "vec_id")
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r(F.avg("silhouette"), 5).alias("silhouette"))


@queries.add("ward_labels", """
    SELECT vec_id, true AS labelled, 10::BIGINT AS clusters FROM embeddings, (SELECT 1)
""")
def ward_labels(spark, d):
    """One row per vector, each with one of exactly ten labels."""
    found = C.ward_labels(flat_embeddings(spark, d), EMBEDDED, 10).select("vec_id", C.WARD_COLUMN)
    found = cut_lineage(found)
    clusters = found.agg(F.countDistinct(C.WARD_COLUMN).alias("clusters")).scalar()
    return found.select("vec_id", F.coalesce(F.col(C.WARD_COLUMN).between(0, 9), F.lit(False)).alias("labelled"), clusters.alias("clusters"))


@queries.add("ward_exact", "SELECT 10::BIGINT AS clusters, count(*) AS n, true AS as_tight_as_the_groups, true AS tree_sums_up FROM embeddings")
def ward_exact(spark, d):
    """Ward's tree over all vectors. Ten clusters are at most a twentieth wider than the ten groups that the vectors were made
    of, which no other labels would be; all merges together cost the whole spread."""
    flat = flat_embeddings(spark, d)
    labelled = cut_lineage(C.ward_labels(flat, EMBEDDED, 10, micro=None))
    inside = lambda by: labelled.groupBy(by).agg(sum(F.var_pop(c) * F.count(c) for c in EMBEDDED).alias("s")).agg(F.sum("s")).head()[0]
    points = C.distinct_points(flat, EMBEDDED).select("id", "n", "mean")
    cost, whole = C.ward_merges(points).agg(F.sum("cost")).head()[0], C.total_spread(flat, EMBEDDED).head()["wcss"]
    return labelled.agg(F.countDistinct(C.WARD_COLUMN).alias("clusters"), F.count(F.lit(1)).alias("n")).select(
        "clusters", "n", F.lit(inside(C.WARD_COLUMN) <= 1.05 * inside("label")).alias("as_tight_as_the_groups"), F.lit(abs(cost - whole) <= 1e-6 * whole).alias("tree_sums_up"))


LINE_COLUMNS = ["place", "row"]


def _line_points(spark, d):
    """Line items in the plane: seven groups, by their number, of which discount and tax make small grids."""
    number = F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        "l_linenumber", (number * 5 + F.col("l_discount") * 10).alias("place"), (number % 3 * 5 + F.col("l_tax") * 10).alias("row"))


@queries.add("ward_groups", "SELECT l_linenumber, count(*) AS n, 1::BIGINT AS clusters, 1::BIGINT AS numbers FROM lineitem GROUP BY l_linenumber")
def ward_groups(spark, d):
    """The exact tree over all line items, cut at seven, has the seven groups: each has one label, which no other group has."""
    found = cut_lineage(C.ward_labels(_line_points(spark, d), LINE_COLUMNS, 7, micro=None).select("l_linenumber", C.WARD_COLUMN))
    shared = found.groupBy(C.WARD_COLUMN).agg(F.countDistinct("l_linenumber").alias("numbers"))
    return found.join(shared, C.WARD_COLUMN).groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(C.WARD_COLUMN).alias("clusters"), F.max("numbers").alias("numbers"))


@queries.add("ward_agreement", "SELECT count(*) AS n, true AS nine_tenths FROM lineitem")
def ward_agreement(spark, d):
    """The adjusted Rand index between the tree of 100 micro-clusters and the exact one over all line items."""
    exact = C.ward_labels(_line_points(spark, d), LINE_COLUMNS, 7, micro=None, out="exact")
    both = cut_lineage(C.ward_labels(exact, LINE_COLUMNS, 7, micro=100, out="summed").select("exact", "summed"))
    index = M.adjusted_rand(both, "exact", "summed")
    return index.select(F.lit(both.count()).cast("long").alias("n"), (F.col("adjusted_rand") >= 0.9).alias("nine_tenths"))


@queries.add("ward_tree", f"""
    SELECT count(*) AS n, 1::BIGINT AS roots, {sql_r('var_pop(price) * count(*) + var_pop(day) * count(*)', 1)} AS spread
    FROM {ORDER_POINTS}
""")
def ward_tree(spark, d):
    """Sizes add up to the rows, merges are one fewer than starts, and what all merges cost is, with the spread inside
    the micro-clusters, the whole spread."""
    placed, start = C.micro_clusters(_order_points(spark, d), ORDER_FEATURES)
    inside = placed.groupBy("_micro").agg(sum(F.var_pop(c) * F.count(c) for c in ORDER_FEATURES).alias("inside"))
    merges = C.ward_merges(start).agg(F.count(F.lit(1)).alias("merges"), F.sum("cost").alias("cost"))
    starts = start.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("starts"))
    # All three are single rows.
    one = starts.select("*", merges.select("merges").scalar().alias("merges"), merges.select("cost").scalar().alias("cost"),
                        inside.agg(F.sum("inside")).scalar().alias("inside"))
    return one.select("n", (F.col("starts") - F.col("merges")).alias("roots"), r(F.col("cost") + F.col("inside"), 1).alias("spread"))


@queries.add("ward_of_micro_clusters", "SELECT o_orderkey, true AS labelled, 5::BIGINT AS clusters FROM orders")
def ward_of_micro_clusters(spark, d):
    found = cut_lineage(C.ward_labels(_order_points(spark, d), ORDER_FEATURES, 5).select("o_orderkey", C.WARD_COLUMN))
    clusters = found.agg(F.countDistinct(C.WARD_COLUMN).alias("clusters")).scalar()
    return found.select("o_orderkey", F.coalesce(F.col(C.WARD_COLUMN).between(0, 4), F.lit(False)).alias("labelled"), clusters.alias("clusters"))


@queries.add("cluster_run", "SELECT label, count(*) AS n, count(*) AS by_kmeans, count(*) AS by_ward, count(*) AS placed FROM embeddings GROUP BY label")
def cluster_run(spark, d):
    """Both algorithms label every row, and every row has its place in the plane."""
    run = cluster_table(flat_embeddings(spark, d), "both", plane=True, ignore=("vec_id", "label"), variance_limit=0.001)
    return run.labelled.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(C.KMEANS_COLUMN).between(0, run.k - 1)).alias("by_kmeans"),
        F.count_if(F.col(C.WARD_COLUMN).between(0, run.k - 1)).alias("by_ward"), F.count_if(F.col("pc1").isNotNull() & F.col("pc2").isNotNull()).alias("placed"))


@queries.add("cluster_report")
def cluster_report(spark, d):
    points = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return cluster_table(points, "k-Means", ignore=("p_partkey",)).report


@queries.add("report_metrics", """
    SELECT 'orders' AS section, unnest([struct_pack(key := 'rows', value := count(*)::VARCHAR),
        struct_pack(key := 'customers', value := count(DISTINCT o_custkey)::VARCHAR),
        struct_pack(key := 'first status', value := min(o_orderstatus))], recursive := true) FROM orders
    UNION ALL SELECT 'parts', unnest([struct_pack(key := 'rows', value := count(*)::VARCHAR),
        struct_pack(key := 'largest', value := max(p_size)::VARCHAR)], recursive := true) FROM part
""")
def report(spark, d):
    orders = table(spark, d, "orders").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("c"), F.min("o_orderstatus").alias("s"))
    part = table(spark, d, "part").agg(F.count(F.lit(1)).alias("n"), F.max("p_size").alias("m"))
    return combine(
        report_metrics(orders, "orders", {"rows": F.col("n"), "customers": F.col("c"), "first status": F.col("s")}),
        report_metrics(part, "parts", {"rows": F.col("n"), "largest": F.col("m")}))
