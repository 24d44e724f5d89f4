"""Cleaning, encoding, scaling and feature reduction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import clean, reduce
from tabulon.workload.common import Registry, r, sql_r, table

queries = Registry()


@queries.add("numeric_coercion", """
    SELECT o_orderkey, try_cast(substr(o_orderpriority, 1, o_orderkey::INT % 2 + 1) AS DOUBLE) AS priority FROM orders
""")
def numeric_coercion(spark, d):
    text = F.expr("substr(o_orderpriority, 1, cast(o_orderkey % 2 as int) + 1)")
    orders = table(spark, d, "orders").select("o_orderkey", text.alias("priority"))
    return clean.to_numeric(orders, ["priority"])


def _gappy_lineitem(spark, d):
    key = F.col("l_orderkey")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(key % 7 != 0, F.col("l_quantity")).alias("quantity"),
        F.when(key % 5 == 0, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("tax"))


GAPPY_LINEITEM = """(SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS quantity,
    CASE WHEN l_orderkey % 5 <> 0 THEN l_tax END AS tax FROM lineitem)"""


@queries.add("impute_mean", f"""
    SELECT l_orderkey, l_linenumber, {sql_r('coalesce(quantity, avg(quantity) OVER ())')} AS quantity,
           {sql_r('coalesce(tax, avg(tax) OVER ())')} AS tax FROM {GAPPY_LINEITEM}
""")
def impute_mean(spark, d):
    found = clean.impute_mean(_gappy_lineitem(spark, d), ["quantity", "tax"])
    return found.select("l_orderkey", "l_linenumber", r("quantity").alias("quantity"), r("tax").alias("tax"))


WORDS = ["Female", "WOMAN", "girl", "male", "Man", "boy", "unknown person", None]


def _people(spark, d):
    words = F.array(*[F.lit(w) for w in WORDS])
    return table(spark, d, "customer").select(
        "c_custkey", F.get(words, (F.col("c_custkey") % 8).cast("int")).alias("gender"), "c_acctbal")


PEOPLE = """(SELECT c_custkey, c_acctbal, (['Female', 'WOMAN', 'girl', 'male', 'Man', 'boy', 'unknown person', NULL])[c_custkey % 8 + 1] AS gender
    FROM customer)"""
GENDER = """CASE WHEN lower(gender) IN ('female', 'woman', 'girl') THEN 'female'
    WHEN lower(gender) IN ('male', 'man', 'boy') THEN 'male' ELSE 'unknown' END"""


@queries.add("gender_standardise", f"SELECT c_custkey, {GENDER} AS gender FROM {PEOPLE}")
def gender_standardise(spark, d):
    people = _people(spark, d)
    column = clean.gender_column(people.columns)
    return people.select("c_custkey", clean.standardise_gender(F.col(column)).alias("gender"))


@queries.add("clean_table", f"""
    SELECT c_custkey::DOUBLE AS c_custkey, dense_rank() OVER (ORDER BY {GENDER}) - 1 AS gender,
           {sql_r('coalesce(balance, avg(balance) OVER ())')} AS balance
    FROM (SELECT *, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS balance FROM {PEOPLE})
""")
def clean_table(spark, d):
    people = _people(spark, d).select(
        "c_custkey", "gender", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("balance"))
    found, _ = clean.clean_table(people)
    return found.select("c_custkey", "gender", r("balance").alias("balance"))


@queries.add("label_encode", """
    SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM orders
""")
def label_encode(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return clean.encode(orders, "o_orderpriority", clean.label_codes(orders, "o_orderpriority"), "code").select("o_orderkey", "code")


@queries.add("label_codes_many", """
    SELECT c_name AS label, row_number() OVER (ORDER BY c_name) - 1 AS code FROM (SELECT DISTINCT c_name FROM customer)
""")
def label_codes_many(spark, d):
    return clean.label_codes(table(spark, d, "customer"), "c_name")


@queries.add("label_encode_by_frequency", """
    SELECT c_mktsegment AS label, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) - 1 AS code FROM customer GROUP BY 1
""")
def label_encode_by_frequency(spark, d):
    return clean.label_codes_by_frequency(table(spark, d, "customer"), "c_mktsegment")


@queries.add("target_map", """
    SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS target, c_mktsegment AS original FROM customer
""")
def target_map(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("target"))
    mapped, codes = clean.map_target(customer, "target")
    return clean.decode(mapped, "target", codes, "original")


@queries.add("zscore", f"""
    SELECT p_partkey, {sql_r('(p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER ()')} AS p_size,
           {sql_r('(p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER ()')} AS p_retailprice,
           0.0::DOUBLE AS flat FROM part
""")
def zscore(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", F.lit(7.0).alias("flat"))
    found = clean.scale(part, ["p_size", "p_retailprice", "flat"])
    return found.select("p_partkey", r("p_size").alias("p_size"), r("p_retailprice").alias("p_retailprice"), "flat")


# --- reduction ---------------------------------------------------------------------------------

FEATURES = ["quantity", "price", "discount", "tax", "net", "neg", "flat"]


def _features(spark, d):
    return table(spark, d, "lineitem", spread=True).select(
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        (-F.col("l_quantity")).alias("neg"), F.lit(1.0).alias("flat"))


FEATURES_SQL = """(SELECT l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
    l_extendedprice * (1 - l_discount) AS net, -l_quantity AS neg, 1.0::DOUBLE AS flat FROM lineitem)"""


def pairs_sql(columns, source):
    parts = [
        f"""SELECT '{a}' AS col_i, {i} AS pos_i, '{b}' AS col_j, {j} AS pos_j,
            CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN corr({a}, {b}) END AS r FROM {source}"""
        for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j
    ]
    return " UNION ALL ".join(parts)


@queries.add("correlation_pairs", f"SELECT col_i, pos_i, col_j, pos_j, {sql_r('r')} AS r FROM ({pairs_sql(FEATURES, FEATURES_SQL)})")
def correlation_pairs(spark, d):
    found = reduce.correlation_pairs(_features(spark, d), FEATURES)
    return found.select("col_i", "pos_i", "col_j", "pos_j", r("r").alias("r"))


@queries.add("correlation_of_gaps", f"""
    SELECT {sql_r('r')} AS r FROM ({pairs_sql(["quantity", "tax"], GAPPY_LINEITEM)})
""")
def correlation_of_gaps(spark, d):
    return reduce.correlation_pairs(_gappy_lineitem(spark, d), ["quantity", "tax"]).select(r("r").alias("r"))


DIMENSIONS = 64


@queries.add("correlation_wide", f"""
    WITH cells AS (SELECT vec_id, i - 1 AS pos, embedding[i]::DOUBLE AS v FROM embeddings, range(1, {DIMENSIONS + 1}) AS t(i))
    SELECT a.pos::INTEGER AS pos_i, b.pos::INTEGER AS pos_j, {sql_r('corr(a.v, b.v)')} AS r
    FROM cells a JOIN cells b ON a.vec_id = b.vec_id AND a.pos < b.pos GROUP BY 1, 2
""")
def correlation_wide(spark, d):
    cells = table(spark, d, "embeddings", spread=True).select(*[F.get("embedding", F.lit(i)).alias(f"x{i}") for i in range(DIMENSIONS)])
    return reduce.correlation_pairs(cells, cells.columns).select("pos_i", "pos_j", r("r").alias("r"))


@queries.add("correlation_filter", f"""
    SELECT column_name FROM (VALUES {', '.join(f"('{c}')" for c in FEATURES)}) AS c(column_name)
    WHERE column_name NOT IN (SELECT col_j FROM ({pairs_sql(FEATURES, FEATURES_SQL)}) WHERE r > 0.85)
""")
def correlation_filter(spark, d):
    features = _features(spark, d)
    dropped = reduce.correlated_columns(reduce.correlation_pairs(features, FEATURES))
    names = reduce.column_variances(features, FEATURES).select("column_name")
    return names.join(dropped, "column_name", "left_anti")


@queries.add("variance_filter", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {sql_r(f'var_pop({c})', 2)} AS variance FROM {FEATURES_SQL} HAVING var_pop({c}) > 0.02"
    for c in FEATURES))
def variance_filter(spark, d):
    found = reduce.column_variances(_features(spark, d), FEATURES).where(F.col("variance") > reduce.VARIANCE_LIMIT)
    return found.select("column_name", r("variance", 2).alias("variance"))


# The principal axes of two columns have a closed form, so SQL can state them.
AXES = """SELECT avg(x) AS mx, avg(y) AS my, covar_samp(x, x) AS a, covar_samp(y, y) AS c, covar_samp(x, y) AS b FROM {source}"""
EIGEN = """SELECT *, (a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2 AS l1, (a + c - sqrt((a - c) * (a - c) + 4 * b * b)) / 2 AS l2
    FROM ({axes})"""
UNIT = """SELECT *, b / sqrt(b * b + (l1 - a) * (l1 - a)) AS ux, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) AS uy FROM ({eigen})"""


def unit_sql(source: str) -> str:
    return UNIT.format(eigen=EIGEN.format(axes=AXES.format(source=source)))


TWO = "(SELECT l_quantity AS x, l_linenumber * 3.0::DOUBLE AS y, l_orderkey, l_linenumber FROM lineitem)"


def _two(spark, d):
    return table(spark, d, "lineitem", spread=True).select(
        F.col("l_quantity").alias("x"), (F.col("l_linenumber") * 3.0).alias("y"), "l_orderkey", "l_linenumber")


@queries.add("pca_components", f"""
    SELECT 1 AS component, {sql_r('l1 / (l1 + l2)', 4)} AS ratio, 2 AS n_components FROM ({unit_sql(TWO)})
    UNION ALL SELECT 2, {sql_r('l2 / (l1 + l2)', 4)}, 2 FROM ({unit_sql(TWO)})
""")
def pca_components(spark, d):
    found = reduce.project(_two(spark, d), ["x", "y"])
    rows = [(i + 1, ratio, len(found.components)) for i, ratio in enumerate(found.ratios)]
    return spark.createDataFrame(rows, "component int, ratio double, n_components int").select(
        "component", r("ratio", 4).alias("ratio"), "n_components")


@queries.add("pca_loadings", f"""
    SELECT 'x' AS column_name, 'PC1' AS component, {sql_r('abs(ux)', 4)} AS weight FROM ({unit_sql(TWO)})
    UNION ALL SELECT 'y', 'PC1', {sql_r('abs(uy)', 4)} FROM ({unit_sql(TWO)})
    UNION ALL SELECT 'x', 'PC2', {sql_r('abs(uy)', 4)} FROM ({unit_sql(TWO)})
    UNION ALL SELECT 'y', 'PC2', {sql_r('abs(ux)', 4)} FROM ({unit_sql(TWO)})
""")
def pca_loadings(spark, d):
    found = reduce.project(_two(spark, d), ["x", "y"]).loadings
    return found.select("column_name", "component", r(F.abs("weight"), 4).alias("weight"))


@queries.add("pca_scores", f"""
    SELECT l_orderkey, l_linenumber, count(*) AS n, {sql_r('sum(abs((x - mx) * ux + (y - my) * uy))', 3)} AS pc1,
           {sql_r('sum(abs((y - my) * ux - (x - mx) * uy))', 3)} AS pc2
    FROM {TWO} t, ({unit_sql(TWO)}) u GROUP BY 1, 2
""")
def pca_scores(spark, d):
    found = reduce.project(_two(spark, d), ["x", "y"]).frame
    return found.groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum(F.abs("PC1")), 3).alias("pc1"), r(F.sum(F.abs("PC2")), 3).alias("pc2"))


REDUCED = "(SELECT price / 100 AS x, quantity AS y FROM (SELECT * FROM " + FEATURES_SQL + "))"


@queries.add("reduction_run", f"""
    SELECT count(*) AS n, {sql_r('sum(abs((x - mx) * ux + (y - my) * uy)) / count(*)', 3)} AS pc1,
           {sql_r('sum(abs((y - my) * ux - (x - mx) * uy)) / count(*)', 3)} AS pc2, 'y,x' AS columns
    FROM {REDUCED} t, ({unit_sql(REDUCED)}) u
""")
def reduction_run(spark, d):
    features = _features(spark, d).withColumns({"price": F.col("price") / 100, "net": F.col("net") / 100}).drop("neg")
    found = reduce.reduce_features(features, [c for c in FEATURES if c != "neg"])
    names = ",".join({"quantity": "y", "price": "x"}.get(c, c) for c in found.columns)
    return found.frame.agg(
        F.count(F.lit(1)).alias("n"), r(F.avg(F.abs("PC1")), 3).alias("pc1"), r(F.avg(F.abs("PC2")), 3).alias("pc2"),
    ).withColumn("columns", F.lit(names))


@queries.add("plane_view", f"""
    WITH s AS (SELECT p_partkey, (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS z1,
                      (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () AS z2 FROM part),
         c AS (SELECT CASE WHEN corr(p_size, p_retailprice) < 0 THEN -1 ELSE 1 END AS sgn FROM part)
    SELECT p_partkey, {sql_r('abs(z1 + sgn * z2) / sqrt(2.0)', 4)} AS pc1, {sql_r('abs(z1 - sgn * z2) / sqrt(2.0)', 4)} AS pc2 FROM s, c
""")
def plane_view(spark, d):
    found = reduce.plane_view(table(spark, d, "part"), ["p_size", "p_retailprice"])
    return found.select("p_partkey", r(F.abs("pc1"), 4).alias("pc1"), r(F.abs("pc2"), 4).alias("pc2"))
