"""Lines that spread over many sites.

Each line has a HyperLogLog sketch of the sites that hold it; sketches of the same line hash merge by aggregation, on
the map side first, so a line in a third of all documents costs one sketch per task. Estimates far from the threshold
decide at once; lines near it get an exact distinct count. Each line that reaches the threshold stays only where it
stands first.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.session import cut_lineage

#: Sites from which on a line counts as boilerplate.
MIN_SITES = 10
#: 2**LOG_BUCKETS registers; one standard error of the estimate is ERROR.
LOG_BUCKETS = 10
ERROR = 1.04 / 2 ** (LOG_BUCKETS / 2)
#: Standard errors around the threshold inside which a line is counted exactly.
SAFE_ERRORS = 6


def lines_of(text: Column | str) -> Column:
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n", -1)


@F.pandas_udf(T.StringType())
def _without_lines(texts: pd.Series, numbers: pd.Series) -> pd.Series:
    def cut(text, out):
        if text is None:
            return None
        out = set(out)
        return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in out)

    return pd.Series([cut(t, n) for t, n in zip(texts, numbers)], dtype=object)


def spread_lines(docs: DataFrame, text: str, site: str, key: str, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes of the lines (blanks at the ends aside, blank lines never) that at least `min_sites` distinct sites hold,
    each with the first place where it stands: `line`, `length`, `first` (key, row, number of the line)."""
    lines = docs.select(
        F.col(site).alias("site"), F.col(key).alias("key"), F.xxhash64(text).alias("row"),
        F.posexplode(lines_of(text)).alias("number", "raw"),
    ).withColumn("raw", F.trim("raw")).filter("raw <> ''").select(
        # A null site is one site of its own.
        F.when(F.col("site").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("site").cast("string"))).alias("site"),
        F.xxhash64("raw").alias("line"), F.length("raw").alias("length"),
        F.struct(F.col("key").isNull().alias("no_key"), "key", "row", "number").alias("place"),
    )
    sketches = lines.groupBy("line", "length").agg(
        F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.hll_sketch_agg("site", LOG_BUCKETS).alias("sketch"),
    ).filter(F.col("n") >= min_sites)
    counted = cut_lineage(sketches.select("line", "length", "first", F.hll_sketch_estimate("sketch").alias("sites")))
    low, high = min_sites * (1 - SAFE_ERRORS * ERROR) - 1, min_sites * (1 + SAFE_ERRORS * ERROR) + 1
    near = counted.filter(F.col("sites").between(low, high))
    exact = (
        lines.join(near.select("line", "length"), ["line", "length"], "left_semi")
        .groupBy("line", "length", "site").agg(F.lit(1).alias("one"))
        .groupBy("line", "length").agg(F.count(F.lit(1)).alias("exact"))
    )
    return (
        counted.filter(F.col("sites") >= low).join(exact, ["line", "length"], "left")
        .filter(F.when(F.col("sites").between(low, high), F.col("exact") >= min_sites).otherwise(F.col("sites") >= min_sites))
        .select("line", "length", "first")
    )


def remove_spread_lines(docs: DataFrame, text: str = "text", site: str = "source", key: str = "doc_id",
                        min_sites: int = MIN_SITES) -> DataFrame:
    """Take the lines that stand on `min_sites` or more distinct sites out of every text, except at their first place
    (least key, nulls last, then text hash and line number). Adds `n_lines` and `n_removed`.

    Lines are parted by line feeds. Null texts stay null with no lines; an empty text has one line, which is blank and
    stays. Identical rows share their first place, so each of them keeps the line. Other columns and repeated rows stay;
    the two new names must be free."""
    clash = {"n_lines", "n_removed"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns exist: {sorted(clash)}")
    # The caller's columns go by other names meanwhile, so that none can meet a helper's.
    names = docs.columns
    docs = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)])
    text, site, key = (f"in_{names.index(c)}" for c in (text, site, key))
    spread = cut_lineage(spread_lines(docs, text, site, key, min_sites))
    hits = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_row"), F.posexplode(lines_of(text)).alias("number", "raw")) \
        .withColumn("raw", F.trim("raw")).filter("raw <> ''") \
        .select("_key", "_row", "number", F.xxhash64("raw").alias("line"), F.length("raw").alias("length")) \
        .join(spread, ["line", "length"]) \
        .filter(~(F.col("first.key").eqNullSafe(F.col("_key")) & (F.col("first.row") == F.col("_row")) & (F.col("first.number") == F.col("number")))) \
        .groupBy("_key", "_row").agg(F.collect_set("number").alias("_out"))
    rows = docs.withColumn("_row", F.xxhash64(text))
    joined = rows.join(hits.withColumnRenamed("_row", "_row2"), rows[key].eqNullSafe(F.col("_key")) & (F.col("_row") == F.col("_row2")), "left")
    out = F.coalesce("_out", F.array().cast("array<int>"))
    some = F.size(out) > 0
    # Only texts that lose lines go to Python, where the work is linear in the number of lines.
    kept = F.when(some, _without_lines(F.when(some, F.col(text)), out)).otherwise(F.col(text))
    return joined.select(
        *[(F.col(f"in_{i}") if f"in_{i}" != text else kept).alias(c) for i, c in enumerate(names)],
        F.when(F.col(text).isNull(), 0).otherwise(F.size(lines_of(text))).cast("long").alias("n_lines"),
        F.size(out).cast("long").alias("n_removed"))
