"""Exact running totals over a global order, without a window that puts all rows into one task.

Rows are cut into order-preserving buckets, each bucket gets its own window, and the totals of the
earlier buckets are added. Split points only balance the work: any choice gives the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tabulon.session import cut_lineage, shuffle_width

MAX_BUCKETS = 1024
SAMPLES_PER_BUCKET = 16


def split_points(df: DataFrame, order: Sequence[str], buckets: int | None = None) -> list[Row]:
    """At most MAX_BUCKETS - 1 order keys that cut the rows into about equal parts.

    The sample holds the rows with the smallest key hashes, so its size has a fixed bound.
    """
    buckets = min(buckets or 2 * shuffle_width(df.sparkSession), MAX_BUCKETS)
    sample = (
        df.select(*order)
        .orderBy(F.xxhash64(*order), *order)
        .limit(buckets * SAMPLES_PER_BUCKET)
        .orderBy(*order)
        .collect()
    )
    step = max(1, len(sample) // buckets)
    return sample[step::step][: buckets - 1]


def ordered_bucket(order: Sequence[str], points: Sequence[Row]) -> Column:
    """Number of split points that are not above the row's key (binary search in the sorted points)."""
    if not points:
        return F.lit(0)
    table = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(order, p)]) for p in points])
    key = F.struct(*order)
    widths = [1 << b for b in reversed(range(len(points).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(w) for w in widths]),
        F.lit(0),
        lambda pos, width: F.when(F.get(table, pos + width - 1) <= key, pos + width).otherwise(pos),
    )


def with_running_totals(df: DataFrame, by: Sequence[str], order: Sequence[str], totals: dict[str, Column],
                        buckets: int | None = None, bucket: Column | None = None) -> DataFrame:
    """Add, per entry of `totals`, its sum over all earlier rows of the same `by` group.

    (by, order) must identify a row; `order` must not be null, and null is a group of `by` like any other. Where the caller knows an order-preserving,
    evenly spread bucket of the order key (a hash prefix), it passes `bucket` and no split points are taken.
    """
    by, order = list(by), list(order)
    if bucket is None:
        # Sample, bucket totals and result all read the frame: write it once instead of computing it three times.
        df = cut_lineage(df)
        bucket = ordered_bucket([*by, *order], split_points(df, [*by, *order], buckets))
    cut = df.withColumn("_bucket", bucket)
    sums = {name: F.sum(value) for name, value in totals.items()}

    per_bucket = cut.groupBy(*by, "_bucket").agg(*[s.alias(f"_sum_{n}") for n, s in sums.items()])
    # With no `by` this window sees one row per bucket, which MAX_BUCKETS bounds.
    group = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bucket").rowsBetween(*_BEFORE)
    offsets = per_bucket.select(
        *[F.col(c).alias(f"_of_{c}") for c in [*by, "_bucket"]],
        *[F.coalesce(F.sum(f"_sum_{n}").over(group), F.lit(0)).alias(f"_offset_{n}") for n in totals],
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(*_BEFORE)
    for n, s in sums.items():
        cut = cut.withColumn(f"_inside_{n}", F.coalesce(s.over(inside), F.lit(0)))
    # Every bucket has its offset. The left join spares the null test on the bucket, which would compute it again.
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by] + [F.col("_bucket") == F.col("_of__bucket")]
    joined = cut.join(offsets, same, "left")
    return joined.select(*df.columns, *[
        (F.col(f"_inside_{n}") + F.coalesce(F.col(f"_offset_{n}"), F.lit(0))).alias(n) for n in totals
    ])


_BEFORE = (Window.unboundedPreceding, -1)


def with_position(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "position",
                  bucket: Column | None = None) -> DataFrame:
    """Zero-based row number inside each `by` group."""
    return with_running_totals(df, by, order, {name: F.lit(1).cast("long")}, bucket=bucket)
