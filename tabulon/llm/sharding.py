"""Shards of nearly equal bytes, by sampled splitters.

Records are ordered by a hash of their group (equal texts stand together), then by their key. A sample whose chance
grows with the record's size gives quantile boundaries, which cut the order into fine ranges; ranges that turn out
overfull are cut again with samples of their own. Range totals then say where each range begins in the whole order, a
window inside each range where each record begins. A record belongs to the shard in which its middle byte lies, so a shard
has at most half of the record at each of its two ends more or less than the mean: less than the largest record, whatever
the sample was.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.session import cut_lineage

#: Ranges for each shard, and sampled keys for each range. Their product bounds what comes to the driver.
RANGES_PER_SHARD = 32
SAMPLES_PER_RANGE = 8
#: A range is overfull above this multiple of the mean range.
OVERFULL = 2.0
#: Rounds of cutting overfull ranges. More even ranges only balance tasks; the result is the same for any.
ROUNDS = 4
_ORDER = ("_group", "_key", "_row")


def text_size(text: str) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def _weighted_sample(df: DataFrame, size: str, n: int) -> list:
    """The n records that come first in -ln(u) / size, u being a hash of the record: sampling by size without
    replacement. A retried task draws the same."""
    u = (F.shiftrightunsigned(F.xxhash64(*_ORDER, F.lit(1)), 11).cast("double") + 0.5) / float(1 << 53)
    return sorted(tuple(r) for r in df.select(*_ORDER, (-F.log(u) / F.col(size)).alias("_u")).orderBy("_u", *_ORDER)
                  .limit(n).select(*_ORDER).collect())


def _cuts(sample: list, ranges: int) -> list:
    step = len(sample) / ranges
    return [sample[int(i * step)] for i in range(1, ranges) if step >= 1 or int(i * step) != int((i - 1) * step)]


def shard_by_bytes(records: DataFrame, shards: int, size: str, group: Column, key: str,
                   ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """Add `shard` (0 to shards - 1) and `slot` (gapless position in the shard, from 0).

    `size` must be positive; `group` decides which records stand together, `key` orders them inside a group (nulls
    first). Repeated rows and ties are kept, each with a slot of its own. An empty table gives an empty table. The
    records are written to the shared folder without recomputing them; select only what is needed."""
    clash = {"shard", "slot"} & set(records.columns)
    if clash:
        raise ValueError(f"columns exist: {sorted(clash)}")
    # The caller's columns go by other names meanwhile, so that none can meet a helper's.
    given = records.columns
    names = [f"in_{i}" for i in range(len(given))]
    rows = cut_lineage(records.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(given, names)], F.xxhash64(group).alias("_group"),
        F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("_key"),
        # Tells rows apart that are the same in all else. It is fixed by being written.
        F.monotonically_increasing_id().alias("_row")))
    size = names[given.index(size)]
    ranges = shards * ranges_per_shard
    points = _cuts(_weighted_sample(rows, size, ranges * SAMPLES_PER_RANGE), ranges)
    for _ in range(ROUNDS):
        ranged = rows.withColumn("_range", _bucket(points))
        totals = ranged.groupBy("_range").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
        mean = sum(t.bytes for t in totals) / ranges
        full = {t._range: t for t in totals if t.bytes > OVERFULL * mean and t.rows > 1}
        if not full:
            break
        extra = _weighted_sample(ranged.filter(F.col("_range").isin(list(full))), size, ranges * SAMPLES_PER_RANGE)
        more = sorted(set(points) | set(_cuts(extra, max(2, int(sum(t.bytes for t in full.values()) / mean) * 2))))
        if len(more) == len(points) or len(more) > 4 * ranges:
            break
        points = more

    ranged = rows.withColumn("_range", _bucket(points))
    totals = ranged.groupBy("_range").agg(F.sum(size).alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    # One row for each range, at most 4 * shards * ranges_per_shard.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "_range", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"), F.sum("_bytes").over(everything).alias("_total"))
    inside = Window.partitionBy("_range").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumns({
        "_bytes_in": F.coalesce(F.sum(size).over(inside), F.lit(0)),
        "_rows_in": F.coalesce(F.count(F.lit(1)).over(inside), F.lit(0)),
    }).join(F.broadcast(offsets), "_range").select(
        *names, (F.col("_rows_before") + F.col("_rows_in")).alias("_place"),
        F.expr(f"cast(((_bytes_before + _bytes_in) * 2 + {size}) * {shards} div (2 * _total) as int)").alias("shard"))
    placed = cut_lineage(placed)
    first = placed.groupBy("shard").agg(F.min("_place").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(
        *[F.col(n).alias(c) for c, n in zip(given, names)], "shard", (F.col("_place") - F.col("_first")).alias("slot"))


def _bucket(points: list) -> Column:
    """Number of splitters that are not above the record, by binary search. The splitters travel as one literal."""
    if not points:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps([dict(zip(_ORDER, p)) for p in points])), "array<struct<_group:bigint,_key:string,_row:bigint>>")
    record = F.struct(*_ORDER)
    widths = F.lit([1 << b for b in reversed(range(len(points).bit_length()))])
    return F.aggregate(widths, F.lit(0), lambda pos, width: F.when(F.get(table, pos + width - 1) <= record, pos + width).otherwise(pos))


def write_shards(sharded: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder for each shard, one file in it, rows in the order of their slots."""
    sharded.repartition(F.col("shard")).sortWithinPartitions("shard", "slot").write.mode(mode).partitionBy("shard").parquet(path)
