"""Reproducible train/test splits, stratified folds and bootstrap samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.vectors import let
from tabulon.operators.ordered import with_position

SEED = 42
TEST_PERCENT = 20
#: The chance of at most 0, 1, 2, ... draws, up to where a double holds no larger value below 1.
DRAW_BOUNDS = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(17)]


def row_digest(key: str | None, columns: list[str], seed: int | str) -> Column:
    """A hex digest per row: of its key, or of all its values where the table has no key."""
    source = F.coalesce(F.col(key).cast("string"), F.lit("")) if key else F.to_json(F.struct(*columns))
    return F.md5(F.concat(F.lit(f"{seed}:"), source))


def split_percent(df: DataFrame, key: str | None = None, seed: int = SEED) -> Column:
    digest = row_digest(key, df.columns, seed)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100


def with_split(df: DataFrame, key: str | None = None, test_percent: int = TEST_PERCENT, seed: int = SEED) -> DataFrame:
    """Adds is_test. A hash of the row decides, so a retried task or another cluster gives the same split."""
    return df.withColumn("is_test", split_percent(df, key, seed) >= 100 - test_percent)


def train_test(df: DataFrame, key: str | None = None, test_percent: int = TEST_PERCENT,
               seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    marked = with_split(df, key, test_percent, seed)
    return marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")


def with_folds(df: DataFrame, label: str | None, key: str | None = None, k: int = 5, seed: int = SEED,
               digest: str | None = None) -> DataFrame:
    """Adds fold 0..k-1, dealt out in hash order inside each label, so folds differ by at most one row per label.

    Hash prefixes cut a frequent label into 65,536 even parts. Without a key, rows with the same values are dealt as one,
    so copies stay together. Without a label (a continuous target) the hash alone decides. `digest` names a column that holds
    `row_digest` already, so that rows can leave their wide columns behind before they are dealt.
    """
    digest = F.col(digest) if digest else row_digest(key, df.columns, seed)
    if label is None:
        return df.withColumn("fold", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % k).cast("int"))
    marked = df.withColumn("_digest", digest)
    prefix = F.conv(F.substring("_digest", 1, 4), 16, 10).cast("int")
    if key is None:
        # The digest covers the label, so it identifies a distinct row.
        dealt = with_position(marked.select(label, "_digest").distinct(), [label], ["_digest"], "_place", bucket=prefix)
        placed = marked.join(dealt.select("_digest", "_place"), "_digest")
    else:
        placed = with_position(marked, [label], ["_digest", key], "_place", bucket=prefix)
    return placed.withColumn("fold", (F.col("_place") % k).cast("int")).select(*df.columns, "fold")


def draw_counts(uniform: Column) -> Column:
    """How often a row is drawn: the inverse of Poisson's distribution with mean 1, which the counts of draws with replacement
    have in a large table. `uniform` is a number from 0 to 1 (exclusive)."""
    def place(u: Column) -> Column:
        # Most rows are drawn at most twice: the first bounds decide.
        found = F.when(u < DRAW_BOUNDS[0], 0)
        for n, bound in enumerate(DRAW_BOUNDS[1:], 1):
            found = found.when(u < bound, n)
        return found.otherwise(len(DRAW_BOUNDS))

    return let(uniform, place)


def bootstrap(df: DataFrame, key: str | None = None, draw: int = 0, seed: int = SEED) -> DataFrame:
    """About as many rows as the table, drawn with replacement; `draw` numbers independent samples.

    A hash of the row's key (or of all its values, so that equal rows are drawn alike) decides how often it is drawn:
    partitions, retried tasks and other clusters make no difference, and nothing is shuffled."""
    clash = {"_drawn"} & set(df.columns)
    if clash:
        raise ValueError(f"columns exist: {sorted(clash)}")
    source = row_digest(key, df.columns, f"{seed}/{draw}")
    # 48 bits of the digest: whole numbers that a double holds exactly.
    uniform = F.conv(F.substring(source, 1, 12), 16, 10).cast("double") / float(1 << 48)
    drawn = df.withColumn("_drawn", F.array_repeat(F.lit(1), draw_counts(uniform)))
    return drawn.select(*[F.col(f"`{c}`") for c in df.columns], F.explode("_drawn").alias("_drawn")).drop("_drawn")
