"""Log files as a table: `YYYY-MM-DD hh:mm:ss - LEVEL - message`, UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) - (\w+) - (.*)$"


def parse_log(lines: DataFrame, time_zone: str | None = None) -> DataFrame:
    """(ts, level, message, local_ts); a line of another form keeps its text as the message."""
    ts = F.try_to_timestamp(F.nullif(F.regexp_extract("value", LINE, 1), F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss"))
    fits = F.col("value").rlike(LINE)
    parsed = lines.select(
        ts.alias("ts"),
        F.when(fits, F.regexp_extract("value", LINE, 2)).alias("level"),
        F.when(fits, F.regexp_extract("value", LINE, 3)).otherwise(F.col("value")).alias("message"),
    )
    return parsed.withColumn("local_ts", F.from_utc_timestamp("ts", time_zone) if time_zone else F.col("ts"))


def read_log(spark: SparkSession, path: str, time_zone: str | None = None) -> DataFrame:
    return parse_log(spark.read.text(path), time_zone)
