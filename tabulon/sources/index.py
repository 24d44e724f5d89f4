"""A stored vector index: documents of all datasets in one folder, read by dataset and snapshot.

A write never touches what is there: it makes a new snapshot of its dataset, and names it in a list of snapshots when all
files are written. Readers take the list once, so they see a dataset as it was before the write or after it, never a mix.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LIST = "dataset_id string, snapshot string, written long"


def write_index(docs: DataFrame, path: str, dataset_id: str) -> str:
    """(doc_id, kind, text, embedding) as a new snapshot of the dataset, whose name is returned; a snapshot is as many files
    as there are tasks. Of two writes at the same time the one that ends last is what readers see."""
    snapshot = uuid.uuid4().hex
    root = path.rstrip("/")
    docs.withColumns({"dataset_id": F.lit(dataset_id), "snapshot": F.lit(snapshot)}) \
        .write.mode("append").partitionBy("dataset_id", "snapshot").parquet(f"{root}/vectors")
    # One file, which appears whole.
    docs.sparkSession.createDataFrame([(dataset_id, snapshot, time.time_ns())], _LIST).coalesce(1) \
        .write.mode("append").parquet(f"{root}/snapshots")
    return snapshot


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(dataset_id, snapshot, written) of all finished writes."""
    return spark.read.schema(_LIST).parquet(f"{path.rstrip('/')}/snapshots")


def current_snapshots(spark: SparkSession, path: str) -> dict[str, str]:
    """The latest snapshot of each dataset."""
    latest = snapshots(spark, path).groupBy("dataset_id").agg(F.max_by("snapshot", F.struct("written", "snapshot")).alias("snapshot"))
    return {r.dataset_id: r.snapshot for r in latest.collect()}


def read_index(spark: SparkSession, path: str, dataset_id: str | None = None) -> DataFrame:
    """All datasets, or one, as they are now: filters prune folders before any file is opened. A later write does not change
    the frame that is returned; a dataset that was never written has no rows."""
    current = current_snapshots(spark, path)
    stored = spark.read.option("basePath", f"{path.rstrip('/')}/vectors").parquet(f"{path.rstrip('/')}/vectors")
    if dataset_id is not None:
        return stored.where((F.col("dataset_id") == dataset_id) & (F.col("snapshot") == current.get(dataset_id, ""))).drop("snapshot")
    return stored.where(F.col("snapshot").isin(list(current.values()))).drop("snapshot")


def drop_old_snapshots(spark: SparkSession, path: str, older_than_seconds: float = 7 * 86400) -> list[str]:
    """Delete the files of snapshots that a newer one has replaced for so long, and return their names."""
    listed = [(r.dataset_id, r.snapshot, r.written) for r in snapshots(spark, path).collect()]
    latest = current_snapshots(spark, path)
    replaced = {d: min((w for e, s, w in listed if e == d and s == latest[d]), default=0) for d in latest}
    limit = time.time_ns() - int(older_than_seconds * 1e9)
    context = spark.sparkContext
    gone = []
    for dataset, snapshot, _ in listed:
        if snapshot != latest[dataset] and replaced[dataset] <= limit:
            folder = context._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/vectors/dataset_id={dataset}/snapshot={snapshot}")
            if folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True):
                gone.append(snapshot)
    return gone
