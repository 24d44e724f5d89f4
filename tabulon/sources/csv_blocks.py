"""CSV with line breaks in quoted cells, read by many tasks.

Whether a line break ends a record depends on how many quotes stand before it in the file, so a file cannot simply be cut.
Two passes over its blocks (Spark's own splits) settle that. The first counts the quotes of each block; a running sum over
the blocks of a file says which of them begin inside a quoted cell. If no line has an odd number of quotes, every line is
a record and Spark's reader does the rest. Otherwise the second pass closes records at the line breaks outside quotes; what
a block holds of a record that began before it, or goes on after it, is put together across blocks.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.session import cut_lineage

QUOTE = '"'
# What a row of the second pass is: a whole record, or a record's part by its place in the record.
_WHOLE, _END, _MIDDLE, _START = 0, 1, 2, 3


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines by line feed alone, each with its file and the first byte of its block."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def block_states(lines: DataFrame) -> DataFrame:
    """(file, start, odd_lines, returns, inside): of each block, the lines with an odd number of quotes, whether a carriage
    return stands elsewhere than at a line's end, and 1 if it begins inside a quoted cell."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    blocks = lines.groupBy("file", "start").agg(
        F.sum(quotes).alias("quotes"), F.sum(F.pmod(quotes, F.lit(2))).alias("odd_lines"),
        F.max(F.col("value").rlike("\r.")).alias("returns"))
    # One row for each block, some hundred million bytes of the file.
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("file", "start", "odd_lines", "returns",
                         F.pmod(F.coalesce(F.sum("quotes").over(before), F.lit(0)), F.lit(2)).cast("int").alias("inside"))


def record_lines(path: str | list[str], spark: SparkSession, block_bytes: int | None = None) -> tuple[bool, DataFrame | None]:
    """Whether each line is a record; if not, the records (file, first, record), of which `first` marks a file's first one.

    Both passes run here, as they must see the same blocks; the records are written to the shared folder. To the tasks goes
    the state of all blocks, nine bytes for each. Blank lines between records are none."""
    name = "spark.sql.files.maxPartitionBytes"
    set_before = spark.conf.get(name)
    if block_bytes:
        spark.conf.set(name, str(block_bytes))
    try:
        lines = _lines(spark, path)
        states = cut_lineage(block_states(lines))
        if states.filter((F.col("odd_lines") > 0) | F.col("returns")).isEmpty():
            return True, None
        known = sorted((r.block, r.inside) for r in states.select(F.xxhash64("file", "start").alias("block"), "inside").collect())
        shared = spark.sparkContext.broadcast((np.array([b for b, _ in known], np.int64), np.array([i for _, i in known], np.int8)))
        numbered = lines.select("value", "file", "start", F.xxhash64("file", "start").alias("block"))
        parts = cut_lineage(numbered.mapInArrow(_closer(shared), "file string, start long, kind int, first boolean, record string"))
    finally:
        spark.conf.set(name, set_before)
    whole = parts.filter(F.col("kind") == _WHOLE).select("file", "first", "record")
    # At most two parts a block. A part that ends a record stands before the one that begins the next.
    order = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    chained = parts.filter(F.col("kind") != _WHOLE).withColumn("chain", F.sum((F.col("kind") == _START).cast("int")).over(order))
    joined = chained.groupBy("file", "chain").agg(
        F.bool_or("first").alias("first"), F.array_sort(F.collect_list(F.struct("start", "record"))).alias("parts"))
    record = F.array_join(F.transform("parts", lambda p: p.record), "\n")
    return False, whole.union(joined.select("file", "first", F.regexp_replace(record, "\r$", "").alias("record")))


def _closer(shared):
    """Records and parts of records out of the lines of blocks, block after block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, states = shared.value
        block, file, start = None, None, 0
        odd = opened = False                # whether the next line begins in a cell; whether a record has ended in this block
        first = False                       # whether the file's first record is still to come
        held: list[str] = []                # lines of a record that has not ended

        def rest() -> list[tuple]:
            if not held:
                return []
            kind = _MIDDLE if states[np.searchsorted(blocks, block)] and not opened else _START
            return [(kind, first and kind == _START, "\n".join(held))]

        def sent(rows: list[tuple]) -> pa.RecordBatch:
            kinds, firsts, records = zip(*rows)
            n = len(rows)
            return pa.RecordBatch.from_arrays([
                pa.array([file] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array(kinds, pa.int32()),
                pa.array(firsts, pa.bool_()), pa.array(records, pa.string())], ["file", "start", "kind", "first", "record"])

        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(3).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]))
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if own[a] != block:
                    if rows := rest():
                        yield sent(rows)
                    at = int(np.searchsorted(blocks, own[a]))
                    if at == len(blocks) or blocks[at] != own[a]:
                        raise ValueError("the files' blocks have changed between the passes")
                    block, file, start = own[a], batch.column(1)[a].as_py(), batch.column(2)[a].as_py()
                    odd, opened, first, held = bool(states[at]), False, start == 0, []
                values = batch.column(0).slice(a, z - a)
                after = (np.cumsum(pc.count_substring(values, QUOTE).to_numpy(zero_copy_only=False)) + odd) % 2
                lines, rows, at = values.to_pylist(), [], 0
                for end in np.flatnonzero(after == 0).tolist():
                    record = "\n".join([*held, *lines[at:end + 1]]) if held or end > at else lines[end]
                    held, at = [], end + 1
                    if not opened and states[np.searchsorted(blocks, block)]:
                        rows.append((_END, False, record))
                    elif record.strip():
                        rows.append((_WHOLE, first, record[:-1] if record.endswith("\r") else record))
                        first = False
                    opened = True
                held += lines[at:]
                odd = bool(after[-1])
                if rows:
                    yield sent(rows)
        if rows := rest():
            yield sent(rows)

    return run


def header_names(header: str) -> list[str]:
    """Column names of a header record; one without a name is `_c` and its place, a repeated one gets its place added."""
    names = next(csv.reader([header.removeprefix("\ufeff")], doublequote=True), [])
    names = [n or f"_c{i}" for i, n in enumerate(names)]
    return [f"{n}{i}" if n.lower() in {m.lower() for m in [*names[:i], *names[i + 1:]]} else n for i, n in enumerate(names)]


def parse_records(records: DataFrame, reader, names: list[str] | None) -> DataFrame:
    """Spark's CSV parser over the records; `names` of the columns, or None where the reader has a schema."""
    spark = records.sparkSession
    rows = records.filter(~F.col("first")).select("record")._jdf
    texts = getattr(rows, "as")(spark.sparkContext._jvm.org.apache.spark.sql.Encoders.STRING())
    found = DataFrame(reader._jreader.csv(texts), spark)
    if names is None:
        return found
    width = len(found.columns)
    return found.toDF(*names[:width], *[f"_c{i}" for i in range(len(names), width)])
