import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tabulon import session
from tabulon.operators import report
from tabulon.sources.index import current_snapshots, drop_old_snapshots, read_index, write_index
from tabulon.sources.logs import parse_log
from tabulon.sources.tables import format_of, load_table, read_json, write_table


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, 2.5)], "k int, s string, x double")
    for fmt in ("csv", "json", "parquet"):
        path = f"{tmp_path}/t.{fmt}"
        write_table(df, path, fmt)
        got = load_table(spark, path).select("k", "s", "x").orderBy("k").collect()
        assert [tuple(r) for r in got] == [(1, "a", 1.5), (2, None, 2.5)]
    with pytest.raises(ValueError):
        format_of("notes.TXT")
    with pytest.raises(ValueError):
        load_table(spark, "")
    assert format_of("/a/b.c/T.CSV") == "csv"


def test_json_document(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": "y"}], indent=1))
    assert [r["a"] for r in read_json(spark, str(tmp_path / "t.json"), document=True).orderBy("a").collect()] == [1, 2]


def test_log(spark):
    lines = spark.createDataFrame([("2024-01-01 00:00:00 - INFO - msg - more",), ("  a second line",)], "value string")
    rows = parse_log(lines, "Asia/Seoul").select("*", F.date_format("local_ts", "HH").alias("h")).collect()
    assert rows[0]["level"] == "INFO" and rows[0]["message"] == "msg - more" and rows[0]["h"] == "09"
    assert rows[0]["ts"].replace(tzinfo=None).date() == dt.date(2024, 1, 1)
    assert rows[1]["ts"] is None and rows[1]["message"] == "  a second line"


def test_index_reads_one_dataset(spark, tmp_path):
    path = str(tmp_path / "index")
    for name in ("a", "b", "b"):
        docs = spark.createDataFrame([("1", "row", name, [1.0])], "doc_id string, kind string, text string, embedding array<float>")
        write_index(docs, path, name)
    found = read_index(spark, path, "b")
    assert [r["text"] for r in found.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(dataset_id" in found._jdf.queryExecution().toString()


def test_report_rows(spark):
    rows = report.combine(report.report_rows(spark, [("a", "k", 1)]), report.report_rows(spark, [("b", "k", None)])).collect()
    assert [tuple(r) for r in rows] == [("a", "k", "1"), ("b", "k", None)]


def test_shared_folder_is_the_checkpoint_folder(spark):
    root = session.shared_root(spark)
    assert spark.sparkContext.getCheckpointDir().startswith(("file:" + root, root))
    assert session.shared_path(spark, "x").startswith(root + "/x-")


def test_cut_lineage_keeps_rows_and_types(spark):
    df = spark.range(10).select("id", F.array(F.col("id") * 0.5).alias("v"))
    back = session.cut_lineage(df)
    assert back.dtypes == df.dtypes and sorted(back.collect()) == sorted(df.collect())


def test_csv_keeps_every_cell(spark, tmp_path):
    from tabulon.sources.tables import load_table, write_table

    df = spark.createDataFrame([(1, ' "q", x ', None), (2, "line\nbreak", ""), (3, 'back\\slash ""', "\r\n"), (4, None, " ")],
                               "id long, a string, b string")
    path = str(tmp_path / "cells.csv")
    write_table(df, path)
    got = load_table(spark, path, schema=df.schema)
    assert sorted(got.collect()) == sorted(df.collect())


def test_readers_of_an_index_see_one_snapshot(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = lambda texts: spark.createDataFrame([(t, "row", t, [1.0]) for t in texts], "doc_id string, kind string, text string, embedding array<float>")
    texts = lambda df: sorted(r["text"] for r in df.collect())
    first = write_index(docs("abc"), path, "a")
    held = read_index(spark, path, "a")
    second = write_index(docs("xy"), path, "a")
    write_index(docs("q"), path, "b")
    assert texts(held) == ["a", "b", "c"] and texts(read_index(spark, path, "a")) == ["x", "y"]
    assert texts(read_index(spark, path)) == ["q", "x", "y"] and read_index(spark, path, "none").count() == 0
    # A write that did not end is not in the list, so no reader sees it.
    docs("z").withColumns({"dataset_id": F.lit("a"), "snapshot": F.lit("half")}).write.mode("append").partitionBy("dataset_id", "snapshot").parquet(f"{path}/vectors")
    assert texts(read_index(spark, path, "a")) == ["x", "y"]
    assert drop_old_snapshots(spark, path) == [] and drop_old_snapshots(spark, path, 0) == [first]
    assert texts(read_index(spark, path, "a")) == ["x", "y"] and current_snapshots(spark, path)["a"] == second
