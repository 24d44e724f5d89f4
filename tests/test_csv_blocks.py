"""CSV read in blocks: records whose cells hold line breaks, against Python's reader and DuckDB's."""

import csv
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tabulon.sources.csv_blocks import block_states, header_names, record_lines
from tabulon.sources.csv_blocks import _lines
from tabulon.sources.tables import load_table, read_csv, write_table

PARTS = ["a", "b c", "\n", "\n\n", '"', '""', ",", "\r\n", "é", " ", "x" * 40, "'", "\n,\n", '",\n"', "→"]


def table_of(n, seed):
    draw = random.Random(seed)
    text = lambda: "".join(draw.choice(PARTS) for _ in range(draw.randrange(9)))
    return [[str(i), text(), "x" + text() + "x", str(draw.random())] for i in range(n)]


def write(path, rows, header=("k", "s", "t", "x"), end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(header)
        out.writerows(rows)


def sorted_rows(df):
    return sorted((int(r.k), r.s or "", r.t, float(r.x)) for r in df.collect())


@pytest.mark.parametrize("block,end", [(300, "\n"), (700, "\r\n"), (1 << 30, "\n")])
def test_records_across_blocks(spark, tmp_path, block, end):
    rows = table_of(130, block)
    path = str(tmp_path / "t.csv")
    write(path, rows, end=end)
    want = sorted((int(k), s, t, float(x)) for k, s, t, x in rows)
    got = read_csv(spark, path, block_bytes=block)
    assert sorted_rows(got) == want
    assert dict(got.dtypes) == {"k": "int", "s": "string", "t": "string", "x": "double"}
    assert sorted_rows(read_csv(spark, path, "k int, s string, t string, x double", block_bytes=block)) == want
    if end == "\n":
        found = duckdb.sql(f"SELECT k, coalesce(s, ''), t, x FROM read_csv('{path}', header = true, quote = '\"', escape = '\"', "
                           "columns = {'k': 'INT', 's': 'VARCHAR', 't': 'VARCHAR', 'x': 'DOUBLE'}, parallel = false)").fetchall()
        assert sorted(found) == want
    # The setting is as it was, and the file was cut.
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != str(block)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        blocks = block_states(_lines(spark, path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert (len(blocks) > 10) == (block <= 1000)
    assert any(b.inside for b in blocks) == (block <= 1000)


def test_folder_of_files(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    rows = table_of(120, 5)
    for i in range(3):
        write(folder / f"part-{i}.csv", rows[i::3])
    assert sorted_rows(load_table(spark, str(folder))) == sorted((int(k), s, t, float(x)) for k, s, t, x in rows)
    assert sorted_rows(read_csv(spark, str(folder), block_bytes=500)) == sorted((int(k), s, t, float(x)) for k, s, t, x in rows)


def test_one_cell_over_many_blocks(spark, tmp_path):
    long = "\n".join(f"line {i} of a cell" for i in range(400))
    path = str(tmp_path / "long.csv")
    write(path, [["1", "", "a", "0.5"], ["2", "q\nq", long, "1.5"], ["3", "", "b", "2.5"]])
    got = read_csv(spark, path, block_bytes=900)
    assert sorted_rows(got) == [(1, "", "a", 0.5), (2, "q\nq", long, 1.5), (3, "", "b", 2.5)]


def test_lines_that_are_records_stay_with_sparks_reader(spark, tmp_path):
    path = str(tmp_path / "plain.csv")
    write(path, [["1", 'a "b"', "c,d", "0.5"]] * 30)
    assert record_lines(path, spark, 200) == (True, None)
    got = read_csv(spark, path, block_bytes=200)
    assert got.count() == 30 and "FileScan csv" in got._jdf.queryExecution().toString()


def test_headers_and_odd_files(spark, tmp_path):
    assert header_names("\ufeffa,,b,A") == ["a0", "_c1", "b", "A3"]
    path = tmp_path / "h.csv"
    path.write_text('"two\nlines",b\n\n\n1,"x\n\ny"\n\n2,\n', newline="")
    got = read_csv(spark, str(path), block_bytes=8)
    assert got.columns == ["two\nlines", "b"]
    assert sorted((r[0], r[1]) for r in got.collect()) == [(1, "x\n\ny"), (2, None)]
    (tmp_path / "only.csv").write_text('a,"b\nc"\n')
    assert read_csv(spark, str(tmp_path / "only.csv")).count() == 0
    (tmp_path / "open.csv").write_text('a,b\n1,"never\nclosed\n')
    assert [r.a for r in read_csv(spark, str(tmp_path / "open.csv"), block_bytes=6).collect()] == [1]


def test_written_texts_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"\n\nthere', ""), (2, None, "\n"), (3, "", " pad ")], "k int, s string, t string")
    path = str(tmp_path / "back.csv")
    write_table(df, path)
    assert sorted(map(tuple, read_csv(spark, path, df.schema, block_bytes=16).collect())) == sorted(map(tuple, df.collect()))
    assert read_csv(spark, path).where(F.col("s").isNull()).count() == 1
