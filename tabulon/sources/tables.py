"""Table readers and the result writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.sources.csv_blocks import header_names, parse_records, record_lines

FORMATS = ("csv", "json", "parquet")
#: Rows of a task of a fit: about 220 bytes each in a tree over three columns.
TASK_ROWS = 1 << 19
#: What an empty cell is read as before it becomes null; a quoted empty cell stays the empty text.
_NO_CELL = "\u0000"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sampling_ratio: float = 1.0,
             multi_line: bool | None = None, block_bytes: int | None = None) -> DataFrame:
    """CSV with a header, cells in quotes where they need it, quotes in them doubled. A schema saves the pass that infers
    types.

    Files are read in blocks by many tasks, also where cells hold line breaks: a pass over the blocks tells where records
    end, and only files with such cells are rewritten as records. `block_bytes` is the size of a block, for this pass alone.
    `multi_line=True` takes each file as one task, which also reads quotes in the middle of cells that have none around them
    and folders that stand for columns; `multi_line=False` ends records at every line break without looking."""
    reader = spark.read.options(header=True, multiLine=bool(multi_line), quote='"', escape='"', nullValue=_NO_CELL)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("samplingRatio", sampling_ratio).option("inferSchema", True)
    if multi_line is not None:
        return reader.csv(path)
    plain, records = record_lines(path, spark, block_bytes)
    if plain:
        return reader.csv(path)
    names = None
    if schema is None:
        header = records.filter("first").agg(F.min_by("record", "file")).head()[0]
        names = header_names(header or "")
    return parse_records(records, reader.option("header", False).option("multiLine", True), names)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              document: bool = False) -> DataFrame:
    """JSON lines, which Spark splits; with `document`, one JSON document per file (an array gives one row each)."""
    reader = spark.read.option("multiLine", document)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def format_of(path: str) -> str:
    """The text after the last dot, in lower case."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    suffix = name.rsplit(".", 1)[-1].lower()
    if not name or suffix not in FORMATS:
        raise ValueError(f"unsupported file format {name!r}; supported are {', '.join('.' + f for f in FORMATS)}")
    return suffix


def load_table(spark: SparkSession, path: str, fmt: str | None = None,
               schema: T.StructType | str | None = None, document: bool = False) -> DataFrame:
    if not path:
        raise ValueError("no path was given")
    fmt = fmt or format_of(path)
    if fmt == "csv":
        return read_csv(spark, path, schema)
    if fmt == "json":
        return read_json(spark, path, schema, document)
    if fmt == "parquet":
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    raise ValueError(f"unsupported file format {fmt!r}")


def spread_scan(df: DataFrame) -> DataFrame:
    """For a plain scan that has fewer splits than there are cores, ahead of work that is heavy per row.

    A table of many files is left as it is: no shuffle is added where the scan is wide enough.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def bounded_tasks(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """For rows that a fit holds and reads again and again: no task has more than about `task_rows` of them, however large
    the splits of the scan are. A table of one such task is left as it is."""
    parts = -(-df.count() // task_rows)
    return df if parts <= 1 else df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism))


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """The result: input columns plus labels, no index column. One file per task."""
    if fmt == "csv":
        df.write.mode(mode).options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                                    ignoreTrailingWhiteSpace=False, lineSep="\n").csv(path)
    elif fmt in FORMATS:
        df.write.mode(mode).format(fmt).save(path)
    else:
        raise ValueError(f"unsupported file format {fmt!r}")
