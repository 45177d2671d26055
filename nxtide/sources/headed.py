"""Delimited text with several header rows in each file, written and read by place."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a level that a column does not have is written as.
NONE = "-"
#: How values are written and read.
CSV = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: What a quoted empty value is read as before it becomes an empty text; an unquoted one is null.
EMPTY = "\x01empty"


def write_headed(df: DataFrame, path: str, levels: dict[str, tuple], mode: str = "errorifexists") -> None:
    """Writes df as CSV; each file begins with as many header rows as levels has parts for each column.

    Parts are joined to a column's name by _ when they are read; levels[c] gives those of c, padded with `-`. Values are written by the JVM, the header
    rows are put before each task's lines. A value with a line break fails the write, as lines are rows. A table without
    rows may leave no file.
    """
    rows = max((len(p) for p in levels.values()), default=1)
    cell = lambda s: '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\n') else s
    heads = [",".join(cell(([*levels.get(c, (c,)), *[NONE] * rows])[k]) for c in df.columns) for k in range(rows)]

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(heads)], ["value"])
        yield from batches

    line = F.to_csv(F.struct(*(F.col(c) for c in df.columns)), CSV | {"emptyValue": '""', "nullValue": ""})
    checked = F.when(line.contains("\n") | line.contains("\r"), F.raise_error(F.lit("a value has a line break"))).otherwise(line)
    df.select(checked.alias("value")).mapInArrow(headed, "value string").write.mode(mode).text(path)


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, value): the lines of files, with their place in the stretch of the file that a task reads: the place in the file for its beginning, else null."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = None, 0
        for batch in batches:
            places = []
            for file, begin in zip(batch.column("file").to_pylist(), batch.column("begin").to_pylist()):
                n = n + 1 if now == (file, begin) else 0
                now = (file, begin)
                places.append(n if begin == 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(places, pa.int64()), batch.column("value")], ["file", "place", "value"])

    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), "value").mapInArrow(placed, "file string, place long, value string")


def read_headed(spark: SparkSession, path: str, levels: int, schema: str | None = None) -> DataFrame:
    """The rows of files whose first `levels` lines are header rows; columns are named by their parts joined by _, or all strings' types by schema.

    Headers are told by their place in the file, so that a row that looks like one stays. Columns take their names from the
    first file by name; the files' columns must be in that order. Without files or lines there is nothing to name: schema is needed.
    """
    lines = placed_lines(spark, path)
    first = lines.filter(F.col("place") < levels).agg(F.min("file").alias("file"))
    heads = [r["value"] for r in lines.filter(F.col("place") < levels).join(F.broadcast(first), "file").orderBy("place").collect()]
    if heads:
        width = max(len(next(_cells(h))) for h in heads)
        rows = [next(_cells(h)) for h in heads]
        names = ["_".join(p for r in rows if len(r) > i and (p := r[i]) and p != NONE) or f"c{i}" for i in range(width)]
    elif schema is None:
        raise ValueError(f"no header rows in {path}")
    else:
        names = []
    held = schema or ", ".join(f"`{n}` string" for n in names)
    options = CSV | {"emptyValue": EMPTY}
    parsed = lines.filter(F.col("place").isNull() | (F.col("place") >= levels)).select(F.from_csv("value", held, options).alias("r")).select("r.*")
    parsed = parsed.select(*(F.when(F.col(f"`{c}`") == EMPTY, "").otherwise(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in parsed.dtypes))
    return parsed if schema is None or not names else parsed.toDF(*names) if len(names) == len(parsed.columns) else parsed


def _cells(line: str) -> Iterator[list[str]]:
    import csv

    return csv.reader([line])
