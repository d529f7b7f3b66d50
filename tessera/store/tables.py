"""Tables as lists of immutable parquet segments.

A column has a number that names it inside the files.  Adding, renaming and dropping columns changes the catalogue alone:
a segment written before a column was added gives the default of its type.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.types import TYPES, default_of

Entry = dict[str, Any]
#: Segments of a table before an insert writes it anew as one.
MOST_SEGMENTS = 64


def new_entry(columns: list[tuple[str, str]]) -> Entry:
    numbered = [[i, name, kind] for i, (name, kind) in enumerate(columns or [("key", "INT"), ("value", "VARCHAR")])]
    return {"columns": numbered, "next": len(numbered), "segments": [], "rows": 0, "version": 1, "schema": uuid.uuid4().hex}


def schema_of(entry: Entry) -> T.StructType:
    return T.StructType([T.StructField(name, TYPES[kind][0]) for _, name, kind in entry["columns"]])


def read(spark: SparkSession, root: str, entry: Entry, file: str | None = None) -> DataFrame:
    """The rows of a table, with the file of each in the column ``file`` if asked for."""
    by_columns: dict[tuple[int, ...], list[str]] = {}
    for segment in entry["segments"]:
        by_columns.setdefault(tuple(segment["columns"]), []).append(f"{root}/{segment['path']}")
    parts = []
    for numbers, paths in by_columns.items():
        files = T.StructType([T.StructField(f"c{n}", TYPES[kind][0]) for n, _, kind in entry["columns"] if n in numbers])
        # A segment of which no column is left still has its rows.
        rows = spark.read.schema(files).parquet(*paths)
        parts.append(rows.select(*[(F.col(f"c{n}") if n in numbers else F.lit(default_of(kind)).cast(TYPES[kind][0])).alias(name) for n, name, kind in entry["columns"]], *([F.input_file_name().alias(file)] if file else [])))
    schema = schema_of(entry)
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema.add(file, "string") if file else schema)


def segments_with(spark: SparkSession, root: str, entry: Entry, condition: Column) -> list[dict[str, Any]]:
    """The segments that have a row the condition holds for; the driver gets at most their names."""
    rows = read(spark, root, entry, file="file of the row")
    names = rows.filter(condition).select(F.regexp_extract("file of the row", r"([0-9a-f]{32})/[^/]*$", 1)).distinct()
    found = {r[0] for r in names.collect()}
    return [s for s in entry["segments"] if s["path"].rpartition("/")[2] in found]


def write_segment(rows: DataFrame, root: str, table: str, entry: Entry) -> dict[str, Any]:
    """A new segment with the rows, whose columns are those of the table in order; nothing refers to it yet."""
    numbers = [n for n, _, _ in entry["columns"]]
    path = f"data/{table}/{uuid.uuid4().hex}"
    rows.toDF(*[f"c{n}" for n in numbers]).write.parquet(f"{root}/{path}")
    return {"path": path, "columns": numbers}
