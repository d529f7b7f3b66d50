"""Scans.  A parquet table has no index: an index lookup is a filter that the scan itself evaluates on row group statistics."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seq_scan(df: DataFrame) -> DataFrame:
    return df


def index_scan_eq(df: DataFrame, column: str, value: Any) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value))


def index_scan_range(df: DataFrame, column: str, low: Any, high: Any) -> DataFrame:
    """Both ends included."""
    return df.filter(F.col(column).between(low, high))


def search(df: DataFrame, key: str, value: Any) -> DataFrame:
    """At most one row of the key."""
    return index_scan_eq(df, key, value).limit(1)


def in_memory_insert(df: DataFrame, name: str) -> DataFrame:
    """Name the rows of ``df`` for SQL text in this session; one row with their number."""
    df.createOrReplaceTempView(name)
    return df.agg(F.count(F.lit(1)).alias("n"))


def in_memory_scan(df: DataFrame, name: str) -> DataFrame:
    """The rows under a name that SQL text can use in this session; planned anew at each use."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)
