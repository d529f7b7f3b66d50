"""Parquet tables in a folder, and literal rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tessera.types import spark_schema, to_value

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, *names: str) -> None:
    """Make tables of a folder known to ``spark.sql`` by their names."""
    for name in names or DRIVER_TABLES:
        table(spark, folder, name).createOrReplaceTempView(name)


def rows(spark: SparkSession, columns: list[tuple[str, str]], values: Sequence[Sequence[Any]]) -> DataFrame:
    """Literal rows of a table with typed columns; a value that doesn't fit its column raises TypeMismatch."""
    if any(len(v) != len(columns) for v in values):
        raise ValueError(f"a row has {len(columns)} values")
    return spark.createDataFrame([tuple(to_value(x, kind) for x, (_, kind) in zip(v, columns, strict=True)) for v in values], spark_schema(columns))
