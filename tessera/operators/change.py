"""Inserts, deletes, updates and schema changes as transformations: the result is the table's next version."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.types import TYPES, default_of


def insert_rows(df: DataFrame, rows: Sequence[Sequence[Any]]) -> DataFrame:
    return df.unionByName(df.sparkSession.createDataFrame([tuple(r) for r in rows], df.schema))


def insert_from(df: DataFrame, source: DataFrame) -> DataFrame:
    """The rows of a query, by position, cast to the table's types."""
    fields = df.schema.fields
    if len(source.columns) != len(fields):
        raise ValueError(f"{len(source.columns)} columns for {len(fields)}")
    return df.union(source.toDF(*df.columns).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in fields]))


def delete_rows(df: DataFrame, condition: Column | None = None) -> DataFrame:
    """Rows for which the condition isn't true stay."""
    return df.filter(~F.coalesce(condition, F.lit(False))) if condition is not None else df.limit(0)


def update_rows(df: DataFrame, values: Mapping[str, Any], condition: Column | None = None) -> DataFrame:
    """Where the condition is true the columns take the new values, literals or expressions over the old row."""
    hit = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    new = {c: (v if isinstance(v, Column) else F.lit(v)).cast(kinds[c]) for c, v in values.items()}
    return df.select(*[F.when(hit, new[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in new else F.col(f"`{c}`") for c in df.columns])


def add_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    """Old rows read the default of the type."""
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    return df.withColumn(name, F.lit(default_of(kind)).cast(TYPES[kind][0]))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        raise ValueError(f"no column {name}")
    return df.drop(name)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    if old not in df.columns or new in df.columns:
        raise ValueError(f"can't rename {old} to {new}")
    return df.withColumnRenamed(old, new)
