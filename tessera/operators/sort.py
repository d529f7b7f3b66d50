"""Sorting, limits and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tessera.operators.window import order_key


def order_by(df: DataFrame, *keys: tuple[str, bool]) -> DataFrame:
    """``keys``: (column, descending).  A range-partitioned sort; nulls come first upwards and last downwards."""
    return df.orderBy(*[order_key(*k) for k in keys])


def limit(df: DataFrame, count: int | None = None, offset: int = 0) -> DataFrame:
    skipped = df.offset(offset) if offset else df
    return skipped if count is None else skipped.limit(count)


def top_k(df: DataFrame, keys: Sequence[tuple[str, bool]], count: int, offset: int = 0) -> DataFrame:
    """Sort and limit: Spark keeps ``count + offset`` rows of each partition and never sorts the whole."""
    return limit(order_by(df, *keys), count, offset)
