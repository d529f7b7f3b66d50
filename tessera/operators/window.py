"""Window functions: each adds a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.operators.aggregate import aggregate_of


def order_key(column: str, descending: bool = False) -> Column:
    """Nulls come first upwards and last downwards."""
    return F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_first()


def spec(partition: Sequence[str], order: Sequence[tuple[str, bool]], fallback: Sequence[str] = ()) -> WindowSpec:
    """``fallback``: the order that rows have if none is given, such as that of the primary key."""
    keys = [order_key(*o) for o in order] or [order_key(c) for c in fallback]
    if not keys:
        raise ValueError("a ranking needs an order")
    return Window.partitionBy(*partition).orderBy(*keys)


def row_number(df: DataFrame, name: str, partition: Sequence[str], order: Sequence[tuple[str, bool]], fallback: Sequence[str] = ()) -> DataFrame:
    return df.withColumn(name, F.row_number().over(spec(partition, order, fallback)))


def rank(df: DataFrame, name: str, partition: Sequence[str], order: Sequence[tuple[str, bool]], fallback: Sequence[str] = ()) -> DataFrame:
    """Equal keys share a rank and leave a gap; without an order it is the row number in the fallback order."""
    function = F.rank() if order else F.row_number()
    return df.withColumn(name, function.over(spec(partition, order, fallback)))


def running(df: DataFrame, name: str, function: str, column: str, partition: Sequence[str], order: Sequence[tuple[str, bool]], fallback: Sequence[str] = ()) -> DataFrame:
    """SUM, COUNT, MIN, MAX or AVG of the rows from the first of the partition to this one: equal keys don't share a value."""
    frame = spec(partition, order, fallback).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, aggregate_of(function, column).over(frame))
