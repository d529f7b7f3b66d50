"""Aggregation; Spark aggregates partially before the shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FUNCTIONS: dict[str, Callable[[str], Column]] = {"COUNT": F.count, "SUM": F.sum, "MIN": F.min, "MAX": F.max, "AVG": F.avg}


def aggregate_of(function: str, column: str = "*") -> Column:
    """COUNT(*) counts rows, COUNT(column) those that aren't null; the others need a column."""
    if column == "*":
        if function != "COUNT":
            raise ValueError(f"{function} needs a column")
        return F.count(F.lit(1))
    return FUNCTIONS[function](column)


def aggregate(df: DataFrame, keys: Sequence[str], **named: tuple[str, str]) -> DataFrame:
    """``named``: result column = (function, column).  Nulls in a key form one group; without keys there is one row."""
    columns = [aggregate_of(*spec).alias(name) for name, spec in named.items()]
    return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)


def having(df: DataFrame, keys: Sequence[str], condition: Column, **named: tuple[str, str]) -> DataFrame:
    return aggregate(df, keys, **named).filter(condition)


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """GROUP BY without an aggregate."""
    return df.select(*keys).distinct()
