"""Predicates and projections."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE: dict[str, Callable[[Any, Any], Any]] = {"=": operator.eq, "!=": operator.ne, "<>": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def compare(left: Column | str, op: str, right: Any) -> Column:
    """``left`` is a column or its name; ``right`` a column or a literal.  Null compares as unknown."""
    return COMPARE[op](F.col(left) if isinstance(left, str) else left, right if isinstance(right, Column) else F.lit(right))


def all_of(*conditions: Column) -> Column:
    return reduce(operator.and_, conditions, F.lit(True))


def any_of(*conditions: Column) -> Column:
    return reduce(operator.or_, conditions, F.lit(False))


def filter_rows(df: DataFrame, *conditions: Column) -> DataFrame:
    return df.filter(all_of(*conditions))


def project(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.select(*columns)


def project_at(df: DataFrame, *positions: int) -> DataFrame:
    """Columns by position, from 0."""
    return df.select(*[df[df.columns[i]] for i in positions])


def compare_scalar(df: DataFrame, column: str, op: str, subquery: DataFrame) -> DataFrame:
    """Rows that compare with the one value of an uncorrelated subquery.

    No row of the subquery counts as null and leaves no rows; more than one raises.
    """
    return df.filter(compare(column, op, subquery.scalar()))
