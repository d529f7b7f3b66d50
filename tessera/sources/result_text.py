"""Result sets as text: values joined by a bar, a line per row, then ``OK``."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.types import shown

SEPARATOR = " | "


def format_row(values: Sequence[Any]) -> str:
    return SEPARATOR.join(map(shown, values))


def format_rows(values: Iterable[Sequence[Any]]) -> str:
    return "".join(f"{format_row(v)}\n" for v in values) + "OK\n"


def _shown_column(field: T.StructField) -> Column:
    value = F.col(f"`{field.name}`")
    text = F.lower(F.hex(value)) if isinstance(field.dataType, T.BinaryType) else value.cast("string")
    return F.coalesce(text, F.lit("NULL"))


def as_lines(df: DataFrame) -> DataFrame:
    """One string column ``line``; for sinks that take text, without a row passing through the driver."""
    return df.select(F.concat_ws(SEPARATOR, *[_shown_column(f) for f in df.schema.fields]).alias("line"))
