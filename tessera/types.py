"""The engine's column types, their Spark types, defaults and literals."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import types as T

#: Name of a type in SQL: (Spark type, value that rows written before ADD COLUMN read).
TYPES: dict[str, tuple[T.DataType, Any]] = {
    "INT": (T.LongType(), 0),
    "SIGNED_INT": (T.LongType(), 0),
    "VARCHAR": (T.StringType(), ""),
    "BOOL": (T.BooleanType(), False),
    "FLOAT": (T.DoubleType(), 0.0),
    "TIMESTAMP": (T.LongType(), 0),
    "JSON": (T.StringType(), "{}"),
    "UUID": (T.BinaryType(), bytes(16)),
}


class TypeMismatch(ValueError):
    """A value doesn't fit the type of its column."""


def spark_schema(columns: list[tuple[str, str]]) -> T.StructType:
    """The schema of a table; a table without columns is a store of keys and values."""
    return T.StructType([T.StructField(name, TYPES[kind][0]) for name, kind in columns or [("key", "INT"), ("value", "VARCHAR")]])


def default_of(kind: str) -> Any:
    return TYPES[kind][1]


def to_value(value: Any, kind: str) -> Any:
    """A Python value of the column type; None stays None.  INT is unsigned and ends at 2**63 - 1."""
    if value is None:
        return None
    if kind in ("INT", "SIGNED_INT", "TIMESTAMP"):
        if isinstance(value, bool) or not isinstance(value, int) and not (isinstance(value, float) and value.is_integer()):
            raise TypeMismatch(f"{value!r} is no {kind}")
        value = int(value)
        if not -(1 << 63) <= value < 1 << 63 or kind == "INT" and value < 0:
            raise TypeMismatch(f"{value} is out of the range of {kind}")
        return value
    if kind == "FLOAT":
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise TypeMismatch(f"{value!r} is no FLOAT")
        return float(value)
    if kind == "BOOL":
        if not isinstance(value, bool):
            raise TypeMismatch(f"{value!r} is no BOOL")
        return value
    if kind == "UUID":
        if isinstance(value, bytes) and len(value) == 16:
            return value
        try:
            return uuid.UUID(str(value)).bytes
        except ValueError as e:
            raise TypeMismatch(f"{value!r} is no UUID") from e
    if not isinstance(value, str):
        raise TypeMismatch(f"{value!r} is no {kind}")
    return value


def shown(value: Any) -> str:
    """A value as result text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
    return str(value)
