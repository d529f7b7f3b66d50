"""Syntax trees."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Name:
    column: str
    table: str | None = None


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Unary:
    op: str  # NOT, -, IS NULL, IS NOT NULL
    operand: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class In:
    operand: Any
    values: tuple[Any, ...]


@dataclass(frozen=True)
class Between:
    operand: Any
    low: Any
    high: Any


@dataclass(frozen=True)
class Case:
    """CASE with conditions, or with ``operand`` and the values it is compared with."""

    operand: Any
    branches: tuple[tuple[Any, Any], ...]
    otherwise: Any = None


@dataclass(frozen=True)
class Cast:
    operand: Any
    kind: str


@dataclass(frozen=True)
class Subquery:
    query: Any


@dataclass(frozen=True)
class Call:
    """An aggregate, or with ``over`` a window function."""

    function: str
    argument: Any  # an expression, Star or None
    over: Over | None = None


@dataclass(frozen=True)
class Over:
    partition: tuple[Any, ...]
    order: tuple[tuple[Any, bool], ...]


@dataclass(frozen=True)
class Item:
    expression: Any
    alias: str | None = None


@dataclass(frozen=True)
class Source:
    table: str | None
    alias: str | None = None
    query: Any = None


@dataclass(frozen=True)
class Join:
    how: str  # inner, left, right, full, cross
    source: Source
    on: Any = None
    using: tuple[str, ...] | None = None  # common columns, shown once; empty for all that are common (NATURAL)


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    source: Source | None
    joins: tuple[Join, ...] = ()
    where: Any = None
    group: tuple[Any, ...] = ()
    having: Any = None
    order: tuple[tuple[Any, bool], ...] = ()
    limit: int | None = None
    offset: int = 0
    distinct: bool = False


@dataclass(frozen=True)
class With:
    steps: tuple[tuple[str, Any], ...]
    body: Any


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class DropTable:
    table: str


@dataclass(frozen=True)
class AlterTable:
    table: str
    action: str  # add, drop, rename
    column: str
    other: str | None = None  # the type or the new name


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    column: str
    kind: str = "BTREE"


@dataclass(frozen=True)
class DropIndex:
    name: str


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    rows: tuple[tuple[Any, ...], ...] = ()
    query: Any = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Any = None


@dataclass(frozen=True)
class Update:
    table: str
    values: tuple[tuple[str, Any], ...]
    where: Any = None


@dataclass(frozen=True)
class Control:
    """BEGIN, COMMIT, ROLLBACK or PREPARE."""

    word: str


@dataclass(frozen=True)
class Explain:
    statement: Any


@dataclass(frozen=True)
class Script:
    statements: tuple[Any, ...] = field(default_factory=tuple)
