"""Lowering queries to DataFrames.

Every column of a source gets an internal name of its own, so that equal names of two inputs never meet; the names of the
result are given back at the end.  A name without a qualifier means the first source that has it; in an ON comparison the
left operand looks in the inputs so far first, the right operand in the new one.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.aggregate import FUNCTIONS
from tessera.plans import tree as t
from tessera.types import TYPES


class BindError(ValueError):
    """A name or a construct that the tables don't allow."""


@dataclass
class Table:
    """What the catalogue gives for a name."""

    rows: DataFrame
    key: str | None = None


Catalogue = Callable[[str], Table]


@dataclass
class Scope:
    """Columns in order: (source name, column name, internal name)."""

    columns: list[tuple[str, str, str]] = field(default_factory=list)
    order: list[str] = field(default_factory=list)  # internal names of the primary keys
    #: Columns that USING has merged into one: found by their qualified names only.
    merged: list[tuple[str, str, str]] = field(default_factory=list)

    def find(self, name: t.Name) -> str | None:
        own = self.columns if name.table is None else self.merged + self.columns
        return next((i for s, c, i in own if c == name.column and name.table in (None, s)), None)

    def __add__(self, other: Scope) -> Scope:
        return Scope(self.columns + other.columns, self.order + other.order, self.merged + other.merged)


ARITHMETIC = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "%": operator.mod}
COMPARISONS = {"=": operator.eq, "!=": operator.ne, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def calls(node: Any) -> list[t.Call]:
    """The aggregates and windows in an expression, without those of subqueries."""
    if isinstance(node, t.Call):
        return [node]
    if isinstance(node, t.Subquery):
        return []
    if isinstance(node, tuple):
        return [c for x in node for c in calls(x)]
    return [c for x in vars(node).values() for c in calls(x)] if hasattr(node, "__dataclass_fields__") else []


class Lowering:
    def __init__(self, spark: SparkSession, catalogue: Catalogue) -> None:
        self.spark, self.catalogue, self.steps, self.sources = spark, catalogue, {}, 0

    # Queries

    def query(self, node: Any) -> DataFrame:
        if isinstance(node, t.With):
            outer = dict(self.steps)
            for name, body in node.steps:
                self.steps[name] = self.query(body)
            out = self.select(node.body)
            self.steps = outer
            return out
        return self.select(node)

    def source(self, node: t.Source) -> tuple[DataFrame, Scope]:
        if node.query is not None:
            table = Table(self.query(node.query))
        elif node.table in self.steps:
            table = Table(self.steps[node.table])
        else:
            table = self.catalogue(node.table)
        self.sources += 1
        internal = [f"s{self.sources}_{i}" for i in range(len(table.rows.columns))]
        name = node.alias or node.table or f"s{self.sources}"
        columns = [(name, c, i) for c, i in zip(table.rows.columns, internal, strict=True)]
        scope = Scope(columns, [i for _, c, i in columns if c == table.key])
        return table.rows.toDF(*internal), scope

    def from_clause(self, node: t.Select) -> tuple[DataFrame, Scope]:
        if node.source is None:
            return self.spark.range(1).select(), Scope()
        rows, scope = self.source(node.source)
        for join in node.joins:
            right, added = self.source(join.source)
            if join.using is not None:
                rows, scope = self.using(rows, scope, right, added, join)
                continue
            if join.how == "cross":
                rows = rows.crossJoin(right)
            else:
                rows = rows.join(right, self.condition(join.on, scope, added), join.how)
            scope = scope + added
        return rows, scope

    def using(self, rows: DataFrame, scope: Scope, right: DataFrame, added: Scope, join: t.Join) -> tuple[DataFrame, Scope]:
        """USING and NATURAL: common columns are equal and come first, once; of an outer join, the side that has a value."""
        common = join.using or tuple(dict.fromkeys(c for _, c, _ in scope.columns if added.find(t.Name(c)) is not None))
        pairs = [(scope.find(t.Name(c)), added.find(t.Name(c))) for c in common]
        if not pairs or any(None in p for p in pairs):
            raise BindError("no common column")
        self.sources += 1
        names = [f"u{self.sources}_{i}" for i in range(len(pairs))]
        joined = rows.join(right, reduce(operator.and_, (F.col(a) == F.col(b) for a, b in pairs)), join.how)
        joined = joined.select("*", *[F.coalesce(a, b).alias(n) for (a, b), n in zip(pairs, names, strict=True)])
        both = scope + added
        gone = {i for p in pairs for i in p}
        shown = [("", c, n) for c, n in zip(common, names, strict=True)] + [x for x in both.columns if x[2] not in gone]
        return joined, Scope(shown, both.order, both.merged + [x for x in both.columns if x[2] in gone])

    def condition(self, node: Any, left: Scope, right: Scope) -> Column:
        """An ON expression."""
        if isinstance(node, t.Binary) and node.op in ("AND", "OR"):
            a, b = self.condition(node.left, left, right), self.condition(node.right, left, right)
            return a & b if node.op == "AND" else a | b
        if isinstance(node, t.Binary) and node.op in COMPARISONS:
            return COMPARISONS[node.op](self.expression(node.left, left + right), self.expression(node.right, right + left))
        return self.expression(node, left + right)

    def select(self, node: t.Select) -> DataFrame:
        rows, scope = self.from_clause(node)
        if node.where is not None:
            rows = rows.filter(self.expression(node.where, scope))
        items = self.named_items(node, scope)
        plain = [c for e, _ in items for c in calls(e) if c.over is None] + calls(node.having) + [c for e, _ in node.order for c in calls(e) if c.over is None]
        replaced: dict[Any, str] = {}
        if node.group or plain:
            rows, scope, replaced = self.aggregated(rows, scope, node.group, plain)
        if node.having is not None:
            rows = rows.filter(self.expression(node.having, scope, replaced))
        windows = dict.fromkeys(c for e, _ in items + [(e, "") for e, _ in node.order] for c in calls(e) if c.over is not None)
        for i, call in enumerate(windows):
            rows = rows.withColumn(f"w{i}", self.window(call, scope, replaced))
            replaced[call] = f"w{i}"
        values = [self.expression(e, scope, replaced).alias(f"o{i}") for i, (e, _) in enumerate(items)]
        by_alias = {name: f"o{i}" for i, (_, name) in enumerate(items)}
        keys, extra = [], []
        for e, descending in node.order:
            # A result name first, then a column of the input, which is carried along for the sort.
            if isinstance(e, t.Name) and e.table is None and e.column in by_alias:
                key = by_alias[e.column]
            elif same := next((f"o{i}" for i, (x, _) in enumerate(items) if x == e), None):
                key = same
            else:
                key = f"k{len(extra)}"
                extra.append(self.expression(e, scope, replaced).alias(key))
            keys.append(F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_first())
        if extra and node.distinct:
            raise BindError("DISTINCT can only be ordered by columns of the result")
        out = rows.select(*values, *extra)
        if node.distinct:
            out = out.distinct()
        if keys:
            out = out.orderBy(*keys)
        if node.offset:
            out = out.offset(node.offset)
        if node.limit is not None:
            out = out.limit(node.limit)
        return out.select(*[f"o{i}" for i in range(len(items))]).toDF(*[name for _, name in items])

    def named_items(self, node: t.Select, scope: Scope) -> list[tuple[Any, str]]:
        out: list[tuple[Any, str]] = []
        for item in node.items:
            if isinstance(item.expression, t.Star):
                found = [(t.Name(c, s), c) for s, c, _ in scope.columns if item.expression.table in (None, s)]
                if not found:
                    raise BindError("no column for *")
                out += found
            else:
                out.append((item.expression, item.alias or title(item.expression)))
        return out

    # Aggregates and windows

    def aggregated(self, rows: DataFrame, scope: Scope, group: tuple[Any, ...], plain: list[t.Call]) -> tuple[DataFrame, Scope, dict[Any, str]]:
        keys = [self.expression(g, scope).alias(f"g{i}") for i, g in enumerate(group)]
        distinct = list(dict.fromkeys(plain))
        values = [self.aggregate(c, scope).alias(f"a{i}") for i, c in enumerate(distinct)]
        if values:
            out = rows.groupBy(*keys).agg(*values) if keys else rows.agg(*values)
        else:
            out = rows.select(*keys).distinct()
        replaced: dict[Any, str] = {c: f"a{i}" for i, c in enumerate(distinct)}
        columns = []
        for i, g in enumerate(group):
            replaced[g] = f"g{i}"
            if isinstance(g, t.Name):
                at = scope.find(g)
                columns += [(s, c, f"g{i}") for s, c, internal in scope.columns if internal == at]
        return out, Scope(columns, [f"g{i}" for i in range(len(group))]), replaced

    def aggregate(self, call: t.Call, scope: Scope) -> Column:
        if isinstance(call.argument, t.Star):
            return F.count(F.lit(1))
        return FUNCTIONS[call.function](self.expression(call.argument, scope))

    def window(self, call: t.Call, scope: Scope, replaced: dict[Any, str]) -> Column:
        partition = [self.expression(p, scope, replaced) for p in call.over.partition]
        order = [c.desc_nulls_last() if d else c.asc_nulls_first() for c, d in ((self.expression(e, scope, replaced), d) for e, d in call.over.order)]
        ranking = call.function in ("ROW_NUMBER", "RANK")
        # Without an order, rows come in that of the primary key.
        fallback = [F.col(k).asc_nulls_first() for k in scope.order]
        if not order and not fallback:
            raise BindError(f"{call.function} needs ORDER BY: the rows have no primary key")
        spec = Window.partitionBy(*partition).orderBy(*(order or fallback))
        if ranking:
            return (F.rank() if call.function == "RANK" and order else F.row_number()).over(spec)
        return self.aggregate(call, scope).over(spec.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    # Expressions

    def expression(self, node: Any, scope: Scope, replaced: dict[Any, str] | None = None) -> Column:
        if replaced and node in replaced:
            return F.col(replaced[node])
        recur = lambda x: self.expression(x, scope, replaced)
        match node:
            case t.Literal(value):
                return F.lit(value)
            case t.Name():
                found = scope.find(node)
                if found is None:
                    raise BindError(f"no column {node.column}")
                return F.col(found)
            case t.Unary("NOT", x):
                return ~recur(x)
            case t.Unary("-", x):
                return -recur(x)
            case t.Unary("IS NULL", x):
                return recur(x).isNull()
            case t.Unary("IS NOT NULL", x):
                return recur(x).isNotNull()
            case t.Binary("AND", a, b):
                return recur(a) & recur(b)
            case t.Binary("OR", a, b):
                return recur(a) | recur(b)
            case t.Binary("LIKE", a, b):
                return F.like(recur(a), recur(b))
            case t.Binary("||", a, b):
                return F.concat(recur(a), recur(b))
            case t.Binary(op, a, b) if op in COMPARISONS:
                return COMPARISONS[op](recur(a), recur(b))
            case t.Binary(op, a, b):
                return ARITHMETIC[op](recur(a), recur(b))
            case t.Case(operand, branches, otherwise):
                tests = [recur(c) if operand is None else recur(operand) == recur(c) for c, _ in branches]
                out = reduce(lambda w, b: w.when(*b), zip(tests, (recur(v) for _, v in branches), strict=True), F)
                return out if otherwise is None else out.otherwise(recur(otherwise))
            case t.Cast(x, kind):
                return recur(x).cast(TYPES[kind][0])
            case t.Between(x, low, high):
                return recur(x).between(recur(low), recur(high))
            case t.In(x, (t.Subquery(query),)):
                return recur(x).isin(self.query(query))
            case t.In(x, values):
                return recur(x).isin(*[recur(v) for v in values])
            case t.Subquery(query):
                return self.query(query).scalar()
            case t.Call():
                raise BindError(f"{node.function} isn't allowed here")
        raise BindError(f"can't lower {node}")


def title(node: Any) -> str:
    """The name of a result column without an alias."""
    if isinstance(node, t.Name):
        return node.column
    if isinstance(node, t.Call):
        inner = "*" if isinstance(node.argument, t.Star) else "" if node.argument is None else title(node.argument)
        return f"{node.function.lower()}({inner})"
    return "value"
