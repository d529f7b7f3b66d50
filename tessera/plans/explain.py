"""Plan text: the physical plan of a statement's query as Spark has chosen it, two spaces deeper a level."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame


def described(node: Any) -> str:
    """An operator's name, with the filters that a scan evaluates on the statistics and rows of its files."""
    name = node.nodeName().strip()
    pushed = node.metadata().get("PushedFilters") if name.startswith("Scan") else None
    filters = pushed.get() if pushed is not None and pushed.isDefined() else "[]"
    return name if filters == "[]" else f"{name} {filters}"


def tree_lines(node: Any, depth: int = 0) -> list[str]:
    children = node.children()
    return [f"{'  ' * depth}-> {described(node)}"] + [line for i in range(children.size()) for line in tree_lines(children.apply(i), depth + 1)]


def plan_lines(query: DataFrame, change: str | None = None) -> list[str]:
    """The plan before stages are cut and code is generated; a change of a table is a node above its query."""
    lines = tree_lines(query._jdf.queryExecution().sparkPlan())
    return lines if change is None else [f"-> {change}", *[f"  {line}" for line in lines]]
