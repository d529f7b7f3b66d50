"""Common table expressions: named steps, each seeing the ones before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Step = Callable[[dict[str, DataFrame]], DataFrame]


def with_steps(tables: dict[str, DataFrame], body: Step, **steps: Step) -> DataFrame:
    """The names of the steps hide tables of the same name, in this query only."""
    known = dict(tables)
    for name, step in steps.items():
        known[name] = step(known)
    return body(known)
