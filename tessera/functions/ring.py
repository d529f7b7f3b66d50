"""A consistent-hash ring: which node a key belongs to, as long as few nodes come and go."""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

VIRTUAL_NODES = 10


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()[:14], 16)


class Ring:
    def __init__(self, *nodes: str, virtual_nodes: int = VIRTUAL_NODES) -> None:
        self.virtual_nodes, self.points = virtual_nodes, []
        for node in nodes:
            self.add(node)

    def add(self, node: str) -> None:
        if node not in self.nodes():
            self.points = sorted(self.points + [(_hash(f"{node}#{i}"), node) for i in range(self.virtual_nodes)])

    def remove(self, node: str) -> None:
        self.points = [p for p in self.points if p[1] != node]

    def nodes(self) -> set[str]:
        return {node for _, node in self.points}

    def _at(self, value: int) -> str:
        if not self.points:
            raise LookupError("the ring is empty")
        return self.points[bisect.bisect_left(self.points, (value, "")) % len(self.points)][1]

    def get(self, key: str) -> str:
        return self._at(_hash(key))

    def column(self, key: Column) -> Column:
        """The node of each row's key, the same as ``get`` gives for its text; null for null."""
        if not self.points:
            raise LookupError("the ring is empty")
        value = F.conv(F.substring(F.md5(key.cast("string")), 1, 14), 16, 10).cast("long")
        points = F.array(*[F.lit(p) for p, _ in self.points])
        nodes = F.array(*[F.lit(n) for _, n in self.points])
        at = F.aggregate(points, F.lit(0), lambda n, p: n + F.when(p < value, 1).otherwise(0))
        return F.when(key.isNotNull(), F.get(nodes, F.pmod(at, F.lit(len(self.points)))))
