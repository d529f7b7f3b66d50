"""Connected components by alternating large and small stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): each node that has an edge, and the least node it is connected with.

    ``edges`` has long columns a and b, in any order, repeats and loops allowed.  A round links every node to the least of
    its neighbours, first the larger neighbours, then the smaller ones; the number of rounds grows with the logarithm of a
    component's size.  Least neighbours are aggregated partially before the shuffle, and the joins are plain equalities
    that adaptive execution splits at a hub.
    """
    current = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    print_of = None
    for _ in range(max_rounds):
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down).filter("u <> v").distinct()
        current = staged(small, "cc-edges")
        seen = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == print_of:
            break
        print_of = seen
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return current.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").union(current.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root")))
