"""Joins.  Output columns are the left ones, then the right ones; null keys never match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, DataType, IntegralType

from tessera.operators.predicate import all_of, compare

#: Of `block_join`: rows of a chunk, whose pairs with another chunk are made at once, and chunks of a block, two of which are dealt.
CHUNK_ROWS = 128
BLOCK_CHUNKS = 16
ORDERS = frozenset({"<", "<=", ">", ">="})


def sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two inputs under the names l and r, so that equal column names can be told apart."""
    return left.alias("l"), right.alias("r")


def on(left_column: str, op: str, right_column: str) -> Column:
    """A condition whose left name means the left input and whose right name means the right one."""
    return compare(F.col(f"l.{left_column}"), op, F.col(f"r.{right_column}"))


def hash_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner equi-join by hash tables; the planner still broadcasts a side whose size it knows to be small."""
    l, r = sides(left, right)
    return l.hint("shuffle_hash").join(r, on(left_key, "=", right_key), "inner")


def sort_merge_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    l, r = sides(left, right)
    return l.join(r.hint("merge"), on(left_key, "=", right_key), "inner")


def join(left: DataFrame, right: DataFrame, conditions: Sequence[tuple[str, str, str]], how: str = "inner", residual: Column | None = None) -> DataFrame:
    """Inner, left, right or full join on any comparisons; equalities become keys, the rest a residual condition."""
    if how == "inner" and _in_blocks(left, right, conditions):
        return block_join(left, right, conditions, residual)
    l, r = sides(left, right)
    condition = all_of(*[on(*c) for c in conditions])
    return l.join(r, condition if residual is None else condition & residual, how)


def _in_blocks(left: DataFrame, right: DataFrame, conditions: Sequence[tuple[str, str, str]]) -> bool:
    """Whether `block_join` can run: keys and an order, each of one type on both sides, and columns that can be sorted."""

    def alike(a: DataType, b: DataType) -> bool:
        return a == b or (isinstance(a, IntegralType) and isinstance(b, IntegralType))

    ops = {op for _, op, _ in conditions}
    if "=" not in ops or not ops & ORDERS:
        return False
    for df in (left, right):
        lowered = [c.lower() for c in df.columns]
        if len(set(lowered)) < len(lowered) or not all(isinstance(f.dataType, AtomicType) for f in df.schema.fields):
            return False
    types = [{f.name: f.dataType for f in df.schema.fields} for df in (left, right)]
    return all(a in types[0] and b in types[1] and alike(types[0][a], types[1][b]) for a, _, b in conditions)


def _blocks(df: DataFrame, side: str, keys: Sequence[str], value: str, compared: Sequence[str]) -> DataFrame:
    """A row per block: its keys, its number, its least and greatest value, and its chunks of rows with theirs.

    Rows of a key are cut in the order of the value, then of all columns: whatever order they come in, blocks are the same.
    """
    here = df.filter(all_of(*[F.col(_quoted(c)).isNotNull() for c in compared]))
    named = [f"{side}_key{i}" for i in range(len(keys))]
    rows = here.select(*[F.col(_quoted(k)).alias(n) for k, n in zip(keys, named, strict=True)], F.col(_quoted(value)).alias("value"), F.struct(*[_quoted(c) for c in df.columns]).alias("row"))
    place = F.row_number().over(Window.partitionBy(*named).orderBy("value", "row")) - 1
    chunks = rows.withColumn("chunk", F.floor(place / CHUNK_ROWS)).groupBy(*named, "chunk").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.collect_list("row").alias("rows"))
    blocks = chunks.withColumn(f"{side}_block", F.floor(F.col("chunk") / BLOCK_CHUNKS)).groupBy(*named, f"{side}_block")
    chunk = F.struct(*[F.col(c).alias(f"{side}_{c}") for c in ("least", "most", "rows")])
    return blocks.agg(F.min("least").alias(f"{side}_from"), F.max("most").alias(f"{side}_to"), F.collect_list(chunk).alias(f"{side}_chunks"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def block_join(left: DataFrame, right: DataFrame, conditions: Sequence[tuple[str, str, str]], residual: Column | None = None) -> DataFrame:
    """Inner join on equalities and an order, whose result can be far larger than its inputs: few keys, many pairs of each.

    Each key's rows are cut into blocks by value. Every two blocks that can hold a pair are a row, which is dealt by its own
    hash: the work of one key spreads over all tasks, and a task holds two blocks at once, however many rows a key has.
    """
    spark = left.sparkSession
    equal = [(a, b) for a, op, b in conditions if op == "="]
    first, op, second = next(c for c in conditions if c[1] in ORDERS)
    ls = _blocks(left, "l", [a for a, _ in equal], first, [a for a, _, _ in conditions])
    rs = _blocks(right, "r", [b for _, b in equal], second, [b for _, _, b in conditions])
    rising = op in ("<", "<=")
    same = all_of(*[F.col(f"l_key{i}") == F.col(f"r_key{i}") for i in range(len(equal))])
    met = ls.join(rs.hint("merge"), same & compare("l_from" if rising else "l_to", op, F.col("r_to" if rising else "r_from")))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.repartition(tasks, *[f"l_key{i}" for i in range(len(equal))], "l_block", "r_block")
    chunks = dealt.select("r_chunks", F.inline("l_chunks")).select("l_least", "l_most", "l_rows", F.inline("r_chunks"))
    chunks = chunks.filter(compare("l_least" if rising else "l_most", op, F.col("r_most" if rising else "r_least"))).select("l_rows", "r_rows")
    # Generated code keeps all that one input row yields. coalesce, which moves nothing here, ends it at the pair of chunks:
    # otherwise the pairs of two whole blocks, millions, would wait in memory.
    chunks = chunks.coalesce(tasks)
    names = [", ".join(_quoted(c) for c in df.columns) for df in (left, right)]
    pairs = spark.sql(f"SELECT l.*, r.* FROM {{chunks}} LATERAL VIEW inline(l_rows) l AS {names[0]} LATERAL VIEW inline(r_rows) r AS {names[1]}", chunks=chunks)
    condition = all_of(*[on(*c) for c in conditions if c[1] != "="])
    return pairs.filter(condition if residual is None else condition & residual)


def filter_then_join(left: DataFrame, condition: Column, right: DataFrame, conditions: Sequence[tuple[str, str, str]], how: str) -> DataFrame:
    """The left input is filtered before the join: a right or full join keeps right rows without a filtered partner."""
    return join(left.filter(condition), right, conditions, how)


def join_filter(left: DataFrame, right: DataFrame, conditions: Sequence[tuple[str, str, str]], condition: Column, how: str = "inner") -> DataFrame:
    """The condition sees the joined rows, as SQL's WHERE does."""
    return join(left, right, conditions, how).filter(condition)
