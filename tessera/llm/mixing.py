"""Mixing sources to target weights by the cube method of balanced sampling.

A source's rate (target over size) gives every document a whole number of copies and a fractional inclusion probability.
The flight phase moves three fractional probabilities at a time along the null space of the two balancing constraints (their
sum, and their sum weighted with size), so both totals stay as they are, until each is 0 or 1.  A block of bounded size
leaves at most two undecided; those of many blocks meet in blocks of the next level, until one block per source is left.
Its flight stops at twelve, and the landing draws one of the roundings of these that bring the source nearest to its target:
so the chances of a source's last twelve units are kept only nearly.
"""

from __future__ import annotations

import math
import zlib
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import OWN, prepare_workers, repeat_rows, repeated, row_key, staged, word_count

EPS = 1e-9
#: Undecided units that the landing of a source's last block rounds, by trying all ways.
LANDING = 12


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, n) with rank, weight and target, a double: water filled by weight up to ``cap`` times the size.

    Sources are ranked by code point, null last; weights repeat along the ranks.  The table has one row per source.
    """
    by_rank = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    rank = F.row_number().over(by_rank)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", left / open_weight)
    first = F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(every)
    return levels.withColumn("level", first["level"]).withColumn("target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap"))).drop("level")


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator, left: int = 2) -> np.ndarray:
    """Move the probabilities along the null space until at most ``left`` (two or more) are fractional."""
    pi = pi.copy()
    # Every step decides a unit at least, so there are no more steps than units.
    draws = iter(rng.random(len(pi) + 4))
    pool: list[int] = []
    for k in range(len(pi)):
        if EPS < pi[k] < 1 - EPS:
            pool.append(k)
        while len(pool) > left or (left == 2 and len(pool) > 1):
            # Units of equal size already have a null vector between two of them.
            pair = next(((a, b) for i, a in enumerate(pool) for b in pool[i + 1 :] if size[a] == size[b]), None)
            if pair:
                idx, u = pair, (1.0, -1.0)
            elif len(pool) >= 3:
                idx = tuple(pool[:3])
                s1, s2, s3 = (float(size[i]) for i in idx)
                u = (s3 - s2, s1 - s3, s2 - s1)
            else:
                break
            up = min((1 - pi[i]) / x if x > 0 else pi[i] / -x for i, x in zip(idx, u, strict=True) if x)
            down = min(pi[i] / x if x > 0 else (1 - pi[i]) / -x for i, x in zip(idx, u, strict=True) if x)
            step = up if next(draws) * (up + down) < down else -down
            for i, x in zip(idx, u, strict=True):
                pi[i] = min(1.0, max(0.0, pi[i] + step * x))
            pool = [i for i in pool if EPS < pi[i] < 1 - EPS]
    return np.where(pi <= EPS, 0.0, np.where(pi >= 1 - EPS, 1.0, pi))


def landing(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator, choices: int = 8) -> np.ndarray:
    """Round the few fractional ones: one of the ``choices`` ways that come nearest to the words and rows there were to be.

    A way is drawn with the chance that its units would have been drawn one by one.
    """
    open_ = np.flatnonzero((pi > 0) & (pi < 1))
    if not len(open_):
        return pi
    ways = np.array(list(product((0.0, 1.0), repeat=len(open_))))
    words = np.abs(ways @ size[open_] - pi[open_] @ size[open_])
    rows = np.abs(ways.sum(axis=1) - pi[open_].sum())
    # A row too many or too few counts as a twentieth of a mean document.
    nearest = ways[np.argsort(words + 0.05 * max(1.0, size[open_].mean()) * rows, kind="stable")[:choices]]
    chance = np.where(nearest == 1, pi[open_], 1 - pi[open_]).prod(axis=1)
    out = pi.copy()
    out[open_] = nearest[rng.choice(len(nearest), p=chance / chance.sum())]
    return out


def _flown(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["h", "k1", "k2"], kind="stable").reset_index(drop=True)
    size, pi = pdf["size"].to_numpy(dtype=float), pdf["pi"].to_numpy(dtype=float)
    rng = np.random.default_rng(zlib.crc32(repr((None if key[0] is None or key[0] != key[0] else key[0], int(key[1]), int(pdf["level"].iloc[0]))).encode()))
    last = bool(pdf["last"].iloc[0])
    pi = flight(pi, size, rng, LANDING if last else 2)
    if last:
        pi = landing(pi, size, rng)
    return pdf.assign(pi=pi)[["source", "size", "k1", "k2", "h", "whole", "pi"]]


def copies(docs: DataFrame, id_col: str, text_col: str, source_col: str, keys: list[Column], *, weights: tuple[int, ...], budget: float, cap: float, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Distinct documents (doc_id, source, size, n, source_size, target, k1, k2) and their copies (k1, k2, copies).

    ``n`` rows of equal keys are one unit with the copies of all of them, its fractional part drawn once: however often a
    row repeats, no block is larger for it.
    """
    prepare_workers(docs.sparkSession)
    key_names = [f"{OWN}k1", f"{OWN}k2"]
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *keys)
    folded = keyed.withColumnsRenamed(dict(zip(key_names, ["k1", "k2"], strict=True))).groupBy("k1", "k2").agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.first("size").alias("size"), F.count(F.lit(1)).alias("n"))
    rows = staged(folded, "mix-rows")
    by_source = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("units"))
    targets = staged(source_targets(by_source, weights, budget, cap), "mix-targets")
    most = targets.agg(F.max("units")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    mine = targets.select(F.col("source").alias("s"), "source_size", "target", "units")
    joined = rows.join(mine, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rate", F.least(rate, F.lit(float(cap))) * F.col("n"))
    units = joined.select("source", "size", "k1", "k2", F.xxhash64("k1", "k2").alias("h"), F.floor("rate").cast("long").alias("whole"), (F.col("rate") - F.floor("rate")).alias("pi"), "units")
    decided = units.filter(F.col("pi") == 0).select("k1", "k2", F.col("whole").alias("copies"))
    flying, level = units.filter(F.col("pi") > 0), 0
    while True:
        n = F.col("units")
        for _ in range(level):
            n = F.ceil(n / F.lit(block_rows)) * 2
        last = most <= block_rows
        blocks = F.greatest(F.lit(1), F.ceil(n / F.lit(block_rows)))
        blocked = flying.withColumn("block", F.pmod(F.col("h"), blocks).cast("long")).withColumn("last", blocks == 1).withColumn("level", F.lit(level))
        flown = blocked.groupBy("source", "block").applyInPandas(_flown, "source string, size long, k1 long, k2 long, h long, whole long, pi double")
        flown = staged(flown, "mix-flown")
        decided = decided.unionByName(flown.filter("pi = 0 or pi = 1").select("k1", "k2", (F.col("whole") + F.col("pi").cast("long")).alias("copies")))
        if last:
            break
        flying = flown.filter("pi > 0 and pi < 1").join(targets.select(F.col("source").alias("s"), "units"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        most = 2 * math.ceil(most / block_rows)
        level += 1
    return joined.select("doc_id", "source", "size", "n", "source_size", "target", "k1", "k2"), decided


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0, block_rows: int = 2048) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    A null text has no words; a null source is a source of its own, ranked last.  Empty texts are drawn like others and take
    nothing.  Rows that repeat id, text and source are drawn as one, with the copies spread evenly over them.
    Reruns agree, whatever the partitions.  An empty table gives an empty table.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = [F.xxhash64(id_col, text, source_col).alias(f"{OWN}k1"), F.xxhash64(F.lit(7), id_col, text, source_col).alias(f"{OWN}k2")]
    rows, decided = copies(docs, id_col, text_col, source_col, keys, weights=weights, budget=budget, cap=cap, block_rows=block_rows)
    each = repeated(rows.join(decided, ["k1", "k2"]), F.col("n"), "i", spread=True)
    share = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("i") < F.col("copies") % F.col("n"), 1).otherwise(0)
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * share).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0, block_rows: int = 2048) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes it."""
    rows, decided = copies(docs, id_col, text_col, source_col, row_key(docs), weights=weights, budget=budget, cap=cap, block_rows=block_rows)
    return repeat_rows(docs, rows.select("k1", "k2", "n").join(decided.withColumnRenamed("copies", "total"), ["k1", "k2"]))
