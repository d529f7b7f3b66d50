"""Shards with near equal bytes, tokens and rows, by vector bin packing.

Groups of equal texts are items with three sizes.  Blocks of a bounded number of small items are packed on their own, each
into several bins a shard; the bins of several blocks are then items themselves, packed again, until few blocks are left.
Their bins are packed into the shards together with the large items, of which there can't be many.  An item goes to the bin
where the dot product of its sizes with the bin's residual capacity is highest.  No task holds more than ``block_items`` items
(or ``fan_in`` times FINE times ``shards`` bins, and 3 * LARGE * ``shards`` large items), whatever the input.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import prepare_workers, repeated, staged, word_count

DIMS = ("bytes", "tokens", "rows")
#: What each size counts for in the dot product.  The law is in bytes, so they come first.
WEIGHTS = (10.0, 1.0, 1.0)
#: Bins of a block for each shard; an item over this part of a shard's mean in some size is large.
FINE, LARGE = 8, 64


def pack(sizes: np.ndarray, bins: int, order: np.ndarray) -> np.ndarray:
    """The bin of each item; ``order``: the items from the largest on."""
    total = sizes.sum(axis=0)
    scale = np.sqrt(WEIGHTS)
    scaled = sizes / np.where(total > 0, total, 1.0) * scale
    residual = np.full((bins, sizes.shape[1]), 1.0 / bins) * scale
    out = np.zeros(len(sizes), dtype=np.int32)
    for i in order:
        item = scaled[i]
        k = int(np.argmax(residual @ item))
        residual[k] -= item
        out[i] = k
    return out


def _packer(bins: int, group: str, keys: list[str]):
    """For applyInPandas: packs the items of one ``group``, named by ``keys``, whatever order they come in."""

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(keys, kind="stable").reset_index(drop=True)
        sizes = pdf[list(DIMS)].to_numpy(dtype=float)
        total = sizes.sum(axis=0)
        weight = (sizes / np.where(total > 0, total, 1.0)) @ np.array(WEIGHTS)
        return pdf[[group, *keys]].assign(to=pack(sizes, bins, np.argsort(-weight, kind="stable")))

    return packed


def packed_items(items: DataFrame, total: dict[str, int], shards: int, block_items: int, fan_in: int) -> DataFrame:
    """(k1, k2, part, shard) for ``items`` (k1, k2, part, bytes, tokens, rows), staged and with unique keys."""
    keys = ["k1", "k2", "part"]
    sums = [F.sum(d).alias(d) for d in DIMS]
    types = "top long, k1 long, k2 long, part long, to int"
    large = F.greatest(*[F.col(d) / F.lit(max(1.0, (total[d] or 0) / (LARGE * shards))) for d in DIMS]) > 1
    n_small = items.filter(~large).count()
    if n_small <= block_items:
        return items.withColumn("top", F.lit(0).cast("long")).groupBy("top").applyInPandas(_packer(shards, "top", keys), types).select(*keys, F.col("to").alias("shard"))
    blocks, bins = math.ceil(n_small / block_items), FINE * shards
    small = items.filter(~large).withColumn("top", F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("long"))
    packed = small.groupBy("top").applyInPandas(_packer(bins, "top", keys), types)
    placed = staged(packed.join(small, ["top", *keys]).select("top", "to", *keys, *DIMS), "shard-packed")
    # Each level is keyed like items: a bin is (its block, itself, -1).
    bin_keys = [F.col("top").alias("k1"), F.col("to").cast("long").alias("k2"), F.lit(-1).cast("long").alias("part")]
    level = staged(placed.groupBy("top", "to").agg(*sums).select(*bin_keys, *DIMS), "shard-sizes")
    where = level.select(F.col("k1").alias("block"), F.col("k2").alias("bin"), "k1", "k2")
    while blocks > fan_in:
        up = level.withColumn("top", F.floor(F.col("k1") / fan_in).cast("long"))
        moved = staged(up.groupBy("top").applyInPandas(_packer(bins, "top", keys), types), "shard-level")
        where = staged(where.join(moved.drop("part"), ["k1", "k2"]).select("block", "bin", F.col("top").alias("k1"), F.col("to").cast("long").alias("k2")), "shard-map")
        level = staged(up.join(moved, ["top", *keys]).groupBy("top", "to").agg(*sums).select(*bin_keys, *DIMS), "shard-sizes")
        blocks = math.ceil(blocks / fan_in)
    last = level.unionByName(items.filter(large)).withColumn("top", F.lit(0).cast("long"))
    final = staged(last.groupBy("top").applyInPandas(_packer(shards, "top", keys), types).select(*keys, F.col("to").alias("shard")), "shard-final")
    homes = where.join(final.filter("part = -1").drop("part"), ["k1", "k2"]).select(F.col("block").alias("top"), F.col("bin").alias("to"), "shard")
    return placed.join(homes, ["top", "to"]).select(*keys, "shard").unionByName(final.filter("part <> -1"))


def assign_shards(docs: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", block_items: int = 2048, fan_in: int = 16, slot_rows: int = 4096) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: the shards' sizes (UTF-8 bytes plus 16 a row) are near equal.  Equal texts share a shard.  Only where
    that cannot be, as all rows of a text are more than a shard's mean in bytes, they are dealt by a hash of the document id
    into pieces of at most an eighth of the mean; there can't be more than ``shards`` such texts.  Slots count from 0 in each
    shard without a gap.  A null text counts as empty.  Null ids, repeated ids and repeated rows each get a slot of their own.  An
    empty table gives an empty table.  Other columns are not read.
    """
    prepare_workers(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    told = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        word_count(text).alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit(1), text).alias("k2"),
    )
    # Rows of equal id and text are one row that counts n from here on.
    rows = staged(told.groupBy("doc_id", "size", "tokens", "text_crc32", "k1", "k2").agg(F.count(F.lit(1)).alias("n")), "shard-rows")
    sums = [F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum(F.col("tokens") * F.col("n")).alias("tokens"), F.sum("n").alias("rows")]
    total = rows.agg(*sums).first().asDict()
    share = max(1.0, (total["bytes"] or 0) / shards)
    hot = rows.groupBy("k1", "k2").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows")).filter((F.col("bytes") > share) & (F.col("rows") > 1))
    hot = hot.select("k1", "k2", F.ceil(F.col("bytes") * FINE / share).cast("long").alias("parts"))
    start = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("parts"))
    zero = F.lit(0).cast("long")
    part = F.explode(F.when(F.col("parts").isNull(), F.array(zero)).when(F.col("n") == 1, F.array(start)).otherwise(F.sequence(zero, F.col("parts") - 1)))
    dealt = F.floor(F.col("n") / F.col("parts")) + F.when(F.pmod(F.col("part") - start, F.col("parts")) < F.col("n") % F.col("parts"), 1).otherwise(0)
    # At most one row per shard.
    split = rows.join(F.broadcast(hot), ["k1", "k2"], "left").withColumn("part", part).withColumn("n", F.when(F.col("parts").isNull(), F.col("n")).otherwise(dealt).cast("long")).filter("n > 0").drop("parts")
    items = staged(split.groupBy("k1", "k2", "part").agg(*sums), "shard-items")
    home = packed_items(items, total, shards, block_items, fan_in)
    subs = max(1, math.ceil((total["rows"] or 0) / (shards * slot_rows)))
    out = staged(split.join(home, ["k1", "k2", "part"]).select("doc_id", "size", "text_crc32", "k1", "k2", "n", "shard"), "shard-out")
    out = out.withColumn("sub", F.pmod(F.xxhash64("doc_id", "k1", F.lit(5)), F.lit(subs)).cast("int"))
    counts = out.groupBy("shard", "sub").agg(F.sum("n").alias("m"))
    before = F.sum("m").over(Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shard", "sub", F.coalesce(before, F.lit(0)).alias("before"))
    up_to = F.sum("n").over(Window.partitionBy("shard", "sub").orderBy("doc_id", "k1", "k2").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = out.withColumn("up_to", up_to).join(counts, ["shard", "sub"])
    return repeated(placed, F.col("n"), "i", spread=True).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("before") + F.col("up_to") - F.col("n") + F.col("i")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
