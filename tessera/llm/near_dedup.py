"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint is mapped to the bit counts of its segments (for 64 bits: 21 of three bits and one of one).  The Manhattan
distance of two such vectors is at most the Hamming distance of the fingerprints.  Vectors at distance 2 or less have an
integer point within 1 of both, so every fingerprint is filed under its own grid cell and the cells next to it, and a linked
pair always shares a cell.  A cell with two fingerprints gives one pair, verified exactly.  The fingerprints of fuller cells
are filed under the values within one bit of them: two share such a value if and only if they differ in at most 2 bits, and
no value has more than one plus the number of bits.  So no pair is missed, and no group is ever expanded into all its pairs.

``near_duplicates`` links documents whose 64-bit fingerprints differ in at most 2 bits.  ``similar_texts`` finds texts of a
given Jaccard similarity: fingerprints are linked in the same way, min-hash keys of the shingles add the pairs that are alike
but farther in bits, and all are verified on their whole sets of shingles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import only_cache_of, prepare_workers, repeat_rows, row_key, staged
from tessera.llm.components import connected_components

RADIUS = 2
#: Widths of the segments, from the lowest bit on.
SEGMENTS = (3,) * 21 + (1,)
#: For ``similar_texts``: keys of a text, each of the least values of so many permutations of its shingles' codes.  Texts of
#: Jaccard similarity s share a key with a chance of 1 - (1 - s ** BAND_ROWS) ** BANDS, wherever they differ: 0.9993 at 0.8.
BANDS, BAND_ROWS = 24, 6
#: For ``similar_texts``: a bit of each of so many least values, and in how many of them a pair to verify may differ.  Texts
#: of similarity s differ in (1 - s) / 2 of them, 13 at 0.8; more than 32 there with a chance below one in a million.
SKETCH_BITS, SKETCH_RADIUS = 128, 32
#: The same for texts that go into later rounds: 102 at 0.8, more than 150 with a chance below one in a million; and for twice
#: the bits, looked at where these leave a pair: 205 at 0.8, more than 267 with a chance below one in two hundred thousand.
FINE_BITS, FINE_RADIUS = 1024, 150
LONG_BITS, LONG_RADIUS = 2 * FINE_BITS, 267
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TURNS, _SHIFTS = (np.array([xxhash.xxh32_intdigest(name, seed=i) | 1 for i in range(LONG_BITS)], dtype=np.uint32)[:, None] for name in (b"turn", b"shift"))
#: Shingles of the hubs of a round whose sets are broadcast, 8 MB.
HUB_CODES = 1 << 20
#: Most bits of the bitmap that finds the texts to verify.
MARKS = 1 << 26
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def chunks_of_words(data: bytes, step: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size."""
    at = 0
    while at < len(data):
        found = _SPACE.search(data, at + step)
        end = found.start() if found else len(data)
        yield data[at:end].split()
        at = end


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a text, repeats included, in arrays of bounded size."""
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    held: list[bytes] = []
    any_ = False
    for chunk in chunks_of_words((text or "").encode("utf-8", "surrogatepass").lower()):
        held += chunk
        if len(held) >= words:
            any_ = True
            shingles = map(b" ".join, zip(*(islice(held, k, None) for k in range(words)), strict=False))
            yield np.fromiter(map(digest, shingles), dtype=np.uint64, count=len(held) - words + 1)
            held = held[len(held) - words + 1 :]
    if held and not any_:
        yield np.array([digest(b" ".join(held))], dtype=np.uint64)


def simhash(text: str | None, words: int = 3) -> int:
    """Bit i is 1 if it is set in over half the shingles' hashes; 0 for a text without words."""
    votes, n = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text, words):
        n += len(hashes)
        for part in np.array_split(hashes, max(1, len(hashes) // 16384)):
            votes += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0]) if n else 0


def _fingerprinted(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    only_cache_of("near_dedup", lambda: None)
    for batch in batches:
        values = np.fromiter((simhash(x.as_py(), words) for x in batch.column("text")), dtype=np.uint64, count=batch.num_rows)
        rest = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(values.view(np.int64))], names=[*(n for n in batch.schema.names if n != "text"), "fp"])


def fingerprints(rows: DataFrame, words: int = 3) -> DataFrame:
    """``rows`` with ``text`` replaced by ``fp``, its fingerprint as a signed long."""
    prepare_workers(rows.sparkSession)
    types = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes if name != "text")
    return rows.mapInArrow(partial(_fingerprinted, words=words), f"{types}, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def cell_of(fp: Column, segments: tuple[int, ...] = SEGMENTS) -> Column:
    """The popcount vector as a long: the bit count of each segment in a lane of two bits."""
    out, start = F.lit(0).cast("long"), 0
    for i, width in enumerate(segments):
        mask = F.lit(signed(((1 << width) - 1) << start))
        out = out.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseAND(mask)).cast("long"), 2 * i))
        start += width
    return out


def cells_near(cell: Column, segments: tuple[int, ...] = SEGMENTS) -> Column:
    """The cell and every cell at Manhattan distance 1 that some fingerprint could lie in, with nulls between them."""
    out = [cell]
    for i, width in enumerate(segments):
        one, lane = F.lit(1 << 2 * i), F.shiftright(cell, 2 * i).bitwiseAND(F.lit(3))
        out += [F.when(lane < width, cell + one), F.when(lane > 0, cell - one)]
    return F.array(*out)


def values_near(fp: Column) -> Column:
    """The value and those one bit away."""
    return F.array(fp, *[fp.bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)])


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the distinct values ``fp`` within 2 bits of each other.

    They are not every pair, but give the same components: in each bucket all are linked with the least.
    """
    own = distinct.select("fp", cell_of(F.col("fp")).alias("own"))
    cells = own.select("fp", F.explode(cells_near(F.col("own"))).alias("cell")).filter("cell is not null")
    filled = staged(cells.groupBy("cell").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-cells")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    pairs = filled.filter((F.col("n") == 2) & close).select("a", "b").distinct()
    crowded = cells.join(filled.filter("n > 2").select("cell"), "cell", "left_semi").select("fp").distinct()
    met = crowded.select("fp", F.explode(values_near(F.col("fp"))).alias("value")).groupBy("value").agg(F.array_sort(F.collect_set("fp")).alias("fps")).filter("size(fps) > 1")
    stars = met.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 64)).alias("b")).filter(close).distinct()
    return pairs.union(stars)


def classes(fps: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(fp, component_id) for each distinct fingerprint; ``fps`` has the columns ``id_col`` and fp."""
    distinct = staged(fps.groupBy("fp").agg(F.min(id_col).alias("least")), "near-distinct")
    roots = connected_components(links(distinct.select("fp")))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest id reachable).

    A null or blank text has fingerprint zero, linked like any other; a text of fewer words than a shingle is one shingle.
    Repeated rows each get a row.  A component without any id has a null one.  An empty table gives an empty table.  Other
    columns are not read.
    """
    fps = staged(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), words), "near-fps")
    # One fingerprint may belong to a third of all rows: the join is a plain equality that adaptive execution splits.
    return fps.join(classes(fps), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_codes(text: str | None, words: int) -> np.ndarray:
    """A 64-bit code of each distinct shingle of a text, A-Z lower-cased, in order; a shorter text is one shingle.

    A code mixes the hashes of the shingle's words, so each word is hashed once.
    """
    parts = [np.fromiter(map(xxhash.xxh64_intdigest, chunk), dtype=np.uint64, count=len(chunk)) for chunk in chunks_of_words((text or "").encode("utf-8", "surrogatepass").lower())]
    hashes = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    k = min(words, len(hashes))
    if not k:
        return hashes
    return np.unique(_mixed([hashes[i : len(hashes) - k + 1 + i] for i in range(k)], np.uint64(k)))


def _mixed(columns: list[np.ndarray], start: np.ndarray | np.uint64) -> np.ndarray:
    """One 64-bit code from several, in order."""
    with np.errstate(over="ignore"):
        code = np.zeros_like(columns[0]) + start
        for column in columns:
            code = ((code ^ (code >> np.uint64(32))) + column) * _MIX
        code = (code ^ (code >> np.uint64(29))) * _MIX
        return code ^ (code >> np.uint64(32))


def _least(codes: np.ndarray, permutations: int) -> np.ndarray:
    """The least value of each permutation over the codes."""
    short, least = (codes >> np.uint64(32)).astype(np.uint32), np.full(permutations, np.iinfo(np.uint32).max, dtype=np.uint32)
    step = max(1, (1 << 17) // permutations)
    for at in range(0, len(short), step):
        least = np.minimum(least, (short[None, at : at + step] * _TURNS[:permutations] + _SHIFTS[:permutations]).min(axis=1))
    return least


def _one_bit_each(least: np.ndarray) -> np.ndarray:
    """A bit of each least value, as rows of longs."""
    return np.packbits((least * np.uint32(0x9E3779B1)) >> np.uint32(31) == 1, axis=1).view("<i8")


def _keys(least: np.ndarray) -> np.ndarray:
    """The keys of each row of least values, one a band."""
    banded = least[:, : BANDS * BAND_ROWS].astype(np.uint64).reshape(-1, BANDS, BAND_ROWS)
    return _mixed([banded[:, :, i] for i in range(BAND_ROWS)], np.arange(1, BANDS + 1, dtype=np.uint64)[None, :]).view(np.int64)


def _majority(codes: np.ndarray) -> int:
    """The SimHash of codes that vote once each."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(codes), 16384):
        votes += np.unpackbits(codes[at : at + 16384].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(codes), bitorder="little").view("<u8")[0])


def _sketched(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(t, n, fp, s0, s1, keys): how many shingles, their SimHash, a bit of each of 128 least values, and the keys."""
    only_cache_of("near_dedup", lambda: None)
    for batch in batches:
        codes = [shingle_codes(x.as_py(), words) for x in batch.column("text")]
        least = np.array([_least(x, BANDS * BAND_ROWS) for x in codes], dtype=np.uint32).reshape(-1, BANDS * BAND_ROWS)
        bits = _one_bit_each(least[:, :SKETCH_BITS])
        sizes = [len(x) for x in codes]
        prints = np.array([_majority(x) for x in codes], dtype=np.uint64).view(np.int64)
        listed = pa.array([k if n else k[:0] for k, n in zip(_keys(least), sizes, strict=True)], pa.list_(pa.int64()))
        made = [batch.column("t"), pa.array(sizes, pa.int64()), pa.array(prints), pa.array(bits[:, 0]), pa.array(bits[:, 1]), listed]
        yield pa.RecordBatch.from_arrays(made, names=["t", "n", "fp", "s0", "s1", "keys"])


def _fine(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(t, n, s0 and so on, more, keys): how many shingles, a bit of each of 2048 least values, and the keys."""
    for batch in batches:
        codes = [shingle_codes(x.as_py(), words) for x in batch.column("text")]
        least = np.array([_least(x, LONG_BITS) for x in codes], dtype=np.uint32).reshape(-1, LONG_BITS)
        bits, longs = _one_bit_each(least), FINE_BITS // 64
        columns = {"t": batch.column("t"), "n": pa.array([len(x) for x in codes], pa.int64()), **{f"s{i}": pa.array(bits[:, i]) for i in range(longs)}, "more": pa.array(list(bits[:, longs:]), pa.list_(pa.int64())), "keys": pa.array(list(_keys(least)), pa.list_(pa.int64()))}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _shingled(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_codes(x.as_py(), words).view(np.int64) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(sets, pa.list_(pa.int64()))], names=["t", "shingles"])


def marked(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows whose t is in ``asked`` (distinct), without a shuffle of all rows' texts where that can be spared.

    A bitmap with 16 bits or more for each t asked for leaves few others to the join that follows.  It is broadcast: it
    has at most MARKS / 64 rows whatever the input.  Where more is asked for than that bitmap can tell, rows are joined.
    """
    count = asked.count()
    if 16 * count > MARKS:
        return rows.join(asked, "t", "left_semi")
    place = F.pmod(F.xxhash64("t"), F.lit(max(1 << 12, 1 << (16 * count).bit_length())))
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    bitmap = asked.select(place.alias("place")).select(F.shiftright("place", 6).alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    hit = rows.withColumn("place", place).withColumn("slot", F.shiftright("place", 6)).join(F.broadcast(bitmap), "slot")
    return hit.filter(F.col("bits").bitwiseAND(bit) != 0).select(*rows.columns).join(asked, "t", "left_semi")


def similar_texts(rows: DataFrame, *, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(t, root) for the texts of ``rows`` (t, text) that have a near copy; t is a hash of the text.

    Near copies have a Jaccard similarity of ``similarity`` or more on their distinct shingles of ``words`` words, A-Z
    lower-cased; a shorter text is one shingle, a text without words has none and is like no other.  Texts whose 64-bit
    fingerprints of these shingles differ in at most 2 bits are candidates through the same grid as in ``near_duplicates``.
    That radius is far less than the bits that texts at the border differ in, so texts that share a min-hash key are
    candidates too, in rounds, until all that share one are compared or known to be in one class.  Candidates are verified
    on their whole shingle sets, unless their sizes, or far more bits of their sketches than near copies', tell them apart.
    Texts left for later rounds, fewer and more alike, get longer sketches.
    """
    prepare_workers(rows.sparkSession)
    made = rows.mapInArrow(partial(_sketched, words=words), "t long, n long, fp long, s0 long, s1 long, keys array<bigint>")
    sketches = staged(made.dropDuplicates(["t"]).filter("n > 0"), "near-sketches")
    values = staged(sketches.groupBy("fp").agg(F.min("t").alias("least"), F.count(F.lit(1)).alias("texts")), "near-values")
    shared = sketches.select("t", "fp").join(values.filter("texts > 1").select("fp", "least"), "fp").filter("t <> least").select(F.col("least").alias("a"), F.col("t").alias("b"))
    near = links(values.select("fp"))
    for side in "ab":
        near = near.join(values.select(F.col("fp").alias(side), F.col("least").alias(f"{side}{side}")), side)
    near = near.select(F.col("aa").alias("a"), F.col("bb").alias("b"))
    keyed = sketches.select("t", F.explode("keys").alias("key"))
    filled = keyed.groupBy("key").agg(F.min("t").alias("hub"), F.max("t").alias("last")).filter("hub < last").select("key", "hub")
    entries = staged(keyed.join(filled, "key"), "near-entries")
    candidates = shared.union(near).union(entries.filter("t <> hub").select(F.col("hub").alias("a"), F.col("t").alias("b")))
    entries = entries.filter("t <> hub").select("key", "t")  # a hub is compared with all its key
    total, texts = entries.count(), sketches.count()
    linked = candidates.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for side in "ab":
        linked = linked.join(sketches.select("t", "n", "s0", "s1").toDF(side, *[f"{side}{c}" for c in ("n", "s0", "s1")]), side)
    pairs = staged(linked.filter(may_be_alike("a", "b", 2, SKETCH_RADIUS, similarity)).select("a", "b", F.col("a").alias("hub")), "near-pairs")
    light, fine, edges, sets, known = False, None, None, None, None
    while True:
        asked = pairs.select(F.col("a").alias("t")).union(pairs.select("b")).distinct()
        asked = staged(asked if known is None else asked.join(known, "t", "left_anti"), "near-asked")
        if known is None or not asked.isEmpty():
            found = staged(marked(rows, asked).dropDuplicates(["t"]).mapInArrow(partial(_shingled, words=words), "t long, shingles array<bigint>"), "near-sets")
            sets, known = (found, asked) if known is None else (sets.union(found), known.union(asked))
        alike = staged(verified(pairs, sets, similarity, light), "near-alike")
        if edges is None or not alike.isEmpty():
            edges = alike if edges is None else edges.union(alike)
            roots = staged(connected_components(edges), "near-roots")
            edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        left, hubs, light = next_hubs(entries, roots, sketches, total, texts)
        if hubs is None:
            return roots.withColumnRenamed("node", "t")
        entries = left.join(hubs, "t", "left_anti").select("key", "t")
        if fine is None:
            longs = ", ".join(f"s{i} long" for i in range(FINE_BITS // 64))
            fine = marked(rows, left.select("t").distinct()).dropDuplicates(["t"]).mapInArrow(partial(_fine, words=words), f"t long, n long, {longs}, more array<bigint>, keys array<bigint>")
            fine = staged(fine, "near-fine")
        pairs = staged(hub_pairs(left, hubs, fine, similarity), "near-pairs")


def bits_apart(x: str, y: str, longs: int) -> Column:
    """In how many bits two sketches (stem, s and a number) differ."""
    return sum((F.bit_count(F.col(f"{x}s{i}").bitwiseXOR(F.col(f"{y}s{i}"))) for i in range(longs)), F.lit(0))


def may_be_alike(x: str, y: str, longs: int, radius: int, similarity: float) -> Column:
    """Whether two texts' sizes (named by a stem and n) and sketches (stem, s and a number) allow that they are alike."""
    return (F.least(f"{x}n", f"{y}n") >= F.lit(similarity) * F.greatest(f"{x}n", f"{y}n")) & (bits_apart(x, y, longs) <= radius)


def hub_pairs(left: DataFrame, hubs: DataFrame, fine: DataFrame, similarity: float) -> DataFrame:
    """(a, b, hub): the hubs with the texts of other classes in their keys, as far as their long sketches allow.

    Sketches and keys go along with the entries, so that a pair is tested where it meets and never written if it fails.  A
    pair is made once: in the first key that it shares, and by the smaller of two hubs.
    """
    longs = FINE_BITS // 64
    told = lambda stem: fine.toDF(f"{stem}t", *[f"{stem}{c}" for c in fine.columns[1:]])
    flagged = left.join(hubs.withColumn("is_hub", F.lit(True)), "t", "left").select("key", "t", "class", F.coalesce("is_hub", F.lit(False)).alias("is_hub"))
    texts = flagged.join(told("x"), F.col("t") == F.col("xt")).drop("t")
    of_hubs = flagged.filter("is_hub").select(F.col("key").alias("hkey"), F.col("t").alias("hub"), F.col("class").alias("hclass")).join(told("y"), F.col("hub") == F.col("yt")).drop("yt")
    once = (~F.col("is_hub") | (F.col("hub") < F.col("xt"))) & (F.array_intersect("xkeys", "ykeys")[0] == F.col("key"))
    differ = F.aggregate(F.zip_with("xmore", "ymore", lambda a, b: F.bit_count(a.bitwiseXOR(b))), bits_apart("x", "y", longs), lambda n, b: n + b)
    alike = may_be_alike("x", "y", longs, FINE_RADIUS, similarity) & (differ <= LONG_RADIUS)
    met = (F.col("key") == F.col("hkey")) & (F.col("class") != F.col("hclass")) & alike & once
    return texts.join(of_hubs, met).select(F.least("xt", "hub").alias("a"), F.greatest("xt", "hub").alias("b"), "hub")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float, light: bool) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as that.

    If ``light``, the sets of all hubs are broadcast, and that of each other text moves once, however many hubs it meets.
    """
    if light:
        met = pairs.groupBy(F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("t")).agg(F.collect_list("hub").alias("hubs"))
        of_hubs = sets.join(pairs.select(F.col("hub").alias("t")).distinct(), "t", "left_semi").select(F.col("t").alias("a"), F.col("shingles").alias("x"))
        both = met.join(sets, "t").select(F.col("t").alias("b"), F.col("shingles").alias("y"), F.explode("hubs").alias("a")).join(F.broadcast(of_hubs), "a")
    else:
        both = pairs.join(sets.select(F.col("t").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("t").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common >= F.lit(similarity) * (F.size("x") + F.size("y") - common)).select("a", "b")


def next_hubs(entries: DataFrame, roots: DataFrame, sketches: DataFrame, total: int, texts: int) -> tuple[DataFrame, DataFrame | None, bool]:
    """The entries (key, t, class, top) of keys with several classes, the hubs (t) of a round, and whether their sets can be
    broadcast.

    In each key, some texts from outside its largest class become hubs: they are paired with the texts of other classes in
    all their keys and then leave these.  All others stay, those joined with a hub too, as they may link a third text that
    the hub is unlike.  A key is done when one class is left.  So two texts of a key are compared, or known to be in one
    class.  The fewer entries are left, the more hubs a key has: it is as many as let a round test about as many pairs as
    all texts have keys if the hubs together have at most HUB_CODES shingles, else as there were entries at first.
    """
    classed = entries.join(roots.select(F.col("node").alias("t"), "root"), "t", "left").select("key", "t", F.coalesce("root", "t").alias("class"))
    sizes = classed.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "class")).alias("top"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    left = staged(classed.join(largest.select("key", F.col("top.class").alias("top")), "key"), "near-left")
    n = left.count()
    if n == 0:
        return left, None, False

    def hubs_of(most: int) -> DataFrame:
        slot = F.pmod(F.xxhash64("t"), F.lit(max(1, most // n)))
        return staged(left.filter("class <> top").groupBy("key", slot.alias("slot")).agg(F.min("t").alias("t")).select("t").distinct(), "near-hubs")

    hubs = hubs_of(BANDS * texts)
    codes = sketches.join(hubs, "t", "left_semi").agg(F.sum("n")).first()[0] or 0
    return (left, hubs, True) if codes <= HUB_CODES else (left, hubs_of(total), False)


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, one per group of equal or similar texts: the one of the smallest id, null last.

    All columns are kept.  Null texts are a group, equal to the empty text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("t"), text.alias("text"))
    roots = similar_texts(rows, words=words, similarity=similarity)
    keyed = staged(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), *[c.alias(n) for c, n in zip(row_key(docs), ("k1", "k2"), strict=True)]), "near-keys")
    # Equal texts are folded before the join, so that a hot text is one row of it.
    best = keyed.groupBy("t").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "k1", "k2")).alias("best"))
    least = best.join(roots, "t", "left").groupBy(F.coalesce("root", "t").alias("root")).agg(F.min("best").alias("best"))
    plan = least.select("best.k1", "best.k2", F.lit(1).cast("long").alias("total"))
    counts = keyed.join(plan.select("k1", "k2"), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    return repeat_rows(docs, plan.join(counts, ["k1", "k2"]))
