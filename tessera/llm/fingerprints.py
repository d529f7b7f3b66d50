"""Document fingerprints: SimHash with weighted terms, and block tables that find all fingerprints within a radius.

A term is a pair of adjacent words (a lone word is one) and counts once in a text, so that a repeated phrase doesn't drown
the rest.  Its 128-bit hash votes on each bit with its weight, 1 to 4 by length, since short words are common ones.  The votes of a text are summed in 64 longs with two lanes of 32 bits each: wide
enough for any string Spark can hold.  A bit of the fingerprint is 1 if it has over half the votes.

Two fingerprints within 6 bits differ by at most 3 in one of their halves.  A half is cut into six blocks of bits; halves
within 3 bits agree on at least three whole blocks, so one of 20 tables, each keyed by three blocks moved to the front, has
both under one key.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import staged, word_array

#: Bits that two fingerprints may differ in; in one of the halves they then differ in at most HALF_RADIUS.
RADIUS, HALF_RADIUS = 6, 3
HALVES = 2
#: Bits of each block of a half, lowest first.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Ranges of ids that documents are cut into at most; beyond, the ranges grow.  Their borders pass through the driver.
MAX_RANGES = 1 << 16
PAIR = 1 << 32 | 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def block_masks(blocks: tuple[int, ...] = BLOCKS, radius: int = HALF_RADIUS) -> list[int]:
    """For each table the bits of its key, as signed longs."""
    starts = [sum(blocks[:i]) for i in range(len(blocks))]
    masks = [((1 << n) - 1) << s for n, s in zip(blocks, starts, strict=True)]
    return [signed(sum(masks[i] for i in kept)) for kept in combinations(range(len(blocks)), len(blocks) - radius)]


def votes(frame: DataFrame, keys: list[str], words: str, kept: list[str]) -> DataFrame:
    """(keys, kept, fp0, fp1): the fingerprint of the array ``words`` of each row; the keys must be unique.

    ``kept``: longs to carry.
    """
    n = F.size(words)

    def term(i: Column) -> Column:
        """A hash of the pair of words from ``i`` on, with its weight less 1 in the two lowest bits."""
        a, b = F.get(words, i), F.coalesce(F.get(words, i + 1), F.lit(""))
        weight = F.least(F.lit(3), F.floor((F.octet_length(a) + F.octet_length(b)) / 6))
        return F.xxhash64(a, b).bitwiseAND(F.lit(-4)).bitwiseOR(weight)

    distinct = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), term))
    terms = frame.select(*keys, *kept, F.explode_outer(F.when(n > 0, distinct)).alias("term"))
    weight = F.coalesce(F.col("term").bitwiseAND(F.lit(3)) + 1, F.lit(0)).cast("long")
    terms = terms.select(*keys, *kept, F.xxhash64("term").alias("h0"), weight.alias("w")).withColumn("h1", F.xxhash64("h0"))
    lanes = [F.sum(F.shiftrightunsigned(f"h{half}", k).bitwiseAND(F.lit(PAIR)) * F.col("w")).alias(f"v{half}_{k}") for half in range(HALVES) for k in range(32)]
    summed = terms.groupBy(*keys).agg(F.sum("w").alias("w"), *lanes, *[F.max(c).alias(c) for c in kept])
    prints = []
    for half in range(HALVES):
        fp = F.lit(0).cast("long")
        for k in range(32):
            low, high = F.col(f"v{half}_{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"v{half}_{k}", 32)
            fp = fp.bitwiseOR(F.when(2 * low > F.col("w"), F.lit(1 << k)).otherwise(F.lit(0)))
            fp = fp.bitwiseOR(F.when(2 * high > F.col("w"), F.lit(signed(1 << (k + 32)))).otherwise(F.lit(0)))
        prints.append(fp.alias(f"fp{half}"))
    return summed.select(*keys, *kept, *prints)


def id_ranges(ids: DataFrame, bucket_rows: int) -> tuple[list[int], int, int]:
    """Borders between ranges of about ``bucket_rows`` non-null ids, repeated where one id has many rows; rows, null rows.

    Borders are approximate quantiles, so outliers and gaps don't matter.  There are at most MAX_RANGES.
    """
    seen = ids.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known")).first()
    ranges = min(MAX_RANGES, math.ceil(seen["known"] / bucket_rows))
    if ranges < 2:
        return [], seen["n"], seen["n"] - seen["known"]
    shares = [i / ranges for i in range(1, ranges)]
    borders = ids.agg(F.percentile_approx("doc_id", shares, 4 * ranges).alias("q")).first()["q"]
    return sorted(borders), seen["n"], seen["n"] - seen["known"]


def bucket_of(borders: list[int], null_buckets: int) -> Column:
    """The bucket of a row (doc_id, h): buckets follow each other as rows do, by descending id, null last.

    An id's range is found by bisection.  Rows of an id that is a border several times, and those without id, are spread
    over as many buckets by the hash.
    """
    part = lambda n: F.floor((F.shiftright("h", 33) + (1 << 30)) * n / F.lit(1 << 31)).cast("long")
    last = len(borders)
    if not borders:
        known = F.lit(0).cast("long")
    else:
        # A string that the planner folds into one constant array.
        places = F.split(F.lit(",".join(map(str, borders))), ",").cast("array<bigint>")

        def below(or_equal: bool) -> Column:
            """How many borders are less than the id, or equal to it."""

            def step(found: Column, width: Column) -> Column:
                value = F.get(places, found + width - 1)
                passed = (value <= F.col("doc_id")) if or_equal else (value < F.col("doc_id"))
                return F.when((found + width <= last) & passed, found + width).otherwise(found)

            widths = [1 << k for k in reversed(range(last.bit_length()))]
            return F.aggregate(F.array(*map(F.lit, widths)), F.lit(0), step)

        first, end = below(False), below(True)
        known = F.lit(last).cast("long") - end + F.when(end - first > 1, part(end - first)).otherwise(0)
    return F.when(F.col("doc_id").isNotNull(), known).otherwise(F.lit(last + 1) + part(F.lit(max(1, null_buckets)))).cast("long")


def with_next(base: DataFrame, bucket_rows: int = 1024) -> DataFrame:
    """``base`` (doc_id, text) in buckets of neighbouring ids, with the text of the next document.

    Order: descending doc_id, null last, equal ids by a hash of their text; after the last comes the first.  A bucket also
    holds the first row of the bucket after it, marked ``ghost``, so that each bucket can be worked on alone: (bucket, rn,
    ghost, doc_id, text, next_text).
    """
    borders, _, nulls = id_ranges(base.select("doc_id"), bucket_rows)
    keyed = base.withColumn("h", F.xxhash64("text")).withColumn("bucket", bucket_of(borders, min(MAX_RANGES, math.ceil(nulls / bucket_rows))))
    # First of a bucket: the highest id, then the least hash, whose complement is the highest.
    heads = keyed.groupBy("bucket").agg(F.max(F.struct("doc_id", F.bitwise_not("h").alias("c"))).alias("head")).select("bucket", "head.doc_id", "head.c")
    # At most one row per bucket: some two times MAX_RANGES, whatever the input.
    found = sorted(heads.collect(), key=lambda r: r["bucket"])
    linked = [(r["bucket"], r["doc_id"], ~r["c"], found[i - 1]["bucket"]) for i, r in enumerate(found)]
    heads = base.sparkSession.createDataFrame(linked, "of long, id1 long, h1 long, before long")
    is_head = (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id1")) & (F.col("h") == F.col("h1"))
    marked = keyed.join(F.broadcast(heads), is_head, "left")
    places = F.array_compact(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("ghost")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("b"), F.lit(1).alias("ghost")))))
    dealt = marked.select("doc_id", "text", "h", F.explode(places).alias("p")).select(F.col("p.b").alias("bucket"), F.col("p.ghost").alias("ghost"), "doc_id", "text", "h")
    window = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "h")
    return dealt.select("bucket", F.row_number().over(window).cast("long").alias("rn"), F.col("ghost").cast("long").alias("ghost"), "doc_id", "text", F.coalesce(F.lead("text").over(window), F.lit("")).alias("next_text"))


def as_long(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, -10).cast("long")


def as_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def distance(a: str, b: str) -> Column:
    """In how many bits two fingerprints, named by the stems of their halves' columns, differ."""
    return sum((F.bit_count(F.col(f"{a}{half}").bitwiseXOR(F.col(f"{b}{half}"))) for half in range(HALVES)), F.lit(0))


def likeness(a: str, b: str) -> Column:
    """The share of equal bits."""
    return F.lit(1.0) - distance(a, b) / F.lit(64.0 * HALVES)


def near_counts(prints: DataFrame, queries: DataFrame) -> DataFrame:
    """(q0, q1, near): for each distinct fingerprint of ``queries`` how many rows of ``prints`` are within the radius.

    Both sides have the columns fp0 and fp1 and are folded to distinct fingerprints first, so a group of copies is one
    row.  A pair found by several tables counts in the first.
    """
    masks = [(half, m) for half in range(HALVES) for m in block_masks()]

    def tables(df: DataFrame, stem: str, key: str) -> DataFrame:
        filed = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"{stem}{half}").bitwiseAND(F.lit(m)).alias("k")) for t, (half, m) in enumerate(masks)]))
        return df.withColumn("filed", filed).select(*df.columns, F.col("filed.t").alias(f"{key}t"), F.col("filed.k").alias(f"{key}k"))

    every = prints.groupBy("fp0", "fp1").agg(F.count(F.lit(1)).alias("n"))
    asked = queries.select(F.col("fp0").alias("q0"), F.col("fp1").alias("q1")).distinct()
    first = F.coalesce(*[F.when(F.col(f"q{half}").bitwiseXOR(F.col(f"fp{half}")).bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, (half, m) in enumerate(masks)])
    close = (F.col("at") == F.col("bt")) & (F.col("ak") == F.col("bk")) & (distance("q", "fp") <= RADIUS) & (first == F.col("at"))
    # Merged, not broadcast: the keys of the queries grow with the corpus.
    found = tables(asked, "q", "a").hint("merge").join(tables(every, "fp", "b"), close)
    return found.groupBy("q0", "q1").agg(F.sum("n").alias("near"))


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", query_every: int = 20, bucket_rows: int = 1024) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_count.

    The edited text has its last third (rounded down) replaced by the beginning of the next document's text, as long or
    all of it.  Next goes by descending id, null last, equal ids by a hash of their text, and from the last to the first.
    near_count: for documents whose id is divisible by ``query_every``, how many documents (itself included) have a
    fingerprint within 6 of its 128 bits; null for others.  A null text counts as empty; a text without words has fingerprint zero.
    Repeated rows each get a row; an empty table gives an empty table.  Other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pairs = with_next(base, bucket_rows)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    both = pairs.select("bucket", "rn", "ghost", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    sha = F.sha2("edited", 256)
    parts = [as_long(F.substring(sha, 1 + 16 * i, 16)).alias(f"s{i}") for i in range(4)]
    kept = ["ghost", "doc_id", "n_chars", "s0", "s1", "s2", "s3"]
    variants = F.explode(F.array(F.struct(F.lit(0).alias("v"), word_array(F.col("text")).alias("words")), F.struct(F.lit(1).alias("v"), word_array(F.col("edited")).alias("words")))).alias("x")
    split = both.select("bucket", "rn", "ghost", "doc_id", "n_chars", *parts, variants).select("bucket", "rn", *kept, F.col("x.v").alias("v"), F.col("x.words").alias("words"))
    voted = votes(split, ["bucket", "rn", "v"], "words", kept)
    own = [F.max(F.when(F.col("v") == v, F.col(f"fp{half}"))).alias(f"{stem}{half}") for v, stem in ((0, "fp"), (1, "edited")) for half in range(HALVES)]
    per_row = voted.groupBy("bucket", "rn").agg(*[F.max(c).alias(c) for c in kept], *own)
    order = Window.partitionBy("bucket").orderBy("rn")
    after = per_row.withColumns({f"next{half}": F.lead(f"fp{half}").over(order) for half in range(HALVES)})
    rows = staged(after.filter("ghost = 0").drop("ghost"), "print-rows")
    is_query = F.coalesce(F.pmod("doc_id", F.lit(query_every)) == 0, F.lit(False))
    near = near_counts(rows, rows.filter(is_query))
    # Rows that aren't queries look for nothing; a hot fingerprint's rows are split by adaptive execution.
    asked = rows.filter(is_query).join(near, (F.col("fp0") == F.col("q0")) & (F.col("fp1") == F.col("q1"))).drop("q0", "q1")
    told = asked.unionByName(rows.filter(~is_query).withColumn("near", F.lit(None).cast("long")))
    whole = lambda stem, n: F.concat(*[as_hex(F.col(f"{stem}{i}")) for i in range(n)])
    return told.select(
        "doc_id",
        "n_chars",
        whole("s", 4).alias("edited_sha256"),
        whole("fp", HALVES).alias("fingerprint"),
        whole("edited", HALVES).alias("edited_fingerprint"),
        likeness("fp", "edited").alias("near_edited"),
        likeness("fp", "next").alias("near_next"),
        F.col("near").alias("near_count"),
    )
