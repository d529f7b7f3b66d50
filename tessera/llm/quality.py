"""Quality rules with adaptive thresholds.

Each document has four integer metrics.  A sketch per language, source and metric counts documents by metric value, rounded
down to ten significant bits: sketches of parts merge by addition, a quantile is exact to a thousandth of its value, and the
number of counters grows with the logarithm of the values only.  The limit of a group is its median plus ``SPREADS`` times the
way from there to its upper quantile, so it follows the group's own upper tail.  Limits of small groups are drawn towards
those of their language, and these towards the corpus's: a group of n documents counts n, its parent ``PRIOR_DOCS``.  The
joined filter rejects documents beyond a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import OWN, SPACES, let, staged, word_array

#: Metrics, the first three in thousandths of a text, the last in hundredths of a character; a document is off if one is beyond
#: its limit.  A line's first repeat isn't counted: it may be a heading or a refrain.
METRICS = ("symbols", "dup_lines", "capitals", "word_length")
#: The upper quantile in per cent, the distance of the limit in ways from the median to it, and the least distance that means
#: anything, 2 % of a text or a fifth of a character.
UPPER, SPREADS, GRAIN = 90, 4, 20
#: What the parent's limit counts, in documents.
PRIOR_DOCS = 100
WINDOW = 8


def n_repeat_words(words: Column) -> Column:
    """How many words lie in windows of 8 words that occur twice or more in the text, the first ones included.

    Windows are compared by 64-bit hashes.  Time is n log n in the number of words, without a shuffle.
    """

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1), p + WINDOW) - p))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def repeated(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def starts(s: Column) -> Column:
            def twice(x: Column, i: Column) -> Column:
                return (F.get(s, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, i + 1)["h"].eqNullSafe(x["h"]))

            return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["p"]))

        return let(let(placed, starts), covered)

    def windows(h: Column) -> Column:
        last = F.size(h) - WINDOW
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def counted(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(repeated(w))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashed, lambda h: let(windows(h), counted)))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.rlike(s, F.lit(f"[^{SPACES}]")))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def rounded_down(value: Column) -> Column:
    """A whole number with all but its ten highest bits cleared."""
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - 10)
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct of the counts and the metrics in a reserved column.

    The struct comes out of a generator, so that the planner neither computes it twice nor moves a filter on it below.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    share = lambda part, whole, unit=1000: F.floor(F.lit(unit) * part / F.greatest(whole, F.lit(1))).cast("long")
    counts = F.struct(
        let(word_array(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), n_repeat_words(w).alias("r"))).alias("words"),
        F.length(F.regexp_replace(text, f"[{SPACES}]+", "")).cast("long").alias("chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("symbols"),
        n_dup_lines(text).alias("lines"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("caps"),
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
    )

    def complete(c: Column) -> Column:
        words, chars = c["words"]["n"], c["chars"]
        metrics = F.array(
            share(c["symbols"], chars),
            share(F.greatest(F.lit(0).cast("long"), c["lines"] - 1), c["n_lines"]),
            share(c["caps"], chars),
            share(chars, words, 100),
        )
        return F.struct(words.alias("n_words"), c["words"]["r"].alias("n_repeat_words"), chars.alias("chars"), c["symbols"].alias("symbols"), c["lines"].alias("lines"), F.transform(metrics, rounded_down).alias("metrics"))

    return docs.withColumn(OWN, F.explode(F.transform(F.array(counts), complete)))


def sketches(measured: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, metric, value, n): the counters of the sketches.

    Partial counts merge before the shuffle, so a hot source sends each counter once a task.
    """
    metric = F.posexplode(f"{OWN}.metrics").alias("metric", "value")
    return measured.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), metric).groupBy("lang", "source", "metric", "value").agg(F.count(F.lit(1)).alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, limits): for each pair an array with the highest allowed value of each metric."""
    levels = []
    for depth, keys in enumerate((["lang", "source"], ["lang"], [])):
        merged = sketch.groupBy(*keys, "metric", "value").agg(F.sum("n").alias("n"))
        group = Window.partitionBy(*keys, "metric")
        run = F.sum("n").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ranked = merged.withColumn("run", run).withColumn("docs", F.sum("n").over(group))
        quantile = lambda q: F.min(F.when(F.col("run") * 100 >= F.col("docs") * q, F.col("value")))
        high = ranked.groupBy(*keys, "metric").agg(F.max("docs").alias(f"docs{depth}"), quantile(50).alias("mid"), quantile(UPPER).alias("high"))
        levels.append(high.withColumn(f"limit{depth}", F.col("mid") + F.greatest(F.lit(GRAIN), F.lit(SPREADS) * (F.col("high") - F.col("mid")))).drop("mid", "high"))
    own, of_lang, of_all = levels
    joined = own.withColumnsRenamed({"lang": "l", "metric": "m"})
    joined = joined.join(of_lang, F.col("l").eqNullSafe(F.col("lang")) & (F.col("m") == F.col("metric"))).drop("lang", "metric")
    joined = joined.join(of_all, F.col("m") == F.col("metric")).drop("metric")
    drawn = lambda depth, parent: F.floor((F.col(f"docs{depth}") * F.col(f"limit{depth}") + PRIOR_DOCS * parent) / (F.col(f"docs{depth}") + PRIOR_DOCS))
    each = joined.select("l", "source", "m", drawn(0, drawn(1, F.col("limit2"))).cast("long").alias("limit"))
    return each.groupBy(F.col("l").alias("lang"), "source").agg(F.array_sort(F.collect_list(F.struct("m", "limit"))).alias("limits")).select("lang", "source", F.transform("limits", lambda x: x["limit"]).alias("limits"))


def judged(measured: DataFrame, limits: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``measured`` with the columns base_failed and kept, under reserved names."""
    lim = limits.select(F.col("lang").alias(f"{OWN}l"), F.col("source").alias(f"{OWN}s"), F.col("limits").alias(f"{OWN}limits"))
    on = F.col(lang_col).eqNullSafe(F.col(f"{OWN}l")) & F.col(source_col).eqNullSafe(F.col(f"{OWN}s"))
    words, repeated = F.col(f"{OWN}.n_words"), F.col(f"{OWN}.n_repeat_words")
    base_failed = (words < 20) | (100 * repeated > 30 * words)
    within = F.lit(True)
    for i in range(len(METRICS)):
        within = within & (F.get(f"{OWN}.metrics", F.lit(i)) <= F.get(f"{OWN}limits", F.lit(i)))
    return measured.join(lim, on).withColumn(f"{OWN}failed", base_failed).withColumn(f"{OWN}kept", ~F.col(f"{OWN}failed") & within)


def judge_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null text has no words and fails the base rule.  Null languages and sources are groups of their own.  Repeated rows
    each count and each get a row.  An empty table gives an empty table.  Other columns are not read.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    measured = staged(with_measures(base).drop("text"), "quality-measures")
    limits = staged(thresholds(sketches(measured)), "quality-limits")
    out = judged(measured, limits)
    return out.select(
        "doc_id",
        F.col(f"{OWN}.n_words").alias("n_words"),
        F.col(f"{OWN}.chars").alias("word_chars"),
        F.col(f"{OWN}.symbols").alias("n_symbols"),
        F.col(f"{OWN}.lines").alias("n_dup_lines"),
        F.col(f"{OWN}.n_repeat_words").alias("n_repeat_words"),
        F.col(f"{OWN}failed").alias("base_failed"),
        F.col(f"{OWN}kept").alias("kept"),
    )


def passing_documents(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``judge_quality`` keeps, with all their columns.

    The measures are made once and staged beside the documents; the sketches read only them.
    """
    measured = staged(with_measures(docs, text_col), "quality-measured")
    limits = staged(thresholds(sketches(measured, lang_col, source_col)), "quality-limits")
    return judged(measured, limits, lang_col, source_col).filter(f"{OWN}kept").select(*[F.col(f"`{c}`") for c in docs.columns])
