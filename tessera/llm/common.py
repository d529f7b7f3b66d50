"""What the operators of this subpackage share: staged tables, word patterns, small helpers."""

from __future__ import annotations

import atexit
import contextlib
import io
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Prefix of helper columns, kept apart from any column of a caller's table.
OWN = "__tessera_"
#: White space between words, as a character class body for Java and Python patterns.
SPACES = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; in local mode, if unset, one under /tmp."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: a table that outlives any executor, and an end to its lineage.

    The table stays until the driver process ends, since results that are computed later may read it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_STAGED: list[tuple[SparkSession, str]] = []


def _drop_staged() -> None:
    """At the end of the driver process, when no DataFrame can read them any more, staged tables go."""
    for spark, path in _STAGED:
        with contextlib.suppress(Exception):  # the JVM may have gone before
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


atexit.register(_drop_staged)


def prepare_workers(spark: SparkSession, rows: int = 512) -> None:
    """Make this package known to the Python workers, and send them texts in batches of at most ``rows``.

    The package goes to the shared folder as an archive once per context, so that workers need neither an installed copy
    nor a search path.  A batch of whole texts is held several times at once, hence the smaller batches.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))
    context, package = spark.sparkContext, Path(__file__).resolve().parent.parent
    if getattr(context, f"{OWN}sent", False) or not package.is_dir():
        return
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    path = f"{shared_dir(spark)}/{package.name}-{uuid.uuid4().hex}.zip"
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(context._jsc.hadoopConfiguration())
    stream = system.create(place)
    stream.write(bytearray(archive.getvalue()))
    stream.close()
    _STAGED.append((spark, path))
    context.addPyFile(system.makeQualified(place).toString())
    setattr(context, f"{OWN}sent", True)


_CACHES: dict[str, Callable[[], None]] = {}


def only_cache_of(owner: str, clear: Callable[[], None]) -> None:
    """In a worker process, which Spark keeps for other operators' tasks: drop what those have cached."""
    for other, clear_other in _CACHES.items():
        if other != owner:
            clear_other()
    _CACHES.clear()
    _CACHES[owner] = clear


class _Renamed:
    """Gives a function on batches the table's own column names, and Spark plain ones."""

    def __init__(self, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], names: list[str]) -> None:
        self.work, self.names = work, names

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in self.work(pa.RecordBatch.from_arrays(b.columns, names=self.names) for b in batches):
            yield pa.RecordBatch.from_arrays(made.columns, names=[f"c{i}" for i in range(made.num_columns)])


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``df.mapInArrow(work, schema)`` for a table whose columns may have any name; ``work`` yields columns in order."""
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(_Renamed(work, df.columns), plain).toDF(*schema.names)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, where ``value`` is computed once a row however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    """The maximal runs of characters other than white space; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACES}]+"))


def word_count(text: Column) -> Column:
    """How many words ``word_array`` gives, without keeping them."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{SPACES}]+", "w")
    return F.length(F.regexp_replace(marks, f"[{SPACES}]+", "")).cast("long")


def row_key(df: DataFrame) -> list[Column]:
    """Two hashes of a row's whole content; rows with equal keys are taken as equal rows."""
    named = [F.col(f"`{c}`") for c in df.columns]
    plain = [F.to_json(F.struct(c)) if t.startswith(("map", "variant")) else c for c, (_, t) in zip(named, df.dtypes, strict=True)]
    nulls = F.concat_ws("", *[c.isNull().cast("string") for c in named])
    return [F.xxhash64(*plain, nulls).alias(f"{OWN}k1"), F.xxhash64(F.lit(7), *plain, nulls).alias(f"{OWN}k2")]


def repeated(df: DataFrame, count: Column, index: str, *, spread: bool = False, step: int = 1 << 16) -> DataFrame:
    """Each row of ``df`` ``count`` times, numbered from 0 in the new long column ``index``.

    Numbers are made in stretches of ``step``; with ``spread`` the stretches of a row are dealt over all tasks.
    """
    own, first = f"{OWN}count", F.col(index) * step
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(own) - 1) / step)))
    stretches = df.withColumn(own, count.cast("long")).filter(F.col(own) > 0).withColumn(index, starts)
    if spread:
        stretches = stretches.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return stretches.withColumn(index, F.explode(F.sequence(first, F.least(first + step, F.col(own)) - 1))).drop(own)


def repeat_rows(docs: DataFrame, plan: DataFrame, few: int = 1 << 17) -> DataFrame:
    """Rows of ``docs`` by a ``plan`` (k1, k2, total, n): the ``n`` equal rows of a key are ``total`` rows of the result.

    Rows whose key isn't in the plan go.  Equal rows are folded into one and that one is repeated, however many they are.
    Where at most ``few`` keys have equal rows, a list of these is broadcast instead of shuffling all rows twice.
    """
    k1, k2, total, n = (f"{OWN}{x}" for x in ("k1", "k2", "t", "n"))
    named = [F.col(f"`{c}`") for c in docs.columns]
    wanted = staged(plan.filter("total > 0").select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("total").alias(total), F.col("n").alias(n)), "repeat-plan")
    keyed, equal = docs.select("*", *row_key(docs)), wanted.filter(F.col(n) > 1)
    found = equal.count()
    out = repeated(keyed.join(wanted.filter(F.col(n) == 1), [k1, k2]), F.col(total), f"{OWN}i").select(*named)
    if found == 0:
        return out
    folded = keyed.join(F.broadcast(equal) if found <= few else equal, [k1, k2]).dropDuplicates([k1, k2])
    return out.unionByName(repeated(folded, F.col(total), f"{OWN}i", spread=True).select(*named))
