"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point.  A trigram's vector binds three letter vectors:
the first rotated twice, the second once, multiplied element by element.  A document bundles (adds) the vectors of its
trigrams, a language's prototype those of its documents scaled to unit length.  The predicted language is the one whose
prototype has the highest cosine with the document.

Prototypes are fitted on a bounded sample of the labelled rows: about ``train_docs`` per language, chosen by a hash of the
id.  Every document is predicted from its whole text.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, only_cache_of, prepare_workers

DIMENSIONS = 1024
SEED = 20240607
#: Trigram vectors a worker keeps; beyond, it starts anew.  Code points worked on at once.
KEPT, CHUNK, BATCH = 16384, 1 << 20, 64
SPACE = 32


@lru_cache(maxsize=1)
def letter_table() -> tuple[np.ndarray, np.ndarray]:
    """For each code point itself if it is a letter or a mark, else a space; and whether it is a letter."""
    kinds = np.array([unicodedata.category(chr(i))[0] for i in range(sys.maxunicode + 1)])
    points = np.arange(sys.maxunicode + 1)
    return np.where((kinds == "L") | (kinds == "M"), points, SPACE).astype(np.uint64), kinds == "L"


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@lru_cache(maxsize=1 << 14)
def letter_vector(point: int) -> np.ndarray:
    return (np.random.default_rng([SEED, point]).integers(0, 2, DIMENSIONS) * 2 - 1).astype(np.float32)


def trigram_vector(key: int) -> np.ndarray:
    a, b, c = key >> 42, (key >> 21) & 0x1FFFFF, key & 0x1FFFFF
    return np.roll(letter_vector(a), 2) * np.roll(letter_vector(b), 1) * letter_vector(c)


class Vectors:
    """Trigram vectors made so far, in one matrix of bounded size."""

    def __init__(self) -> None:
        self.rows: dict[int, int] = {}
        self.matrix = np.empty((0, DIMENSIONS), dtype=np.float32)

    def clear(self) -> None:
        self.__init__()

    def of(self, keys: np.ndarray) -> np.ndarray:
        new = [k for k in keys.tolist() if k not in self.rows]
        if len(self.rows) + len(new) > KEPT:
            self.rows, new = {}, keys.tolist()
            self.matrix = np.empty((0, DIMENSIONS), dtype=np.float32)
            if len(new) > KEPT:
                return np.stack([trigram_vector(k) for k in new])
        if new:
            at = len(self.rows)
            if at + len(new) > len(self.matrix):
                grown = np.empty((min(KEPT, max(1024, 2 * (at + len(new)))), DIMENSIONS), dtype=np.float32)
                grown[:at] = self.matrix[:at]
                self.matrix = grown
            for i, k in enumerate(new, at):
                self.matrix[i] = trigram_vector(k)
                self.rows[k] = i
        return self.matrix[[self.rows[k] for k in keys.tolist()]]


VECTORS = Vectors()


def trigram_counts(text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct trigram keys and their counts, for each stretch of CHUNK code points of a text that has a letter.

    A run of anything but letters and marks is one space, and a stretch begins and ends with one.
    """
    kept, is_letter = letter_table()
    starts = range(0, len(text or ""), CHUNK)
    if not any(is_letter[points_of(text[at : at + CHUNK])].any() for at in starts):
        return
    for at in starts:
        letters = kept[points_of(text[at : at + CHUNK])]
        gap = letters == SPACE
        if gap.all():
            continue
        words = letters[~(gap & np.concatenate(([False], gap[:-1])))]
        lead = [SPACE] if words[0] != SPACE else []
        tail = [SPACE] if words[-1] != SPACE else []
        padded = np.concatenate((lead, words, tail)).astype(np.uint64)
        keys = (padded[:-2] << np.uint64(42)) | (padded[1:-1] << np.uint64(21)) | padded[2:]
        yield np.unique(keys, return_counts=True)


def bundles(texts: list[str | None]) -> np.ndarray:
    """A vector per text; zero for a text without a letter."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float64)
    for at in range(0, len(texts), BATCH):
        found = [(at + i, keys, counts) for i, t in enumerate(texts[at : at + BATCH]) for keys, counts in trigram_counts(t)]
        if not found:
            continue
        every = np.unique(np.concatenate([keys for _, keys, _ in found]))
        for lo in range(0, len(every), KEPT):
            part = every[lo : lo + KEPT]
            counted = np.zeros((min(BATCH, len(texts) - at), len(part)), dtype=np.float32)
            for i, keys, counts in found:
                where = np.searchsorted(part, keys)
                hit = (where < len(part)) & (part[np.minimum(where, len(part) - 1)] == keys)
                counted[i - at, where[hit]] += counts[hit]
            out[at : at + len(counted)] += counted @ VECTORS.of(part)
    return out


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition and language: the sum of the documents' vectors, scaled to unit length and rounded to whole numbers."""
    only_cache_of("language", VECTORS.clear)
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text")
        for at in range(0, batch.num_rows, BATCH):
            made = bundles([x.as_py() for x in texts.slice(at, BATCH)])
            norms = np.sqrt((made * made).sum(axis=1, keepdims=True))
            unit = np.rint(np.divide(made, norms, out=np.zeros_like(made), where=norms > 0) * 1e6).astype(np.int64)
            for lang, row in zip(langs[at : at + BATCH], unit, strict=True):
                total[lang] = total.get(lang, 0) + row
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], names=["lang", "total"])


def _predictor(names: list[str], prototypes: np.ndarray):
    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache_of("language", VECTORS.clear)
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            leads: list[float] = []
            texts = batch.column("text")
            for at in range(0, batch.num_rows, BATCH):
                made = bundles([x.as_py() for x in texts.slice(at, BATCH)])
                norms = np.sqrt((made * made).sum(axis=1))
                cosines = (made @ prototypes.T) / np.where(norms > 0, norms, 1.0)[:, None] if names else np.zeros((len(made), 1))
                for norm, row in zip(norms, cosines, strict=True):
                    known, k = bool(names) and norm > 0, int(row.argmax())
                    langs.append(names[k] if known else "und")
                    scores.append(float(min(1.0, max(0.0, row[k]))) if known else 0.0)
                    leads.append(float(row[k] - np.delete(row, k).max(initial=0.0)) if known else 0.0)
            rest = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*(c for _, c in rest), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(leads, pa.float64())], names=[*(n for n, _ in rest), "lang_pred", "score", "lead"])

    return predicted


def is_held_out(id_: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_prototypes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 2000) -> tuple[list[str], np.ndarray]:
    """Language names in order and their prototypes of unit length, from about ``train_docs`` documents a language.

    The driver gets one vector per language, added up on the executors.
    """
    prepare_workers(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("id")))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return [], np.zeros((0, DIMENSIONS))
    share = F.create_map(*[x for lang, n in sorted(sizes.items()) for x in (F.lit(lang), F.lit(min(1.0, train_docs / n)))])
    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) < F.try_element_at(share, F.col("lang")) * 1_000_000).select("lang", "text")
    summed = sample.mapInArrow(_summed, "lang string, total array<bigint>")
    at = F.posexplode("total").alias("i", "v")
    merged = summed.select("lang", at).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    vectors = merged.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("v")).select("lang", F.transform("v", lambda x: x["v"]).alias("v")).collect()
    names = sorted(r["lang"] for r in vectors)
    made = np.array([next(r["v"] for r in vectors if r["lang"] == n) for n in names], dtype=np.float64).reshape(len(names), DIMENSIONS)
    norms = np.sqrt((made * made).sum(axis=1, keepdims=True))
    return names, made / np.where(norms > 0, norms, 1.0)


def predict_languages(rows: DataFrame, names: list[str], prototypes: np.ndarray) -> DataFrame:
    """``rows`` with the column text replaced by lang_pred, score and lead, by which the score is above the next one's."""
    types = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "text")
    return rows.mapInArrow(_predictor(names, prototypes), f"{types}{', ' if types else ''}lang_pred string, score double, lead double")


def identify_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 2000) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (the cosine, cut to 0 to 1) and lead over the next language.

    A text that is null or has no letter gets ``und`` and 0, as does every text if no row is labelled.  Of equal cosines the
    first language by name wins.  A null id counts as not held out.  Repeated rows each get a row; an empty table gives an
    empty table.  Other columns are not read.
    """
    names, prototypes = fit_prototypes(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, train_docs=train_docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), is_held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return predict_languages(rows, names, prototypes)


class _Judge:
    """Accepts or rejects texts batch by batch and names the language; the other columns pass through."""

    def __init__(self, names: list[str], prototypes: np.ndarray, text_col: str, lang_col: str, least: float, margin: float) -> None:
        self.names, self.prototypes, self.text_col, self.lang_col, self.least, self.margin = names, prototypes, text_col, lang_col, least, margin

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _predictor(self.names, self.prototypes)
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(self.text_col)], names=["text"])
            told = next(score(iter([texts])))
            kept = [lang != "und" and x >= self.least and lead >= self.margin for lang, x, lead in zip(*(told.column(c).to_pylist() for c in ("lang_pred", "score", "lead")), strict=True)]
            columns = [told.column("lang_pred") if n == self.lang_col else c for n, c in zip(batch.schema.names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(kept, pa.bool_()))


def in_known_language(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 2000, least: float = 0.3, margin: float = 0.1) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is in one learned language; their language is set to it.

    A text goes if it has no letter, if its cosine with the nearest prototype is below ``least`` (it is in no learned
    language or hardly prose), or if the next prototype is nearer than by ``margin`` (it mixes languages).  A missing or
    wrong label is replaced, so that later steps can rely on the column.
    """
    names, prototypes = fit_prototypes(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, train_docs=train_docs)
    return map_batches(docs, _Judge(names, prototypes, text_col, lang_col, least, margin), docs.schema)
