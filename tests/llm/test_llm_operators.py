"""Each operator against plain Python on small tables: nulls, blanks, long texts, ties, repeats, empty tables, clashing columns."""

import base64
import collections
import hashlib
import os
import random
import re
import textwrap
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, components, fingerprints, language, licences, mixing, near_dedup, quality, sharding, urls
from tessera.llm.common import repeat_rows, row_key, shared_dir, word_array, word_count

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BASE = [
    (1, "The quick brown fox jumps over the lazy dog. " * 4, "en", "a", 0),
    (2, "The quick brown fox jumps over the lazy dog. " * 4, "en", "a", 0),
    (3, None, "en", "a", 0),
    (4, "", None, None, 0),
    (5, " \t\n\x0b\x0c\r ", "de", "b", 0),
    (6, "One", "en", "b", 0),
    (7, "Zwei Wörter", "de", None, 0),
    (8, "a b c d e f g h i j " * 3000, "en", "c", 0),
    (9, "日本語 テキスト 🎉 \u00a0x", None, "c", 0),
    (9, "日本語 テキスト 🎉 \u00a0x", None, "c", 0),
    (None, "no id here at all", "en", "a", 0),
    (None, "no id here at all", "en", "a", 0),
    (20, "Released under the MIT License.\nline\nline\n  \nline", "en", "b", 0),
    (-5, "negative id with some words", "fr", "b", 0),
]


def documents(spark, rows=BASE):
    """The columns of documents, and some with names that operators use themselves."""
    docs = spark.createDataFrame(rows, DOCS)
    return docs.withColumn("size", F.lit("x")).withColumn("fp", F.lit(1)).withColumn("n", F.lit(None).cast("int")).withColumn("shard", F.lit(2)).withColumn("t", F.lit(0.5)).withColumn("k1", F.lit("k"))


def empty(spark):
    return documents(spark).filter("false")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_words(spark):
    df = documents(spark).select("text", word_array(F.col("text")).alias("w"), word_count(F.col("text")).alias("n"))
    for r in df.collect():
        words = WORD.findall(r["text"] or "")
        assert r["w"] == words and r["n"] == len(words)


def test_repeat_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, None), (3, "c")], "doc_id long, text string")
    keyed = docs.select("doc_id", *row_key(docs)).toDF("doc_id", "k1", "k2")
    plan = keyed.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc_id").alias("d")).select("k1", "k2", "n", F.when(F.col("d") == 1, 4).when(F.col("d") == 2, 2).otherwise(0).cast("long").alias("total"))
    got = collections.Counter(r["doc_id"] for r in repeat_rows(docs, plan).collect())
    assert got == {1: 4, 2: 2}


def test_shared_dir(spark):
    assert shared_dir(spark).endswith("/tmp/checkpoints")


# 1


def brute_fingerprint(text):
    words = WORD.findall(text)
    terms = [(a, b) for a, b in zip(words, words[1:], strict=False)] or [(w, "") for w in words]
    votes, total = [0] * 128, 0
    for a, b in set(terms):
        # Spark's xxhash64 of two strings: the hash of the second seeded with that of the first; an empty one also hashes.
        h = xxhash.xxh64_intdigest(b.encode(), seed=xxhash.xxh64_intdigest(a.encode(), seed=42))
        weight = min(4, 1 + (len(a.encode()) + len(b.encode())) // 6)
        h = h & ~3 | weight - 1
        h = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed=42)
        h |= xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed=42) << 64
        total += weight
        for i in range(128):
            votes[i] += weight * (h >> i & 1)
    return sum(1 << i for i in range(128) if 2 * votes[i] > total)


def hexadecimal(fp):
    return f"{fp & (1 << 64) - 1:016x}{fp >> 64:016x}"


@pytest.mark.parametrize("bucket_rows", [1, 3, 1024])
def test_fingerprints(spark, bucket_rows):
    got = rows_of(fingerprints.fingerprint_documents(documents(spark), bucket_rows=bucket_rows))
    order = sorted([(r[0], r[1] or "") for r in BASE], key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(BASE)
    for r in got:
        at = [i for i, (d, _) in enumerate(order) if d == r["doc_id"]]
        options = set()
        for i in at:
            text, after = order[i][1], order[(i + 1) % len(order)][1]
            third = len(text) // 3
            edited = text[: len(text) - third] + after[:third]
            f, e, n = map(brute_fingerprint, (text, edited, after))
            options.add((len(text), hashlib.sha256(edited.encode()).hexdigest(), hexadecimal(f), hexadecimal(e), 1 - (f ^ e).bit_count() / 128, 1 - (f ^ n).bit_count() / 128))
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) in options
    assert rows_of(fingerprints.fingerprint_documents(empty(spark))) == []


LOW, HIGH = -(1 << 63), (1 << 63) - 1
IDS = {
    "wide": [LOW, LOW + 1, -9 * 10**18, -1, 0, 1, 9 * 10**18, HIGH],
    "outlier": [*range(40), 1 << 60],
    "null": [None] * 30,
    "equal": [7] * 30,
    "hot": [5] * 30 + list(range(12)) + [None] * 5,
    "hashes": [random.Random(i).getrandbits(64) - (1 << 63) for i in range(40)],
    "one": [3],
}


@pytest.mark.parametrize("name", IDS)
@pytest.mark.parametrize("bucket_rows", [2, 1024])
def test_next_document_whatever_the_ids(spark, name, bucket_rows):
    rows = [(d, f"text {i} of words {i * i}") for i, d in enumerate(IDS[name])]
    base = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(fingerprints.with_next(base, bucket_rows).filter("ghost = 0"))
    hashes = {r["text"]: r["h"] for r in base.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    assert {(r["doc_id"], r["text"]): r["next_text"] for r in got} == {order[i]: order[(i + 1) % len(order)][1] for i in range(len(order))}
    assert len(got) == len(rows)
    if bucket_rows == 2 and len(rows) > 8:  # no range is much fuller than meant
        assert max(collections.Counter(r["bucket"] for r in got).values()) <= 12
    full = fingerprints.fingerprint_documents(base, bucket_rows=bucket_rows)
    assert full.count() == len(rows)


def test_fingerprints_have_no_window_over_all_rows(spark):
    plan = fingerprints.with_next(documents(spark).select("doc_id", F.coalesce("text", F.lit("")).alias("text")), 2)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(128) for _ in range(40)]
    values = base + [b ^ sum(1 << i for i in rng.sample(range(128), k)) for b in base for k in (0, 1, 3, 4, 5, 6, 7, 9)]
    halves = lambda v: (fingerprints.signed(v & (1 << 64) - 1), fingerprints.signed(v >> 64))
    df = spark.createDataFrame([halves(v) for v in values], "fp0 long, fp1 long")
    got = {(r["q0"], r["q1"]): r["near"] for r in fingerprints.near_counts(df, df).collect()}
    assert got == {halves(v): sum((v ^ w).bit_count() <= 6 for w in values) for v in values}
    assert len(fingerprints.block_masks()) == 20


# 2


def test_languages(spark):
    rng = random.Random(1)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "ver"], "cc": ["ção", "ñe", "qui", "rra"]}
    made = [(i, " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(rng.randint(5, 60))), lang, "s", 0) for i, lang in enumerate(rng.choices(sorted(syllables), k=300))]
    odd = [(1000, None, "aa", "s", 0), (1001, " 12 ?! ", "aa", "s", 0), (1002, "", None, "s", 0), (None, "kalo", "aa", "s", 0), (1003, "kalomi " * 200_000, None, "s", 0)]
    got = rows_of(language.identify_languages(documents(spark, made + odd)))
    assert len(got) == len(made) + len(odd)
    by_id = {r["doc_id"]: r for r in got}
    held = [m for m in made if zlib.crc32(str(m[0]).encode()) % 4 == 2]
    assert {r["doc_id"] for r in got if r["held_out"]} >= {m[0] for m in held}
    assert sum(by_id[m[0]]["lang_pred"] == m[2] for m in held) >= 0.98 * len(held)
    for i in (1000, 1001, 1002):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
    assert by_id[1003]["lang_pred"] == "aa" and not by_id[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in got)
    # Without a label there is nothing to learn.
    blank = rows_of(language.identify_languages(documents(spark, [(1, "kalo", None, "s", 0)])))
    assert blank[0]["lang_pred"] == "und"
    assert rows_of(language.identify_languages(empty(spark))) == []
    # Marks are no letters, and beside letters they are.
    marks = {r["doc_id"]: r["lang_pred"] for r in rows_of(language.identify_languages(documents(spark, made + [(2000, "\u0301\u0300 \u0301", "aa", "s", 0), (2001, "kalo\u0301", "aa", "s", 0)])))}
    assert marks[2000] == "und" and marks[2001] == "aa"


def brute_cosines(text, prototypes):
    """Cosines of a text's bundle with the prototypes, gram by gram."""
    letters = lambda c: c if unicodedata.category(c)[0] in "LM" else " "
    spaced = " " + re.sub(" +", " ", "".join(map(letters, (text or "").lower()))).strip() + " "
    total = np.zeros(language.DIMENSIONS)
    for a, b, c in zip(spaced, spaced[1:], spaced[2:], strict=False):
        total += np.roll(language.letter_vector(ord(a)), 2) * np.roll(language.letter_vector(ord(b)), 1) * language.letter_vector(ord(c))
    return [float(total @ p) / float(np.linalg.norm(total)) for p in prototypes]


def test_predictions_are_the_nearest_prototypes(spark):
    rng = random.Random(21)
    made = [(i, " ".join("".join(rng.choices("abcdefg" if i % 2 else "nopqrst", k=rng.randint(1, 7))) + rng.choice(["", ",", ".\n", "é"]) for _ in range(rng.randint(1, 40))), "xy"[i % 2], "s", 0) for i in range(80)]
    docs = documents(spark, made)
    names, prototypes = language.fit_prototypes(docs)
    # A prototype is the sum of its documents' vectors of unit length.
    for k, name in enumerate(names):
        units = [v / np.linalg.norm(v) for v in language.bundles([m[1] for m in made if m[2] == name and zlib.crc32(str(m[0]).encode()) % 4 != 2])]
        assert np.allclose(np.sum(units, axis=0) / np.linalg.norm(np.sum(units, axis=0)), prototypes[k], atol=1e-6)
    for r in rows_of(language.identify_languages(docs)):
        cosines = brute_cosines(made[r["doc_id"]][1], prototypes)
        best = int(np.argmax(cosines))
        assert r["lang_pred"] == names[best] and abs(r["score"] - max(0.0, cosines[best])) < 1e-6 and abs(r["lead"] - (cosines[best] - max(0.0, cosines[1 - best]))) < 1e-6


def test_documents_in_no_language_or_two_go(spark):
    rng = random.Random(22)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["pe", "rs", "ny", "gw"]}
    prose = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(n))
    made = [(i, prose(lang, 40), lang, "s", 0) for i, lang in enumerate(["aa", "bb"] * 60)]
    odd = [(1000, None, "aa", "s", 0), (1001, " 12 ?! ", "aa", "s", 0), (1002, "", None, "s", 0), (1003, "xyzzy qwp ffg " * 30, "aa", "s", 0), (1004, " ".join(f"{prose('aa', 9)} {prose('bb', 9)}" for _ in range(9)), "aa", "s", 0)]
    told = [(2000, prose("aa", 50), None, "s", 0), (2001, prose("bb", 50), "aa", "s", 0), (None, prose("aa", 30), "aa", "s", 0), (2002, prose("aa", 30) * 2000, "aa", "s", 0)]
    docs = documents(spark, made + odd + told).withColumn("a.b", F.lit(1))
    kept = language.in_known_language(docs)
    assert kept.columns == docs.columns
    got = {r["doc_id"]: r["lang"] for r in kept.collect()}
    assert got == {**{m[0]: m[2] for m in made}, 2000: "aa", 2001: "bb", None: "aa", 2002: "aa"}
    assert language.in_known_language(empty(spark)).collect() == []


def test_bundle_is_the_sum_of_bound_letters():
    key = (ord("a") << 42) | (ord("b") << 21) | ord("c")
    want = np.roll(language.letter_vector(97), 2) * np.roll(language.letter_vector(98), 1) * language.letter_vector(99)
    assert (language.trigram_vector(key) == want).all()
    made = language.bundles(["Ab,  c", None, "7"])
    grams = [" ab", "ab ", "b c", " c "]
    total = sum(language.trigram_vector((ord(g[0]) << 42) | (ord(g[1]) << 21) | ord(g[2])) for g in grams)
    assert (made[0] == total).all() and not made[1:].any()


# 3


def brute_simhash(text, words=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius=2):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_near_duplicates(spark):
    got = rows_of(near_dedup.near_duplicates(documents(spark)))
    assert len(got) == len(BASE)
    prints = [brute_simhash(r[1]) for r in BASE]
    roots = brute_components(prints)
    want = collections.Counter()
    for r, fp, root in zip(BASE, prints, roots, strict=True):
        ids = [x[0] for x, y in zip(BASE, roots, strict=True) if y == root and x[0] is not None]
        want[(r[0], f"{fp:016x}", min(ids, default=None))] += 1
    assert collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert rows_of(near_dedup.near_duplicates(empty(spark))) == []


def test_links_keep_every_component(spark):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(60)}
    for start in list(values)[:12]:
        v = start
        for _ in range(12):  # chains and clusters of fingerprints one to three bits apart
            v ^= sum(1 << i for i in rng.sample(range(64), rng.randint(1, 3)))
            values.add(v)
    hub = rng.getrandbits(64)
    values |= {hub} | {hub ^ (1 << i) ^ (1 << j) for i, j in ((rng.randrange(64), rng.randrange(64)) for _ in range(150)) if i != j}
    values = sorted(values)
    edges = near_dedup.links(spark.createDataFrame([(near_dedup.signed(v),) for v in values], "fp long"))
    assert all((r["a"] ^ r["b"]) & 0xFFFFFFFFFFFFFFFF and ((r["a"] ^ r["b"]) & 0xFFFFFFFFFFFFFFFF).bit_count() <= 2 for r in edges.collect())
    roots = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    by_root = collections.defaultdict(set)
    for v, r in zip(values, brute_components(values), strict=True):
        by_root[r].add(near_dedup.signed(v))
    for group in by_root.values():
        assert {roots.get(v, v) for v in group} == {min(group)}


def test_popcount_vectors_bound_the_distance(spark):
    rng = random.Random(9)
    pairs = [(v, v ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 6)))) for v in (rng.getrandbits(64) for _ in range(200))]
    df = spark.createDataFrame([tuple(map(near_dedup.signed, p)) for p in pairs], "a long, b long")
    for r, (a, b) in zip(df.select(near_dedup.cell_of(F.col("a")), near_dedup.cell_of(F.col("b"))).collect(), pairs, strict=True):
        assert sum(abs((r[0] >> 2 * i & 3) - (r[1] >> 2 * i & 3)) for i in range(22)) <= (a ^ b).bit_count()


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(50)], [(0, i) for i in range(1, 60)] + [(100, 101), (101, 100), (99, 101)]])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for a, b in edges if a != b for x in (a, b)})
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_similar_texts_are_deduplicated(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(500)]
    made, near, sets = [], set(), {}

    def shingles(words):
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    for i in range(60):
        words = rng.choices(vocabulary, k=rng.randint(60, 300))
        made.append((10 * i, " ".join(words), "en", "a", 0))
        for k in range(3):  # an exact copy, then copies with one or two words changed, some of them too short to be near
            copy = list(words)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = "changed"
            made.append((10 * i + k + 1, " ".join(copy), "en", "b", 0))
            a, b = shingles(words), shingles(copy)
            (near if len(a & b) >= 0.8 * len(a | b) else sets.setdefault("far", set())).add(10 * i + k + 1)
    rest = [(5000, None, "en", "a", 0), (5001, "", "en", "a", 0), (5002, "two words", "en", "a", 0), (5003, "two words", "de", "a", 0), (None, "two words", "de", "a", 0), (5004, "x " * 30, "de", "a", 0), (5004, "x " * 30, "de", "a", 0)]
    docs = documents(spark, made + rest)
    got = near_dedup.deduplicated(docs)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert len(ids) == len(set(ids))
    assert set(range(0, 600, 10)) | {5000, 5002, 5004} <= set(ids)
    # What is left of the others is no near copy of the first, and two of them may be near each other.
    assert len(sets["far"] - set(ids)) <= 0.2 * len(sets["far"])
    assert not {5001, 5003, None} & set(ids)
    assert len(near & set(ids)) <= 0.03 * len(near)
    assert near_dedup.deduplicated(empty(spark)).count() == 0


def edited_texts(edit, pairs, seed=11):
    """Rows (t, text): text 2i of 200 random words, and text 2i + 1, what ``edit`` makes of its words."""
    rng = random.Random(seed)
    rows = []
    for i in range(pairs):
        words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(200)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edit(words, rng)))]
    return rows


def linked_share(spark, rows):
    got = {r["t"]: r["root"] for r in near_dedup.similar_texts(spark.createDataFrame(rows, "t long, text string")).collect()}
    assert all(root in (t, t - 1) for t, root in got.items())  # no other text is alike
    return len(got) / len(rows)


@pytest.mark.parametrize("edit", [lambda w, rng: w + rng.choices("qrstuvwxyz", k=48), lambda w, rng: w[:161], lambda w, rng: w[39:], lambda w, rng: w[:90] + rng.choices("qrstuvwxyz", k=17) + w[107:]])
def test_copies_appended_or_cut_are_similar(spark, edit):
    assert linked_share(spark, edited_texts(edit, 150)) >= 0.99


@pytest.mark.parametrize("times", [6, 10])
def test_copies_with_a_line_repeated_are_similar(spark, times):
    assert linked_share(spark, edited_texts(lambda w, rng: w + w[:8] * times, 50)) == 1



def test_every_pair_that_shares_a_key_is_compared(spark, monkeypatch):
    # All texts share one key and no fingerprint.  They are four rows of texts, each alike only to the next and last one of
    # its row, so that no text of the key can decide for the others.
    def sketched(batches, words):
        import pyarrow as pa

        for batch in batches:
            t = batch.column("t").to_pylist()
            yield pa.RecordBatch.from_pydict({"t": t, "n": [196] * len(t), "fp": t, "s0": t, "s1": t, "keys": [[7]] * len(t)})

    def fine(batches, words):
        import pyarrow as pa

        for batch in batches:
            t = batch.column("t").to_pylist()
            yield pa.RecordBatch.from_pydict({"t": t, "n": [196] * len(t), **{f"s{i}": t for i in range(16)}, "more": [[x] for x in t], "keys": [[7]] * len(t)})

    monkeypatch.setattr(near_dedup, "_sketched", sketched)
    monkeypatch.setattr(near_dedup, "_fine", fine)
    monkeypatch.setattr(near_dedup, "SKETCH_RADIUS", 128)
    monkeypatch.setattr(near_dedup, "FINE_RADIUS", 1024)
    monkeypatch.setattr(near_dedup, "LONG_RADIUS", 2048)
    monkeypatch.setattr(near_dedup, "links", lambda distinct: distinct.filter("false").selectExpr("fp AS a", "fp AS b"))
    rng, rows = random.Random(5), []
    for k in range(4):
        words = [f"{rng.choice('abcdef')}{rng.randrange(10**6)}" for _ in range(300)]
        rows += [(100 * i + k, " ".join(words[20 * i : 20 * i + 200])) for i in range(4)]
    got = {r["t"]: r["root"] for r in near_dedup.similar_texts(spark.createDataFrame(rows, "t long, text string")).collect()}
    assert got == {t: t % 100 for t, _ in rows}


# 4


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    rng = random.Random(2)
    plain = [(100 + i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "omega", "kappa"], k=40)) + " end.", "en", "a", 0) for i in range(150)]
    junk = [(900, "### $$$ *** %%% &&& ||| <<< >>> " * 8, "en", "a", 0), (901, " ".join(f"w{i}" for i in range(12)) * 6, "en", "a", 0), (902, " ".join(f"a{i}***" for i in range(60)), "en", "zz", 0)]
    rows = BASE + plain + junk
    got = rows_of(quality.judge_quality(documents(spark, rows)))
    told = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = collections.Counter((r[0], *brute_quality(r[1])) for r in rows)
    assert collections.Counter((r["doc_id"], *(r[c] for c in told)) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[p[0]]["kept"] for p in plain if not by_id[p[0]]["base_failed"])
    assert not by_id[900]["kept"] and not by_id[902]["kept"]
    assert rows_of(quality.judge_quality(empty(spark))) == []
    kept = quality.passing_documents(documents(spark, rows))
    assert kept.columns == documents(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["kept"])


def brute_limit(values, parent=None):
    """Median plus four ways to the 0.9 quantile, drawn towards the parent's limit, which counts 100 documents."""
    values = sorted(values)
    mid, high = (values[-(-len(values) * q // 100) - 1] for q in (50, 90))
    own = mid + max(20, 4 * (high - mid))
    return own if parent is None else (len(values) * own + 100 * parent) // (len(values) + 100)


def test_limits_follow_each_source(spark):
    rng = random.Random(12)
    rows = []
    for i in range(900):  # source b writes in capitals and long words, c has many symbols, d is small
        source = rng.choices("abcd", [3, 3, 3, 0.2])[0]
        words = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 5 if source == "a" else 12))) for _ in range(40)]
        words = [w.upper() if source == "b" and rng.random() < 0.5 else w + "#" * (source == "c" and rng.random() < 0.3) for w in words]
        rows.append((i, " ".join(words), rng.choice(["en", None]), source, 0))
    measured = quality.with_measures(documents(spark, rows))
    values = collections.defaultdict(list)
    for r in measured.selectExpr("lang", "source", "__tessera_.metrics AS m").collect():
        for k, v in enumerate(r["m"]):
            for group in ((r["lang"], r["source"], k), (r["lang"], k), (k,)):
                values[group].append(v)
    got = {(r["lang"], r["source"]): r["limits"] for r in quality.thresholds(quality.sketches(measured)).collect()}
    for (lang, source), limits in got.items():
        for k, limit in enumerate(limits):
            assert limit == brute_limit(values[lang, source, k], brute_limit(values[lang, k], brute_limit(values[k,])))
    a, b, c = (got["en", x] for x in "abc")
    assert a[2] < b[2] and a[0] < c[0] and a[3] < b[3]
    # Symbols that are usual in c are off in a.
    many = (a[0] + c[0]) // 2
    odd = [(5000 + i, " ".join(f"{k:03}" + ("a#" if k < many else "ab") for k in range(200)), "en", x, 0) for i, x in enumerate("ac")]
    kept = {r["doc_id"]: r["kept"] for r in rows_of(quality.judge_quality(documents(spark, rows + odd)))}
    assert (kept[5000], kept[5001]) == (False, True)


def test_values_are_rounded_to_ten_bits(spark):
    values = [0, 1, 999, 1023, 1024, 1025, 4095, 123_456_789]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.rounded_down(F.col("v")).alias("r"))
    assert {r["v"]: r["r"] for r in df.collect()} == {v: v >> max(0, v.bit_length() - 10) << max(0, v.bit_length() - 10) for v in values}


def test_sketches_merge(spark):
    measured = quality.with_measures(documents(spark, BASE * 3))
    whole = collections.Counter({tuple(r[:4]): r["n"] for r in quality.sketches(measured).collect()})
    halves = collections.Counter()
    for part in (measured.filter("doc_id % 2 = 0"), measured.filter("doc_id is null or doc_id % 2 <> 0")):
        halves.update({tuple(r[:4]): r["n"] for r in quality.sketches(part).collect()})
    assert whole == halves


# 5


def urls_of_numbers(spark):
    hosts = spark.createDataFrame([(h,) for h in ("1.2.3.4:80", "[::1]:8080", "x.a.co.uk", "y.x.b.org:1", "localhost")], "host string")
    return sorted(tuple(r) for r in hosts.select(*urls.registered_domain(F.col("host"))).collect())


def test_reputation_follows_the_levels(spark):
    # Hosts: (name, labelled pages, bad ones).  All of bad.org is bad, one host of mixed.net is, and new hosts have no page.
    hosts = [("a.bad.org", 30, 27), ("b.bad.org", 20, 19), ("c.bad.org", 0, 0), ("a.mixed.net", 40, 36), *((f"h{i}.mixed.net", 40, 2) for i in range(9)), ("new.mixed.net", 0, 0), *((f"w{i}.good{i % 4}.edu", 50, 3) for i in range(20)), ("new.edu", 0, 0)]
    told, share = urls.host_reputation(spark.createDataFrame(hosts, "host string, n long, bad long"))
    got = {r["host"]: (r["mean"], r["bound"]) for r in told.collect()}
    assert abs(share - sum(h[2] for h in hosts) / sum(h[1] for h in hosts)) < 1e-12 and len(got) == len(hosts)
    assert {h for h, (_, bound) in got.items() if bound > share} == {"a.bad.org", "b.bad.org", "c.bad.org", "a.mixed.net"}
    assert got["c.bad.org"][0] > 0.6 > got["new.mixed.net"][0] > got["new.edu"][0]  # a host without pages is like its domain
    assert all(bound <= mean <= 1 for mean, bound in got.values())


def test_no_outcome_counts_twice(spark):
    # A domain's only host has no evidence from its own domain: its prior comes from the suffix and the corpus.
    hosts = [("x.one.org", 10, 10), ("y.two.org", 10, 0), ("z.three.org", 10, 0)]
    got = {r["host"]: r["mean"] for r in urls.host_reputation(spark.createDataFrame(hosts, "host string, n long, bad long"))[0].collect()}
    # Each prior counts 10 pages, as no level has several groups in a parent but domains.  The rest of .org has 20 good pages
    # and draws a third from the corpus, which has no other suffix: 10 / 3 of 30.
    assert abs(got["x.one.org"] - (10 + 10 * (10 / 3 / 30)) / 20) < 1e-9 and got["y.two.org"] == got["z.three.org"]


def test_urls(spark):
    pages = [
        (1, "http://Example.COM/en/x?q"), (2, "https://www.example.com/en/"), (3, "https://a.www.example.com/en/1"), (4, "http://x.net/es/1"), (5, "http://x.net/fr/1#t"),
        (6, "http://x.net/de/1"), (7, None), (8, "no scheme"), (9, "http://a.com"), (10, "http://a.com?x/y"), (11, "http://notexample.com/en/"), (12, "://"), (13, "http://ÄB.org/p://q"), (13, "http://ÄB.org/p://q"), (None, "http://h.co.uk:80/a"),
    ] + [(100 + i, f"http://bad{i % 3}.spam.org/{i}") for i in range(60)] + [(200 + i, f"http://good{i % 3}.fine.edu/{i}") for i in range(60)]
    labels = [(100 + i, 0, 0) for i in range(60)] + [(200 + i, 1, 0) for i in range(60)] + [(13, None, None), (100, 1, 1), (9999, 0, 1)]
    df = spark.createDataFrame([(*p, "<p>", "h") for p in pages], "page_id long, url string, html string, host string")
    got = rows_of(urls.filter_urls(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert len(got) == len(pages)
    by_id = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert by_id[1] == ("example.com", "/en/x", "example.com/en/", "block")
    assert by_id[2] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert by_id[3][2:] == ("www.example.com/en/", "allow")
    assert by_id[4][2:] == ("net/es/", "block") and by_id[5] == ("x.net", "/fr/1", "net/fr/", "block") and by_id[6][2] is None
    assert by_id[7][:3] == ("", "", None) and by_id[8][:3] == ("", "", None) and by_id[12][:3] == ("", "", None)
    assert by_id[9][:3] == ("a.com", "", None) and by_id[10][:3] == ("a.com", "", None) and by_id[11][2:] == ("com/", "allow")
    assert by_id[13][:2] == ("Äb.org", "/p://q")
    assert all(by_id[100 + i][3] == "block" for i in range(60)) and all(by_id[200 + i][3] == "allow" for i in range(60))
    assert urls_of_numbers(spark) == [("1.2.3.4", ""), ("[::1]", ""), ("a.co.uk", "co.uk"), ("b.org", "org"), ("localhost", "localhost")]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["verdict"] for r in rows_of(urls.filter_urls(df.filter("page_id >= 100"), none))} <= {"allow", "block"}
    assert rows_of(urls.filter_urls(df.filter("false"), none)) == []
    with pytest.raises(ValueError):
        urls.match_rule(F.col("host"), F.col("path"), (("a", "/", "allow"),) * 201)


# 6


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD3 = BSD2 + """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
AS_IS = """

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
GNU = """This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version.

This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2}General Public License for more details."""
NOTICES = {
    "MIT": MIT,
    "BSD-2-Clause": BSD2 + AS_IS,
    "BSD-3-Clause": BSD3 + AS_IS,
    "GPL-2.0-or-later": GNU.format("program", ";", "", ";", "2"),
    "GPL-3.0-or-later": GNU.format("program", ":", "", ",", "3"),
    "LGPL-2.1-or-later": GNU.format("library", ";", "Lesser ", ";", "2.1"),
    "LGPL-3.0-or-later": GNU.format("library", ":", "Lesser ", ",", "3"),
    "AGPL-3.0-or-later": GNU.format("program", ":", "Affero ", ",", "3"),
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def commented(text, mark, width):
    return "\n".join(f"{mark}{line}".rstrip() for part in text.split("\n") for line in (textwrap.wrap(part, width) or [""]))


def licence_texts():
    """Texts and the licences in them."""
    out = []
    for name, text in NOTICES.items():
        one_line = re.sub(r"\s+", " ", text)
        out += [(t, name) for t in (text, text.replace("\n", "\r\n"), one_line, f"Some words before it.\n\n{text}\n\nand after it", f"Copyright (c) 2020 X\n\n{text}")]
        out += [(commented(text, mark, width), name) for mark in ("", " * ", "# ", "// ", "    ") for width in (50, 65, 72, 79, 100)]
    out += [(f"// SPDX-License-Identifier: {tag}\nint main;", tag) for tag in licences.TAGS]
    out += [(BSD3.replace("1. ", " * ").replace("2. ", " * ").replace("3. ", " * "), "BSD-3-Clause"), (BSD2.replace("1. ", "(1) ").replace("2. ", "(2) "), "BSD-2-Clause"), (BSD2.replace("1. ", "a) ").replace("2. ", "b) "), "BSD-2-Clause")]
    out += [(NOTICES["Apache-2.0"].replace("; you", ";\nyou"), "Apache-2.0"), (MIT + "\n\n" + NOTICES["Apache-2.0"], "Apache-2.0,MIT")]
    out += [("Intro\nReleased under the MIT License\nMore", "MIT"), ("Intro.\nReleased under the MIT License.\nMore", "MIT"), ("licensed under the apache license, version 2.0. Also: Licensed under CC BY-NC 4.0.", "Apache-2.0"), ("licensed under the apache license, version 2.0. Licensed under CC BY-NC 4.0.", "Apache-2.0,CC-BY-NC-4.0")]
    out += [("the MIT License is mentioned", ""), (None, ""), ("", ""), ("\n\n. .\n:", ""), ("Released under the MIT License. " * 500, "MIT"), ("no end " * 100_000, "")]
    # Order matters: the conditions before the grant are no BSD licence.
    return out + [("\n\n".join(reversed(BSD2.split("\n\n"))), "")]


def test_licences(spark):
    texts = licence_texts()
    got = {r["doc_id"]: r for r in rows_of(licences.scan_licences(spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(texts)], "doc_id long, text string, licences string")))}
    assert [(texts[i][0], got[i]["licences"]) for i in range(len(texts)) if got[i]["licences"] != texts[i][1]] == []
    assert max(r["n_sentences"] for r in got.values()) == 500
    assert rows_of(licences.scan_licences(empty(spark))) == []


# 7


@pytest.fixture(scope="module")
def coder():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        data = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return bpe.Codec(data, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(coder, monkeypatch):
    mine, theirs = coder
    rng = random.Random(11)
    parts = ["a", "the", " ", "  ", "\n", "\t", "12", "é", "ß", "中文", "🎉", "\u0301", "'s", "'re", "_", "!!", "\x00", "\x85", "\xa0", "\u3000", "½", "zzzzzz", "ing", "Un"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(400)] + [r[1] or "" for r in BASE]
    texts += ["".join(rng.choices("abcdefghijklmnop", k=5000)), "a" * 20000, " " * 3000, "<|endoftext|>"]
    for text in texts:
        assert mine.encode(text) == theirs.encode_ordinary(text)
        assert mine.decode(mine.encode(text)) == text
    # Tables that overflow all the time give the same ids.
    for name in ("MAX_TRANSITIONS", "MAX_SEEN", "MAX_PAIRS"):
        monkeypatch.setattr(bpe, name, 5)
    monkeypatch.setattr(bpe, "TAIL", 0)
    fresh = bpe.Codec(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in mine.transducer.ranks.items()), public_tokenizers.PATTERN, 3)
    for text in texts[:100] + texts[-4:-3]:
        assert fresh.encode(text[:600]) == theirs.encode_ordinary(text[:600])


def test_merges_by_definition_agree_with_the_transducer(coder):
    mine, _ = coder
    rng = random.Random(4)
    for _ in range(300):
        piece = bytes(rng.choices(b"etaoinshr \xc3\xa9", k=rng.randint(1, 14)))
        assert mine.transducer.encode(piece) == bpe.merge(piece, mine.transducer.ranks)


def test_utf8_stream():
    rng = random.Random(6)
    for _ in range(300):
        data = "".join(rng.choices("aé中🎉", k=8)).encode() if rng.random() < 0.6 else bytes(rng.choices([0x41, 0xC3, 0xA9, 0xE4, 0xB8, 0xAD, 0xF0, 0x9F, 0x8E, 0x89, 0xFF, 0xED, 0xA0, 0x80], k=12))
        stream, out, at = bpe.Utf8Stream(), "", 0
        while at < len(data):
            step = rng.randint(1, 4)
            out += stream.push(data[at : at + step])
            at += step
        assert out + stream.end() == data.decode("utf-8", "replace")


def test_encode_documents(spark, coder):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = rows_of(bpe.encode_documents(documents(spark), path, public_tokenizers.PATTERN))
    want = collections.Counter()
    for r in BASE:
        ids = coder[1].encode_ordinary(r[1] or "")
        want[(r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert rows_of(bpe.encode_documents(empty(spark), path, public_tokenizers.PATTERN)) == []
    assert bpe.tokenised_documents(documents(spark).withColumn("a.b", F.lit(1)), path, public_tokenizers.PATTERN).filter("`a.b` = 1").count() == len(BASE)
    assert rows_of(bpe.tokenised_documents(empty(spark), path, public_tokenizers.PATTERN)) == []
    lists = rows_of(bpe.tokenised_documents(documents(spark), path, public_tokenizers.PATTERN))
    assert all(r["round_trip"] and r["token_ids"] == coder[1].encode_ordinary(r["text"] or "") for r in lists) and len(lists) == len(BASE)


# 8


def brute_targets(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


@pytest.mark.parametrize("block_rows", [8, 2048])
def test_mixing(spark, block_rows):
    rng = random.Random(8)
    made = [(1000 + i, "w " * rng.randint(0, 30), "en", rng.choices(["a", "b", "c", None], [10, 2, 1, 1])[0], 0) for i in range(400)]
    rows = BASE + made
    docs = documents(spark, rows)
    got = rows_of(mixing.mix(docs, block_rows=block_rows))
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = brute_targets(sizes)
    by_size = {(sizes[s], round(t, 6)): s for s, t in want.items()}
    taken = collections.Counter()
    for r in got:
        source = by_size[(r["source_size"], round(r["target"], 6))]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[source] += r["taken"]
    # Source c is one long text: it can only be taken or not.
    assert all(abs(taken[s] - want[s]) <= (8 if s != "c" else 30_000) for s in want)
    again = rows_of(mixing.mix(docs.repartition(7), block_rows=block_rows))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(got, key=key) == sorted(again, key=key)
    assert rows_of(mixing.mix(empty(spark))) == []
    mixed = collections.Counter(r["doc_id"] for r in mixing.mixed_documents(docs, block_rows=block_rows).collect())
    assert max(v for k, v in mixed.items() if k not in (None, 9)) <= 2


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 50, 500).astype(float)
    pi = np.full(500, 0.37)
    out = mixing.flight(pi, size, np.random.default_rng(1))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - pi.sum()) < 1e-6 and abs(out @ size - pi @ size) < 1e-5
    landed = mixing.landing(out, size, rng)
    assert set(np.unique(landed)) <= {0.0, 1.0} and abs(landed @ size - pi @ size) <= 50


def test_flight_keeps_the_probabilities():
    size, pi = np.array([3.0, 5, 5, 8, 13, 21, 2, 9]), np.array([0.2, 0.5, 0.9, 0.4, 0.7, 0.3, 0.6, 0.5])
    mean = np.mean([mixing.flight(pi, size, np.random.default_rng(seed)) for seed in range(4000)], axis=0)
    assert np.abs(mean - pi).max() < 0.04


def test_a_row_repeated_many_times(spark):
    # One row makes up nearly the whole table: it is one unit, one item and one slot count, and each copy has its row.
    rows = [(7, "hot words here", "en", "a", 0)] * 50_000 + [(None, "no id", "en", "b", 0)] * 20_000 + [(i, "w " * (i % 9), "en", "a", 0) for i in range(100, 400)]
    docs = documents(spark, rows)
    got = collections.Counter((r["doc_id"], r["taken"]) for r in rows_of(mixing.mix(docs)))
    assert sum(got.values()) == len(rows) and sum(v for (d, _), v in got.items() if d == 7) == 50_000
    assert {d: t for d, t in got if d == 7}.keys() == {7} and all(t in (0, 3, 6) for d, t in got if d == 7)
    mixed = collections.Counter(r["doc_id"] for r in mixing.mixed_documents(docs).select("doc_id").collect())
    assert abs(mixed[7] * 3 - sum(t * v for (d, t), v in got.items() if d == 7)) <= 30
    packed = rows_of(sharding.assign_shards(docs, 8))
    assert len(packed) == len(rows)
    slots, sizes = collections.defaultdict(list), collections.Counter()
    for r in packed:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(sizes.values()) <= 1.05 * min(sizes.values())
    assert near_dedup.deduplicated(docs).filter("doc_id = 7 or doc_id is null").count() == 2


# 9


TURNS = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "more"), (0, 3, "assistant", "A"),
    (1, 0, "user", "hey"), (1, 1, "assistant", "B"), (1, 2, None, None), (2, 0, "user", "alone"), (4, 0, "user", "x"), (4, 1, "assistant", "y"),
    (5, 0, "user", "x"), (5, 1, "assistant", "y"), (6, 0, "system", "s"), (7, 5, "assistant", "s"), (None, 0, "user", "?"), (None, 0, "user", "?"),
    (8, 0, None, None), (8, 0, None, None), (8, None, "assistant", "first"), (9, 3, "assistant", "q"), (9, 3, "assistant", "q"),
]


def conversations(spark, turns=TURNS):
    return spark.createDataFrame([(*t, "p", 1) for t in turns], "conv_id long, turn long, role string, text string, part string, `a.b` int")


def test_chat(spark):
    got = {}
    for r in rows_of(chat.preference_data(conversations(spark))):
        got.setdefault(r["pair_id"], []).append(tuple(r[c] for c in ("record", "prompt", "chosen", "rejected", "single", "chosen_loss", "rejected_loss")))
    turn = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    # The same conversation with the partner's last answer: what comes before it is the prompt, once.
    assert got[0] == [(0, turn("user", "hi") + turn("assistant", "yes") + turn("user", "more"), turn("assistant", "A"), turn("assistant", "B"), None, "14-23", "14-23")]
    assert turn("assistant", "A")[14:23] == "A<|end|>\n"
    # Turns after the last answer are part of the chosen completion, not trained on.
    assert got[1] == [(0, turn("user", "hey"), turn("assistant", "B") + turn("", ""), turn("assistant", "A"), None, "14-23", "14-23")]
    assert got[2] == [(0, None, None, None, turn("user", "alone"), None, None)]
    assert got[4] == [(0, turn("user", "x") + turn("assistant", "y"), None, None, None, None, None)] == got[5]  # equal answers
    assert got[6][0][4] == turn("system", "s") and got[7][0][4] == turn("assistant", "s")
    assert sorted(got[None]) == [(0, None, None, None, turn("user", "?"), None, None)] * 2
    assert got[8] == [(0, None, turn("assistant", "first") + turn("", "") * 2, turn("assistant", "q"), None, "14-27", "14-23")]
    assert got[9] == [(0, turn("assistant", "q"), turn("assistant", "q"), turn("assistant", "first"), None, "14-23", "14-27")]
    assert rows_of(chat.preference_data(conversations(spark).filter("false"))) == []


def test_any_two_conversations_can_be_sides(spark):
    sides = [(1, "chosen", 0, "user", "a"), (1, "chosen", 1, "assistant", "b"), (1, "rejected", 0, "user", "a"), (1, "rejected", 1, "assistant", "c"), (1, "rejected", 2, "user", None), (2, "chosen", 0, "user", "a"), (2, "rejected", 0, "user", "z"), (3, "single", 0, "user", "a")]
    got = collections.Counter(tuple(r) for r in chat.format_preferences(spark.createDataFrame(sides, "pair_id long, side string, position long, role string, text string")).collect())
    assert got == collections.Counter({(1, "prompt", 0, "user", "a", False): 1, (1, "chosen", 0, "assistant", "b", True): 1, (1, "rejected", 0, "assistant", "c", True): 1, (1, "rejected", 1, "user", None, False): 1, (2, "chosen", 0, "user", "a", False): 1, (2, "rejected", 0, "user", "z", False): 1, (3, "single", 0, "user", "a", False): 1})


def test_a_conversation_of_any_length(spark):
    turns = [(0, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(3000)] + [(1, 0, "user", "q"), (1, 1, "assistant", "x" * 300_000)] + [(3, 7, "user", "same")] * 4000
    got = sorted(rows_of(chat.preference_data(conversations(spark, turns))), key=lambda r: (r["pair_id"], r["record"]))
    first = [r for r in got if r["pair_id"] == 0]
    whole = "".join(f"<|{role}|>\n{text}<|end|>\n" for _, _, role, text in turns[:2999])
    assert "".join(r["prompt"] for r in first) == whole and len(first) == 6
    assert [r["rejected"] is not None for r in first] == [True] + [False] * 5 and len(first[0]["rejected"]) > 300_000
    # Repeated turns take a position each.
    assert sum(r["single"].count("same") for r in got if r["pair_id"] == 3) == 4000
    placed = chat.placed_turns(conversations(spark, turns), 64)
    assert [r["text"] for r in placed.filter("conv_id = 0").orderBy("position").collect()] == [t[3] for t in turns[:3000]]


# 10


@pytest.mark.parametrize("block_items", [4, 2048])
def test_sharding(spark, block_items):
    rng = random.Random(10)
    made = [(i, "hot text " * 5 if i % 3 == 0 else "w" * rng.randint(1, 300), "en", "a", 0) for i in range(100, 700)]
    rows = BASE + made
    got = rows_of(sharding.assign_shards(documents(spark, rows), 8, block_items=block_items, fan_in=2, slot_rows=16))
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots, sizes = collections.defaultdict(list), collections.Counter()
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 8
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    homes = collections.defaultdict(set)
    for r in got:
        homes[r["text_crc32"], r["size"]].add(r["shard"])
    share = sum(sizes.values()) / 8
    total = collections.Counter()
    for r in rows:
        total[zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 16] += len((r[1] or "").encode()) + 16
    # Equal texts are apart only if together they exceed a shard's mean.
    assert all(len(homes[k]) == 1 or total[k] > share for k in homes)
    # One text is longer than a shard's mean; the others are near equal.
    rest = sorted(sizes.values())[:-1]
    assert rest[-1] <= (1.1 if block_items > 4 else 1.4) * rest[0]
    assert rows_of(sharding.assign_shards(empty(spark))) == []


@pytest.mark.parametrize(("shards", "apart"), [(8, 1.03), (40, 1.06)])
def test_shards_of_the_smaller_tables(spark, shards, apart):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the driver's tables")
    got = rows_of(sharding.assign_shards(spark.read.parquet(path), shards, block_items=256))
    homes, sizes, counts = collections.defaultdict(set), collections.Counter(), collections.Counter()
    for r in got:
        homes[r["text_crc32"], r["size"]].add(r["shard"])
        sizes[r["shard"]] += r["size"]
        counts[r["shard"]] += 1
    assert all(len(x) == 1 for x in homes.values())
    assert len(sizes) == shards and max(sizes.values()) <= apart * min(sizes.values())
    assert max(counts.values()) <= 1.35 * min(counts.values())
