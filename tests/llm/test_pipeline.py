"""The pipeline's stages against plain Python on the smallest tables."""

import collections
import re
from pathlib import Path

import public_tokenizers
import pytest

import corpus_pipeline
from tessera.llm.bpe import Codec

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(DATA)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = docs.collect()
        ids = collections.Counter(r["doc_id"] for r in after)
        if name != "byte_bpe":
            assert docs.columns == columns
            plain = lambda rows: {tuple(v for k, v in r.asDict().items() if k != "lang" or name != "language_id") for r in rows}  # noqa: B023, E731
            assert plain(after) <= plain(before)
        if name == "quality_rules":
            assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) >= 20 for r in after)
            assert len(after) > 0.6 * len(before)
        elif name == "language_id":
            assert {r["lang"] for r in after} <= {r["lang"] for r in before} and len(after) >= 0.98 * len(before)
        elif name == "near_dedup":
            sets = [shingles(r["text"]) for r in after]
            for i, a in enumerate(sets):
                assert not any(len(a & b) >= 0.8 * len(a | b) for b in sets[:i])
            kept = [shingles(r["text"]) for r in after]
            for r in before:
                if r["doc_id"] not in ids:
                    assert any(len(shingles(r["text"]) & k) >= 0.8 * len(shingles(r["text"]) | k) for k in kept)
        elif name == "source_mixing":
            assert max(ids.values()) <= 2
        elif name == "byte_bpe":
            with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
                one = Codec(f.read(), public_tokenizers.PATTERN)
            assert all(r["round_trip"] and one.decode(r["token_ids"]) == r["text"] for r in after)
        before = after


def test_run_and_empty_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, str(DATA)).count() > 0
    spark.read.parquet(f"{DATA}/documents.parquet").filter("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_dedup", "source_mixing", "byte_bpe"]
