"""Pattern packing: exact round trips and places without gaps or overlaps."""

import zlib

import numpy as np
import pytest
from helpers import ODD, empty_docs, odd_docs

from freshet.llm import packing, queries


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def whole_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def hold_places(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_whole_table(spark, sf_dir, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op3_pattern_packing(spark, sf_dir).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    total = 0
    for doc_id, text in texts.items():
        ids, at = whole_ids(tokenizer, text), 0
        parts = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts)))
        assert len(parts) == -(-len(ids) // 2048)
        for p in parts:
            assert p.start == at and (p.piece == 0 or p.length == 2048)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)
        total += at
    assert hold_places(rows, 2048) <= 1.01 * -(-total // 2048) + 1


def test_odd_texts_encode_as_whole(tokenizer):
    encoder = packing.Encoder(queries.tokenizer_path())
    texts = [t or "" for t in ODD] + ["a  b   c\n\n d\t\te 　 f", "it's they'll 'quoted' I'M", "  lead", "trail  ", "x y    z\x85", "1234567890 a1b2", "\x1c\x1d\x1e\x1f mixed \x1f", "é ñ", "᠎​﻿"]
    for text, got in ((t, encoder.encode(t)) for t in texts):
        assert np.frombuffer(got, dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_code_points_encode_as_whole(tokenizer):
    """Every 16-bit code point, and a few beyond, between letters, digits and blanks."""
    encoder = packing.Encoder(queries.tokenizer_path())
    assert encoder.pairs is not None
    for start in (*range(0, 0xD800, 512), *range(0xE000, 0x20000, 512), 0x20000, 0x10FE00):
        text = "".join(f"a{chr(c)}b 1{chr(c)} {chr(c)}\n" for c in range(start, start + 512))
        assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, hex(start)


def test_other_tokenizers_encode_by_themselves(tokenizer, tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    other = Tokenizer.from_str(tokenizer.to_str())
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    other.save(str(tmp_path / "other.json"))
    encoder = packing.Encoder(str(tmp_path / "other.json"))
    assert encoder.pairs is None
    for text in ("a b  c", "one\n two", "x" * 5000):
        assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == other.encode(text, add_special_tokens=False).ids


def test_odd_rows_and_sequences(spark, tokenizer):
    docs = odd_docs(spark)
    cut = packing.scratch(packing.pieces(docs, queries.tokenizer_path(), capacity=16), "test-pieces")
    packed = packing.pack(cut, 16)
    rows = packed.collect()
    hold_places(rows, 16)
    assert sum(r.length for r in rows) == sum(len(whole_ids(tokenizer, r.text)) for r in docs.collect())
    for r in packing.sequences(cut, packed).collect():
        assert len(r.ids) == 4 * sum(p.length for p in rows if p.sequence_id == r.sequence_id)
    assert packing.pack_documents(empty_docs(spark), queries.tokenizer_path()).count() == 0
    assert packing.pack_documents(odd_docs(spark, clash=True), queries.tokenizer_path()).count() == len(ODD) + 2


def test_plan_places_every_piece():
    rng = np.random.default_rng(2)
    for counts in ({}, {2048: 3}, {1: 5000}, {1025: 7, 1024: 2}, {int(n): int(c) for n, c in zip(rng.integers(1, 2049, 300), rng.integers(1, 400, 300), strict=True)}, {700: 90, 300: 1000, 5: 3}):
        runs, n = packing.plan(counts)
        used, placed = np.zeros(n, dtype=int), {}
        for length, first, ranks, sequence, offset in runs.tolist():
            assert (used[sequence : sequence + ranks] <= 2048).all()
            used[sequence : sequence + ranks] += length
            placed.setdefault(length, []).append((first, ranks))
        assert (used <= 2048).all()
        assert {k: sum(m for _, m in v) for k, v in placed.items()} == counts
        assert n <= 1.02 * -(-sum(k * v for k, v in counts.items()) // 2048) + 2 or max(counts) > 1024 or counts.keys() == {700, 300, 5}
