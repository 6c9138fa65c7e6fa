import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing as p
from tidemark.llm.scratch import Scratch

from .helpers import documents, text

EXACT = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(t):
    return EXACT.encode(t or "", add_special_tokens=False).ids + [2]


def test_encoder_equals_the_exact_one_for_every_character():
    encode = p.Encoder.of(p.VOCABULARY).ids
    for lo in range(0, 0x20000, 0x4000):
        texts = [f"a{c}b 1{c}2 {c} {c}{c}x  {c}'s.{c}\n{c}" for c in map(chr, range(lo, lo + 0x4000)) if not "\ud800" <= c <= "\udfff"]
        assert [x.ids for x in EXACT.encode_batch(texts, add_special_tokens=False)] == [encode(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_encoder_equals_the_exact_one(t):
    for s in (t, t + p.SPECIAL + t):
        assert p.Encoder.of(p.VOCABULARY).ids(s) == EXACT.encode(s, add_special_tokens=False).ids


@pytest.mark.parametrize("n,want", [(1, [(0, 1)]), (1024, [(0, 1024)]), (1025, [(0, 1), (1, 1024)]), (2048, [(0, 1024), (1024, 1024)]), (2500, [(0, 452), (452, 1024), (1476, 1024)])])
def test_pieces(n, want):
    assert p.pieces(np.zeros(n)) == want


def brute_sum_of_squares(lengths, capacity):
    """By definition: try each open sequence, square the counts."""
    bins = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        best = None
        for gap in sorted({g for g in bins if lengths[i] <= g < capacity}):
            after = list(bins)
            after[bins.index(gap)] -= lengths[i]
            counts = {}
            for g in after:
                if g:
                    counts[g] = counts.get(g, 0) + 1
            cost = sum(c * c for c in counts.values())
            if best is None or cost < best[0]:
                best = (cost, gap)
        if best is None:
            bins.append(capacity - lengths[i])
        else:
            bins[bins.index(best[1])] -= lengths[i]
    return sorted(bins)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_sum_of_squares_equals_its_definition(lengths):
    sequence, offset = p.sum_of_squares(np.array(lengths, np.int64), 20)
    used = {}
    for s, o, n in sorted(zip(sequence.tolist(), offset.tolist(), lengths)):
        assert used.get(s, 0) == o
        used[s] = o + n
    assert sorted(20 - u for u in used.values()) == brute_sum_of_squares(lengths, 20)


def test_few_sequences():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 1024, 4096)
    sequence, _ = p.sum_of_squares(lengths)
    assert sequence.max() + 1 <= -(-lengths.sum() // 1024) * 1.01


@pytest.mark.parametrize("shard", [4096, 7])
def test_documents(spark, monkeypatch, shard):
    monkeypatch.setattr(p, "SHARD", shard)
    rng = random.Random(1)
    rows = [(i, text(rng, rng.randint(0, 900))) for i in range(60)] + [(100, None), (101, ""), (102, text(rng, 20_000)), (102, "again"), (102, "again"), (None, "null id"), (103, f"a{p.SPECIAL}b")]
    out = p.pack_documents(documents(spark, rows, extra=True), Scratch(spark)).collect()
    want = sorted((i if i is not None else -1, k, a, n, zlib.crc32(np.array(ids_of(t)[a : a + n], "<u4").tobytes())) for i, t in rows for k, (a, n) in enumerate(p.pieces(np.array(ids_of(t)))))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    filled = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 1024
    assert p.pack_documents(documents(spark, []), Scratch(spark)).count() == 0


def test_ids_come_along(spark):
    rows = p.tokenized_pieces(documents(spark, [(1, "Hello world")]), with_ids=True).collect()
    assert rows[0].ids == ids_of("Hello world")


@pytest.mark.parametrize("t", [" " * 5_000_000, "a" + "\n" * 1_000_000 + "b", "a" * 2_000_000, "\u3000" * 300_000, "1" * 1_000_000, " a" * 1_000_000], ids=lambda t: f"{t[:2]!r}x{len(t)}")
def test_long_runs(t):
    start = time.time()
    assert p.Encoder.of(p.VOCABULARY).ids(t) == ids_of(t)[:-1]
    assert time.time() - start < 60


def test_names_of_parts_stay(spark):
    parts = spark.createDataFrame([(1, 5, "x", 7), (2, 1024, "y", 8)], "doc_id long, length long, offset string, Sequence_ID int")
    out = p.pack(parts, Scratch(spark))
    assert out.columns == ["doc_id", "length", "offset", "Sequence_ID", "sequence_id_", "offset_"]
    assert sorted((r.doc_id, r.offset, r.Sequence_ID, r.offset_) for r in out.collect()) == [(1, "x", 7, 0), (2, "y", 8, 0)]
