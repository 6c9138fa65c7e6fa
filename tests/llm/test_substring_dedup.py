import hashlib
import random
import re

import pytest

from tidemark.llm import substring_dedup as s
from tidemark.llm.scratch import Scratch

from .helpers import documents, text

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows):
    first, out = {}, []
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - 12):
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, i), i)
    for i, w in split:
        gone = set() if i is None else {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        out.append((-1 if i is None else i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def corpus():
    rng = random.Random(1)
    passage, rows = text(rng, 40), []
    for i in range(120):
        own = text(rng, rng.randint(0, 60))
        rows.append((i, own + (" " + passage if i % 3 == 0 else "") + " " + text(rng, 10)))
    rows += [(200 + i, rows[i][1]) for i in range(10)]  # copies
    rows += [(300, "x " * 500), (301, "x " * 13), (302, "x " * 12), (303, None), (304, ""), (305, passage.replace(" ", "\n\t")), (306, passage.upper())]
    rows += [(None, passage), (40, passage), (40, passage), (41, text(rng, 13)), (400, "é ü " * 20_000), (401, "é ü " * 7)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"batches": (2000, 2000), "shard_windows": 200}, {"cells_a_window": 0, "batches": (5000, 5000)}])
def test_equals_brute_force(spark, options):
    rows = corpus()
    docs = documents(spark, rows, extra=True).repartition(5)
    out = s.dedup_substrings(docs, Scratch(spark), **options).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in out) == brute(rows)


def test_negative_ids_and_other_names(spark):
    rows = [(-5, "a b c d e f g h i j k l m n"), (-9, "a b c d e f g h i j k l m z"), (0, "q a b c d e f g h i j k l m")]
    docs = spark.createDataFrame(rows, "id int, body string")
    out = {r.id: (r.n_removed, r.kept) for r in s.dedup_substrings(docs, Scratch(spark), "id", "body").collect()}
    assert out == {-9: (0, rows[1][1]), -5: (13, "n"), 0: (13, "q")}


def test_empty_and_one(spark):
    assert s.dedup_substrings(documents(spark, []), Scratch(spark)).count() == 0
    assert s.dedup_substrings(documents(spark, [(1, "a")]), Scratch(spark)).first().n_words == 1


def test_planes_round_trip():
    import numpy as np

    for kind in ("<u4", "<u8", "<i8"):
        v = np.array([0, 1, 255, 256, 70_000, 2**31 - 1], kind)
        assert (s.from_planes(s.planes(v), kind) == v).all()
    assert len(s.from_planes(s.planes(np.array([], "<u4")), "<u4")) == 0


def test_many_segments(spark, monkeypatch):
    monkeypatch.setattr(s, "SEGMENTS", (64, 64))
    rows = corpus()
    out = s.dedup_substrings(documents(spark, rows).repartition(3), Scratch(spark), batches=(3000, 3000)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in out) == brute(rows)


def test_packed_rows():
    ids, texts = [5, None, -(2**63), 2**63 - 1, 0], ["é".encode(), b"x" * 100, None, b"", b"last"]
    assert s.unpack_rows(s.pack_rows(ids, texts)) == (ids, texts)
    assert s.unpack_rows(s.pack_rows([], [])) == ([], [])


def test_query(spark, tmp_path):
    rows = [(1, text(random.Random(2), 50)), (2, text(random.Random(2), 50))]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in s.op10_substring_dedup(spark, str(tmp_path)).collect()}
    assert out[1].kept_sha256 == hashlib.sha256(rows[0][1].encode()).hexdigest()
    assert (out[2].n_removed, out[2].kept_sha256) == (50, hashlib.sha256(b"").hexdigest())
