import random
import re

import duckdb
import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash as s
from tidemark.llm.scratch import Scratch

from .helpers import documents, text


def brute(t):
    words = [w for w in __import__("re").findall(rb"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode())]
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, ids, threshold=4):
    best = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= threshold:
                a, b = best[i], best[j]
                best = [min(a, b) if x in (a, b) else x for x in best]
    return [min(ids[j] for j in range(len(ids)) if best[j] == best[i]) for i in range(len(ids))]


@pytest.mark.parametrize("t", [None, "", " \n", "One", "a b c", "a b c d", "A a Å å " * 5, "x\x0by\x0cz\x1fw v u", text(random.Random(2), 3000)])
def test_fingerprint(t):
    assert s.fingerprint(t) == brute(t)


def near_copies(n, rng):
    rows = []
    for i in range(n):
        base = text(rng, 60).split()
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(60)] = "changed"
            rows.append(" ".join(base))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard,leaf", [(16_384, 64), (20, 8)])
def test_components_equal_brute_force(spark, monkeypatch, shard, leaf):
    monkeypatch.setattr(s, "SHARD", shard)
    monkeypatch.setattr(s, "LEAF", leaf)
    rng = random.Random(3)
    rows = [*enumerate(near_copies(60, rng)), (900, None), (901, ""), (902, "dup dup"), (903, "dup dup")]
    rng.shuffle(rows)
    out = s.near_duplicates(documents(spark, rows, extra=True), Scratch(spark)).collect()
    got = {r.doc_id: (r.fp % 2**64, r.component) for r in out}
    ids = [i for i, _ in rows]
    fps = [brute(t) for _, t in rows]
    want = components(fps, ids)
    assert got == {i: (f, c) for i, f, c in zip(ids, fps, want)}


def test_dense_and_equal_bands_in_one_shard():
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 2**63, dtype=np.uint64)
    flips = [np.uint64(0), *(np.uint64(1) << np.uint64(b) for b in range(64))]
    fps = np.unique(np.array([centre ^ a ^ b for a in flips for b in flips], np.uint64))
    fps = np.concatenate([fps, rng.integers(0, 2**63, 500, dtype=np.uint64)])
    masks = s.band_masks()
    forest = s.Forest(len(fps))
    for m in masks:
        root = s.link_shard(fps, np.ones(len(fps), bool), m, 1, 4)
        forest.link(np.arange(len(fps)), root)
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4)
    want = s.Forest(len(fps))
    want.link(i, j)
    every = np.arange(len(fps))
    assert (forest.find(every) == want.find(every)).all()


@pytest.mark.parametrize("depth", [0, 4, 9, 21])
def test_routing_reaches_every_close_pair(depth):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**64, 400, dtype=np.uint64)
    b = a.copy()
    for k in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, len(b)).astype(np.uint64)
    fps, met, copies = np.concatenate([a, b]), np.zeros(400, bool), 0
    for k, m in enumerate(s.band_masks()):
        bits = np.array([i for i in range(64) if int(m) >> i & 1])
        tree = s.Tree(fps[:, None], bits, 1, depth, 7, k)
        rows, shard, member = tree.route(fps[:, None])
        assert tree.shards == 2 ** len(tree.levels) and shard.min() >= 7 and shard.max() < 7 + tree.shards
        assert np.bincount(rows[member], minlength=800).tolist() == [1] * 800
        assert len(set(zip(rows.tolist(), shard.tolist()))) == len(rows) <= 800 * (1 + len(tree.levels))
        homes = {r: sh for r, sh in zip(rows[member].tolist(), shard[member].tolist())}
        reached = {}
        for r, sh in zip(rows.tolist(), shard.tolist()):
            reached.setdefault(r, set()).add(sh)
        met |= np.array([homes[i] in reached[400 + i] for i in range(400)])
    assert met.all()


def test_crossing_costs_add_up():
    rng = np.random.default_rng(6)
    fps = rng.integers(0, 2**64, 300, dtype=np.uint64)[:, None]
    tree = s.Tree(fps, np.arange(64), 3, 6, 0, 0)
    rows, shard, member = tree.route(fps)
    home = shard[member][np.argsort(rows[member])]
    reached = set(zip(rows.tolist(), shard.tolist()))
    i, j = np.nonzero(np.bitwise_count(fps ^ fps.T) <= 24)  # whatever is within the radius must be met
    for x, y in zip(i.tolist(), j.tolist()):
        if int(fps[x, 0] ^ fps[y, 0]).bit_count() <= 3:
            assert (x, home[y]) in reached
    near = fps.copy()
    for k in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, (300, 1)).astype(np.uint64)
    rows, shard, _ = tree.route(near)
    assert {(x, int(home[x])) for x in range(300)} <= set(zip(rows.tolist(), shard.tolist()))


def brute_wide(t, width=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode())
    shingles = {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    ones = [0] * 64 * s.WIDE
    for x in shingles:
        for w in range(s.WIDE):
            z = (xxhash.xxh64_intdigest(x, 42) + (w + 1) * 0x9E3779B97F4A7C15) % 2**64
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
            z ^= z >> 31
            for b in range(64):
                ones[64 * w + b] += z >> b & 1
    return [sum(1 << b for b in range(64) if 2 * ones[64 * w + b] > len(shingles)) for w in range(s.WIDE)], shingles


@pytest.mark.parametrize("t", [None, "", "One", "a b c d e", "a b c d e f", "A a Å å " * 5, text(random.Random(2), 300)])
def test_wide_fingerprint(t):
    assert s.wide_fingerprint(t).tolist() == brute_wide(t)[0]


def test_wide_fingerprints_estimate_similarity():
    rng = random.Random(8)
    assert s.wide_threshold() == 160 and abs(s.differing_share(0.8) - 0.1516) < 1e-3
    for changed in (0, 2, 4, 6, 12, 40):
        base = text(rng, 400).split()
        other = list(base)
        for k in range(changed):
            other[k * 400 // max(changed, 1)] = "changed"
        (a, x), (b, y) = brute_wide(" ".join(base)), brute_wide(" ".join(other))
        j = len(x & y) / len(x | y)
        d = sum((p ^ q).bit_count() for p, q in zip(a, b))
        assert abs(d / 1024 - s.differing_share(j)) < 0.05


def wide_rows(rng, n, words=s.WIDE):
    """Fingerprints in groups of near ones: a base with some of its bits flipped."""
    base = rng.integers(0, 2**64, (n, words), dtype=np.uint64)
    out = [base]
    for share in (0.02, 0.05, 0.08):
        flip = np.packbits(rng.random((n, 64 * words)) < share, axis=1, bitorder="little").view("<u8")
        out.append(base ^ flip)
    return np.unique(np.concatenate(out), axis=0)


def linked(n, i, j):
    forest = s.Forest(n)
    forest.link(np.asarray(i), np.asarray(j))
    return forest.find(np.arange(n))


@pytest.mark.parametrize("block", [True, False])
def test_similar_links_equal_brute_force(spark, monkeypatch, block):
    """Every link is right, and nearly all that brute force finds are found, though shards are small or cut into blocks."""
    from tidemark.llm.arrow import prepare

    prepare(spark)
    rng = np.random.default_rng(9)
    fps = wide_rows(rng, 400)
    crowd = rng.integers(0, 2**64, (1, s.WIDE), dtype=np.uint64)
    crowd = np.unique(np.concatenate([crowd, crowd ^ np.packbits(rng.random((500, 64 * s.WIDE)) < 0.06, axis=1, bitorder="little").view("<u8")]), axis=0)
    fps = np.concatenate([fps, crowd])
    monkeypatch.setattr(s, "WIDE_SHARD", 4 if block else 64)
    if block:
        monkeypatch.setattr(s, "CROWD", 2.0)  # no group counts as large: its shards are cut
    names = [f"f{k}" for k in range(s.WIDE)]
    rows = [(*map(int, x), k) for k, x in enumerate(fps.view(np.int64))]
    reps = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in [*names, "rep"]))
    found = s.similar_links(reps).toPandas()
    d = np.bitwise_count(fps[found.a] ^ fps[found.b]).sum(1)
    assert d.max() <= s.wide_threshold()
    got = linked(len(fps), found.a, found.b)
    i, j = np.nonzero(sum(np.bitwise_count(fps[:, None, w] ^ fps[None, :, w]).astype(np.int64) for w in range(s.WIDE)) <= s.wide_threshold())
    want = linked(len(fps), i, j)
    assert (got[i] == got[j]).mean() > 0.97
    assert len(set(got[-500:])) < 5 and len(np.unique(want)) <= len(np.unique(got)) < 1.1 * len(np.unique(want))


def test_link_wide_equals_brute_force():
    rng = np.random.default_rng(10)
    fps = np.concatenate([wide_rows(rng, 60), wide_rows(rng, 1)[:1] ^ np.packbits(rng.random((300, 64 * s.WIDE)) < 0.07, axis=1, bitorder="little").view("<u8")])
    d = np.bitwise_count(fps[:, None] ^ fps[None]).sum(2, dtype=np.int64)
    for member in (np.ones(len(fps), bool), rng.random(len(fps)) < 0.5):
        i, j = np.nonzero((d <= s.wide_threshold()) & member[:, None])
        assert (s.link_wide(fps, member, s.wide_threshold()) == linked(len(fps), i, j)).all()


def test_query_equals_its_sql(spark, tmp_path):
    rng = random.Random(12)
    rows = [*enumerate(near_copies(30, rng)), (500, None), (501, ""), (502, "One two"), (502, "A B c d E"), (None, "A B c d E"), (None, "alone " * 9), (503, " ".join("w" * n for n in range(1, 90))), (504, "Å é ü 東京 " * 7), (505, "x" * 5000)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(repr, map(tuple, s.op2_simhash_near_dedup(spark, str(tmp_path)).collect())))
    assert got == sorted(map(repr, con.sql(s.ORACLE["op2_simhash_near_dedup"]).fetchall()))


def test_null_ids_repeated_rows_and_empty(spark):
    rows = [(None, "alone in this text here"), (None, "shared text of two rows"), (5, "shared text of two rows"), (5, "shared text of two rows")]
    out = s.near_duplicates(documents(spark, rows), Scratch(spark)).collect()
    assert sorted((r.doc_id or -1, r.component or -1) for r in out) == [(-1, -1), (-1, 5), (5, 5), (5, 5)]
    assert s.near_duplicates(documents(spark, []), Scratch(spark)).count() == 0


def test_keep_one(spark):
    rng = random.Random(4)
    a, b = text(rng, 80), text(rng, 80)
    docs = documents(spark, [(1, a), (2, a), (2, a), (3, b), (3, b), (None, a), (4, a + " more"), (None, "alone in this text here"), (None, "alone in this text here")], extra=True)
    kept = s.keep_one(docs, Scratch(spark))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3]
    assert s.keep_one(documents(spark, []), Scratch(spark)).count() == 0


def test_keep_one_judges_rows_of_one_id_by_their_texts(spark):
    rng = random.Random(6)
    a, b, c, d = (text(rng, 80) for _ in range(4))
    rows = [(1, a), (5, a), (5, b), (5, b), (6, b), (7, c), (7, d), (7, None), (8, ""), (None, c), (None, d)]
    kept = s.keep_one(documents(spark, rows, extra=True), Scratch(spark)).collect()
    got = sorted((r.doc_id or 0, r.text or "") for r in kept)
    assert got == sorted([(1, a), (5, b), (7, c), (7, d), (7, "")])
    # once a row is a copy of a smaller id, its id's other texts stay; no group loses all its rows
    assert {r.text or "" for r in kept} == {a, b, c, d, ""}


def test_keep_one_takes_near_copies_at_a_similarity_of_08(spark):
    """Against exact Jaccard similarities of the test table's documents, over distinct shingles of five words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sets = [brute_shingles(t) for _, t in rows]
    by = {}
    for i, x in enumerate(sets):
        for h in x or {""}:
            by.setdefault(h, []).append(i)
    pairs = {(i, j) for v in by.values() if len(v) < 200 for k, i in enumerate(v) for j in v[k + 1 :]}
    jaccard = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] else 1.0 for i, j in pairs}
    at = {i: k for k, (i, _) in enumerate(rows)}
    kept = {at[r.doc_id] for r in s.keep_one(docs, Scratch(spark)).collect()}
    sure = linked(len(rows), *zip(*[p for p, v in jaccard.items() if v >= 0.86]))
    loose = linked(len(rows), *zip(*[p for p, v in jaccard.items() if v >= 0.7]))
    for k in range(len(rows)):
        if sure[k] != k:  # the root is the smallest of its group
            assert k not in kept, rows[k][0]
        if loose[k] == k:
            assert k in kept, rows[k][0]
    exact = linked(len(rows), *zip(*[p for p, v in jaccard.items() if v >= 0.8]))
    wrong = kept ^ set(np.unique(exact).tolist())
    assert len(wrong) <= 0.01 * len(rows)


def brute_shingles(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
