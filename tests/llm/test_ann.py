import math

import numpy as np
import pytest

from tidemark.llm import ann
from tidemark.llm.scratch import Scratch


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, part int, vec int")


def brute(rows, query, k=10):
    q = np.array(dict(rows)[query], float)
    found = sorted((float(np.sqrt(((q - np.array(v, float)) ** 2).sum())), i) for i, v in rows if i != query)
    return [(i, d) for d, i in found[:k]]


def test_one_part_is_exact_with_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(0)
    good = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(60)]
    good += [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(60, 90)]  # equal vectors: ties
    bad = [(200, None), (300, [0.0] * 4), (400, [1.0, None, 0.0, 0.0]), (500, [math.nan] * 4), (600, [math.inf, 0.0, 0.0, 0.0]), (700, [1.0]), (None, [1.0] * 4)]
    vectors = table(spark, good + bad)
    out = ann.search(vectors, vectors.where("vec_id % 10 = 0"), Scratch(spark)).orderBy("query_id", "rank").collect()
    for q in range(0, 90, 10):
        got = [(r.vec_id, r.score) for r in out if r.query_id == q]
        assert [i for i, _ in got] == [i for i, _ in brute(good, q)]
        assert np.allclose([d for _, d in got], [d for _, d in brute(good, q)], rtol=1e-12)
        assert [r.rank for r in out if r.query_id == q] == list(range(1, 11))
    assert {r.query_id for r in out} == set(range(0, 90, 10))


def test_repeated_rows_and_ids(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(40)]
    rows = good + [good[10]] * 13 + good[:20] + [(30, [9.0, 9.0, 9.0, 9.0]), (20, good[20][1]), (3, [50.0, 0.0, 0.0, 0.0])]
    smallest = {}
    for i, v in rows:
        smallest[i] = min(smallest.get(i, v), v)
    vectors = table(spark, rows)
    out = ann.search(vectors, vectors.where("vec_id % 10 = 0"), Scratch(spark)).orderBy("query_id", "rank").collect()
    for q in (0, 10, 20, 30):
        assert [(r.rank, r.vec_id) for r in out if r.query_id == q] == [(k + 1, i) for k, (i, _) in enumerate(brute(list(smallest.items()), q))]
    assert len(out) == 40


def test_length_is_that_of_most_vectors(spark):
    vectors = table(spark, [(i, [float(i), 1.0]) for i in range(1, 6)] + [(10, [1.0]), (20, [2.0]), (30, [3.0, 3.0])])
    out = ann.search(vectors, vectors.where("vec_id % 10 = 0"), Scratch(spark)).collect()
    assert {r.query_id for r in out} == {30} and len(out) == 5


def test_few_and_no_vectors(spark):
    few = table(spark, [(0, [1.0, 2.0]), (10, [1.0, 3.0]), (3, [4.0, 4.0])])
    out = ann.search(few, few.where("vec_id % 10 = 0"), Scratch(spark)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in out) == [(0, 1, 10), (0, 2, 3), (10, 1, 0), (10, 2, 3)]
    none = table(spark, [])
    assert ann.search(none, none, Scratch(spark)).count() == 0


@pytest.mark.parametrize("clustered,most", [(True, 256), (False, 256), (True, 3)])
def test_recall_of_many_parts(spark, monkeypatch, clustered, most):
    monkeypatch.setattr(ann, "MAX_PARTS", most)  # 3: networks of two levels
    monkeypatch.setattr(ann, "PART_ROWS", 200)
    monkeypatch.setattr(ann, "BLOCK", 90)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * (4 if clustered else 0)
    rows = [(i, (centres[i % 20] + rng.normal(size=16)).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(i, rows[0][1]) for i in range(3000, 3200)]  # one common vector
    vectors = table(spark, rows)
    out = ann.search(vectors, vectors.where("vec_id % 50 = 0"), Scratch(spark)).collect()
    hits = total = 0
    for q in range(0, 3200, 50):
        want = {i for i, _ in brute(rows, q)}
        got = [r.vec_id for r in out if r.query_id == q]
        assert len(got) == len(set(got)) == 10
        hits, total = hits + len(want & set(got)), total + 10
    assert hits / total >= 0.9


def test_parts_are_balanced_and_keep_neighbours_together():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(200, 8)) + 20 * rng.normal(size=8) for _ in range(8)])
    near = ann.neighbours(x, 10)
    part = ann.balanced_parts(x, near, 8)
    size = np.bincount(part, minlength=8)
    assert size.max() <= math.ceil(200 * 1.05) and size.min() >= math.floor(200 / 1.05) - 1
    assert (part[near] == part[:, None]).mean() > 0.8


def test_clusters_need_few_probes():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(250, 16)) + 30 * rng.normal(size=16) for _ in range(16)])
    rng.shuffle(x)
    assert ann.learn(x, 16).probes <= 4
