import hashlib

import duckdb
import numpy as np

from tidemark.llm import mixing as m
from tidemark.llm.scratch import Scratch

from .helpers import documents


def shares_of(w, p):
    kept = w * p
    return [kept.sum(tuple(k for k in range(w.ndim) if k != axis)) / kept.sum() for axis in range(w.ndim)]


def test_raking_meets_marginals():
    rng = np.random.default_rng(0)
    w = rng.integers(1, 1000, (4, 3, 2)).astype(float)
    targets = [np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.25, 0.25]), np.array([0.7, 0.3])]
    f = m.rake(w, targets, np.array([w.sum()]), np.array([np.inf]), 50)[0]
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(shares_of(w, f), targets)) and np.isclose((w * f).sum(), w.sum())
    ratio = f[:, :1, :1] * f[:1, :, :1] * f[:1, :1, :] / f[0, 0, 0] ** 2  # factors are products of one per axis
    assert np.allclose(ratio, f)


def test_values_without_tokens_and_no_tokens():
    w = np.array([[5.0, 5.0], [0.0, 0.0]])
    p = m.probabilities(w, [np.array([0.5, 0.5]), np.array([0.8, 0.2])], 0.5)
    assert np.allclose((w * p).sum(0), [4, 1])
    assert (m.probabilities(np.zeros((2, 2)), [np.array([0.5, 0.5])] * 2, 0.7) == 0.7).all()
    assert (m.probabilities(w, [np.array([0.0, 1.0]), np.array([0.5, 0.5])]) == 0).all()  # no token has a source that is wanted


def brute_draw(i):
    return int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16) / 2**32


def test_rows_and_their_draws(spark):
    rows = [(i, f"word {i} " * (i % 7)) for i in range(300)] + [(None, "null id"), (5, None), (5, "twice"), (6, ""), (7, "long " * 100_000)]
    docs = documents(spark, rows, extra=True)
    out = m.judged(docs, m.TARGETS, Scratch(spark)).collect()
    assert len(out) == len(rows) and all(0 <= r.keep_probability <= 1 for r in out)
    assert sorted(r.tokens for r in out) == sorted(len((t or "").split()) for _, t in rows)
    kept = m.mixed(docs, m.TARGETS)
    assert kept.columns == docs.columns
    want = sorted((r.doc_id is not None, r.doc_id or 0) for r in out if r.kept)
    assert all(r.kept == (brute_draw(r.doc_id) < r.keep_probability) for r in out if abs(brute_draw(r.doc_id) - r.keep_probability) > 1e-6)
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == want
    assert m.mixed(documents(spark, []), m.TARGETS).count() == 0


def test_expected_tokens_meet_targets(spark):
    docs = documents(spark, [(i, "plain words only") for i in range(3000)])
    targets = {"source": {"src0": 0.5, "src1": 0.25, "src2": 0.25}}
    values = {"source": docs.source}
    mixture = m.calibrate(docs, values, m.tokens_of(docs.text), targets, keep=0.5)
    shares = docs.groupBy("source").agg(__import__("pyspark.sql.functions").sql.functions.avg(mixture.column(values)).alias("p")).collect()
    got = {r.source: r.p for r in shares}
    assert np.allclose([got["src0"], got["src1"], got["src2"]], [0.75, 0.375, 0.375])


def test_query_equals_its_sql(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["a license b", "x 1 y", "plain text", "", None, "All rights reserved."] * 30)]
    docs = documents(spark, [*rows, (3, "again 3"), (None, "null id")])
    docs = docs.selectExpr("doc_id", "text", "CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 'xx' ELSE lang END AS lang", "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS source")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = ["doc_id", "tokens", "topic", "keep_probability", "kept"]
    got = sorted(map(repr, (tuple(r) for r in m.op7_mixing(spark, str(tmp_path)).select(names).collect())))
    assert got == sorted(map(repr, con.sql(f"SELECT {', '.join(names)} FROM ({m.ORACLE['op7_mixing']})").fetchall()))


def test_rare_cells_keep_their_target_shares(spark):
    rng = np.random.default_rng(1)
    w = rng.integers(200, 1000, (4, 3, 2)).astype(float) * np.array([0.02, 1, 1, 3])[:, None, None]
    targets = [np.array([0.25, 0.05, 0.05, 0.65]), np.array([0.5, 0.3, 0.2]), np.array([0.3, 0.7])]
    p = m.probabilities(w, targets)
    kept = w * p
    assert p.min() >= 0 and p.max() <= 1
    assert all(np.allclose(a, b, atol=1.01e-3) for a, b in zip(shares_of(w, p), targets))
    assert kept.sum() > 0.9 * w[0].sum() / 0.25  # the rare value is kept nearly whole
    assert np.isclose((w * m.probabilities(w, [w.sum((1, 2)) / w.sum(), *targets[1:]], 0.3)).sum(), 0.3 * w.sum(), rtol=1e-3)
    apart = m.probabilities(np.diag([10.0, 30.0]), [np.array([0.9, 0.1]), np.array([0.1, 0.9])])  # no share meets both
    assert 0 < apart[np.eye(2) > 0].min() and apart.max() <= 1

    docs = documents(spark, [(i, "plain words only") for i in range(3000)]).selectExpr("*", "CASE WHEN doc_id % 50 = 0 THEN 'rare' ELSE 'common' END AS kind")
    got = m.calibrate(docs, {"kind": docs.kind}, m.tokens_of(docs.text), {"kind": {"rare": 0.25, "common": 0.75}})
    reached = {r.kind: r.p for r in docs.select("kind", got.column({"kind": docs.kind}).alias("p")).groupBy("kind").agg({"p": "sum"}).toDF("kind", "p").collect()}
    assert 0.95 * 60 < reached["rare"] <= 60 and np.isclose(reached["common"], 3 * reached["rare"], rtol=1e-2)


def test_kept_tokens_meet_targets_on_the_test_table(spark):
    """What the registered query keeps, not only what it expects: token shares of the drawn rows."""
    out = m.op7_mixing(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source", "lang"), "doc_id").toPandas()
    weight = out.tokens * out.keep_probability
    for d, column in (("source", "source"), ("lang", "lang"), ("topic", "topic")):
        named = out[column].where(out[column].isin([k for k in m.TARGETS[d] if k != m.OTHER]), m.OTHER)
        wanted = {k: share for k, share in m.TARGETS[d].items() if out.tokens[named == k].sum()}
        for k, share in wanted.items():
            share /= sum(wanted.values())
            assert abs(weight[named == k].sum() / weight.sum() - share) < 2e-3, (d, k)
            assert abs(out.tokens[(named == k) & out.kept].sum() / out.tokens[out.kept].sum() - share) < 0.06, (d, k)
