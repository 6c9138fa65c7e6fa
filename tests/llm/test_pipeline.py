import corpus_pipeline as c
import numpy as np
from tidemark.llm import mixing, packing, quality_classifier as q, secret_scans, simhash

from tidemark.llm.scratch import Scratch

SF = "/root/testdata/sf0.01"


def test_stages_equal_their_operators_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in c.STAGES] == ["quality_classifier", "simhash_near_dedup", "secret_scans", "mixing", "best_fit_packing"]
    stages = dict(c.STAGES)

    model = q.production_model(spark, docs, SF)
    good = stages["quality_classifier"](spark, docs, SF)
    score = model.score(np.array([q.statistics(r.text) for r in rows.values()]))
    assert good.columns == docs.columns
    kept = {i for i, s in zip(rows, score) if s >= 0.3}
    assert {r.doc_id for r in good.collect()} == kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    poor = [i for i, v in labels.items() if v == 0]
    assert all(i in kept for i, v in labels.items() if v == 1) and sum(i in kept for i in poor) < len(poor) / 4

    distinct = stages["simhash_near_dedup"](spark, good, SF)
    # texts of five-word shingles whose long fingerprints are near, by all pairs
    ids = sorted(kept)
    fps = np.array([simhash.wide_fingerprint(rows[i].text) for i in ids])
    forest = simhash.Forest(len(fps))
    forest.link(*np.nonzero(sum(np.bitwise_count(fps[:, None, w] ^ fps[None, :, w]).astype(np.int64) for w in range(fps.shape[1])) <= simhash.wide_threshold()))
    root = forest.find(np.arange(len(fps)))
    want = {ids[k] for k in np.unique(root)}
    assert distinct.columns == docs.columns and sorted(r.doc_id for r in distinct.collect()) == sorted(want)

    clean = stages["secret_scans"](spark, distinct, SF)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == docs.columns and texts == {i: secret_scans.redact(rows[i].text) for i in want}
    assert not any(secret_scans.find_secrets(t) for t in texts.values())
    assert all(r.n_chars == len(r.text) for r in clean.collect())

    mixed = stages["mixing"](spark, clean, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= want
    drawn = {r.doc_id for r in mixing.judged(clean, mixing.TARGETS, Scratch(spark)).collect() if r.kept}
    assert {r.doc_id for r in mixed.collect()} == drawn and drawn

    packed = c.run(spark, SF).collect()
    encode = packing.Encoder.of(packing.VOCABULARY).ids
    lengths = {r.doc_id: len(encode(r.text)) + 1 for r in mixed.collect()}
    got = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == lengths


def test_empty_documents(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in c.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
