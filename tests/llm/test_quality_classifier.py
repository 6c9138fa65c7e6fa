import random

import numpy as np

from tidemark.llm import quality_classifier as q

from .helpers import documents, text


def labelled(n=300):
    rng = random.Random(1)
    good = [(i, text(rng, rng.randint(40, 120)).capitalize() + ".") for i in range(0, n, 2)]
    bad = [(i, " ".join(w.upper() + "!!" for w in text(rng, rng.randint(40, 120)).split())) for i in range(1, n, 2)]
    return sorted(good + bad)


def test_traversal_equals_a_walk_through_each_tree():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 6))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=500) * 0.3 > 0).astype(float)
    m = q.fit(x, y, trees=80, depth=4)

    def walk(row):
        total = m.start
        for t in range(len(m.feature)):
            i = 0
            for _ in range(m.depth):
                i = m.right[t, i] if row[m.feature[t, i]] > m.threshold[t, i] else m.left[t, i]
            total += m.value[t, i]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(m.score(x), [walk(r) for r in x])
    assert ((m.score(x) > 0.5) == y).mean() > 0.9


def test_gain_of_the_first_split_is_the_best_of_all():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 9, size=(200, 3)).astype(float)
    y = (x[:, 1] > 4).astype(float)
    m = q.fit(x, y, trees=1, depth=1, least=1)
    assert m.feature[0, 0] == 1 and m.threshold[0, 0] == 4


def test_held_out_accuracy_and_edges(spark):
    rows = labelled()
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i, _ in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, [*rows, (1000, None), (1001, ""), (1002, "x" * 100_000), (4, rows[4][1]), (None, "null id")], extra=True)
    model = q.learn(docs, labels.where(~q.is_held_out(labels.doc_id)))
    out = q.score_documents(docs, model, "text", "s").select("doc_id", "s", q.is_held_out(docs.doc_id).alias("held")).collect()
    assert len(out) == len(rows) + 5 and all(0 <= r.s <= 1 for r in out)
    held = [r for r in out if r.held and r.doc_id is not None and r.doc_id < 300]
    assert held and np.mean([(r.s >= 0.5) == (r.doc_id % 2 == 0) for r in held]) > 0.95


def test_no_or_one_kind_of_labels_and_no_documents(spark):
    docs = documents(spark, labelled(20))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.s for r in q.score_documents(docs, q.learn(docs, none), "text", "s").collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert all(r.s > 0.99 for r in q.score_documents(docs, q.learn(docs, ones), "text", "s").collect())
    assert q.score_documents(documents(spark, []), q.learn(docs, ones), "text", "s").count() == 0


def test_sample_is_bounded(spark):
    rows = labelled(100)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, quality int")
    assert q.learn(documents(spark, rows), labels, max_labelled=10).depth  # ten rows are enough to fit


def plain_boosting(x, y, trees, depth, bins, rate, least, shrink):
    """The same fit without histograms: every cut of every feature is tried on the rows themselves, node by node."""
    n, width = x.shape
    cuts = [sorted(set(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))) for c in x.T]
    start = np.log(y.mean() / (1 - y.mean()))
    logit = np.full(n, start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - y, p * (1 - p)

        def grow(rows, level):
            best = (1e-6, None)
            for f in range(width) if level < depth else ():
                for cut in cuts[f]:
                    left = rows[x[rows, f] <= cut]
                    right = rows[x[rows, f] > cut]
                    if h[left].sum() < least or h[right].sum() < least:
                        continue
                    gain = g[left].sum() ** 2 / (h[left].sum() + shrink) + g[right].sum() ** 2 / (h[right].sum() + shrink) - g[rows].sum() ** 2 / (h[rows].sum() + shrink)
                    if gain > best[0] + 1e-9:
                        best = (gain, (left, right))
            if best[1] is None:
                logit[rows] += -rate * g[rows].sum() / (h[rows].sum() + shrink)
            else:
                grow(best[1][0], level + 1)
                grow(best[1][1], level + 1)

        grow(np.arange(n), 0)
    return 1 / (1 + np.exp(-logit))


def test_a_whole_fit_equals_a_plain_one():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)).round(2)
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 2] + rng.normal(size=300) * 0.4 > 0).astype(float)
    kind = dict(trees=6, depth=3, bins=16, rate=0.3, least=2.0, shrink=1.0)
    assert np.allclose(q.fit(x, y, **kind).score(x), plain_boosting(x, y, **kind), atol=1e-9)
