import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality_rules as q

from .helpers import documents, text

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


rng = random.Random(0)
TEXTS = [
    None, "", " \t\n", "a", "a b", "a b c", "a a a a", "x y z x y z", "a b c a b c d\na b\na b\n a b\n\n\n", "é ü|é ü|# <b> é", "one\x0btwo\x0cthree\x1ffour five six", "a b a b a b a",
    "\U0001f600 ok \U0001f600 ok \U0001f600 ok", "same " * 30_000, text(rng, 5000), " ".join(rng.choice("ab") for _ in range(500)), "  lead and trail  ",
]


def test_statistics_equal_brute_force(spark):
    docs = documents(spark, [*enumerate(TEXTS), (3, "again"), (None, "null id")], extra=True)
    rows = q.text_stats(docs, "text", [F.col("doc_id"), F.col("text").alias("t")]).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.t), (r.t or "")[:50]
    assert q.text_stats(documents(spark, []), "text", [F.col("doc_id")]).count() == 0


@pytest.mark.parametrize("width", [2, 3, 5])
def test_windows_of_other_widths(spark, width):
    w = [random.Random(width).choice("abc") for _ in range(60)]
    windows = Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    covered = {i + j for i in range(len(w) - width + 1) if windows[tuple(w[i : i + width])] > 1 for j in range(width)}
    one = spark.createDataFrame([(w,)], "w array<string>")
    assert one.select(q.repeat_words(F.col("w"), width).alias("n")).first().n == len(covered)


def test_shrinking_by_the_prior(spark):
    rows = [("big", i < 900) for i in range(1000)] + [("tiny", True)] + [(f"h{k}", i < k) for k in range(20) for i in range(100)] + [(None, True)] * 5
    hosts = {r.host: r for r in q.host_verdicts(spark.createDataFrame(rows, "host string, bad boolean"), "host", "bad").collect()}
    assert None not in hosts and len(hosts) == 22
    rates = [900 / 1000, 1.0] + [k / 100 for k in range(20)]
    m = sum(rates) / 22
    v = sum((x - m) ** 2 for x in rates) / 22
    size = m * (1 - m) / v - 1
    a, b = m * size, (1 - m) * size
    for r in hosts.values():
        assert abs(r.rate - (r.failed + a) / (r.n + a + b)) < 1e-9
    assert not hosts["big"].host_kept and hosts["tiny"].rate < 0.9  # one document says little
    same = q.host_verdicts(spark.createDataFrame([("a", True), ("b", True)], "host string, bad boolean"), "host", "bad").collect()
    assert all(abs(r.rate - 2 / 3) < 1e-9 for r in same)  # no variance: a uniform prior
    assert q.host_verdicts(spark.createDataFrame([], "host string, bad boolean"), "host", "bad").count() == 0


@pytest.mark.parametrize("bound", [100_000, 0])
def test_query_equals_its_sql(spark, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(q, "BROADCAST_HOSTS", bound)
    r = random.Random(1)
    rows = [(i, text(r, 80) if i % 3 else "short text") for i in range(200)] + [*enumerate(TEXTS, 300), (None, text(r, 90)), (5, "dup"), (5, "dup")]
    docs = documents(spark, rows).withColumn("source", F.when(F.col("doc_id") % 11 == 0, None).otherwise(F.col("source")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = sorted(map(repr, (tuple(x) for x in q.op8_quality_rules(spark, str(tmp_path)).select(names).collect())))
    assert got == sorted(map(repr, con.sql(f"SELECT {', '.join(names)} FROM ({q.ORACLE_SQL})").fetchall()))
    assert len({x[-6:] for x in got}) > 1
