"""Small tables for the operators' tests."""

import random

WORDS = [f"w{i}" for i in range(400)]


def text(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, rows, extra=False):
    """rows: (doc_id, text); with ``extra``, columns whose names operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(data, schema)
    if extra:
        for name in ("_nth", "_row", "_shard", "_score", "fp", "rep", "score", "h", "tkey", "secrets", "part", "vec", "label", "host", "key", "_d", "_w", "_s", "_p", "_stats", "offset", "sequence_id", "piece", "record_type", "block", "n_words", "word_chars"):
            df = df.selectExpr("*", f"1 AS {name}")
    return df
