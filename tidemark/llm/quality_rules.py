"""Operator 8, quality rules: host-level rules. DataFrame functions only.

Each document gets word statistics and rule failures. Failures are counted by domain, each domain's failure rate is
shrunk towards the corpus with a beta prior that is fitted to all domains by the method of moments, and the verdict on
a domain joins back to its documents: those of a domain whose shrunk rate is above ``max_rate`` go too.

Null text has no words, which fails; a null domain is no domain, so its documents are judged alone. With no domain, or
all of one rate, the prior is uniform. Repeated rows and ids are judged row by row; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .arrow import fresh, table
from .scratch import Scratch
from .words import SPACES, WORD_RE

SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Domains whose verdicts are broadcast at most; more are joined by a shuffle, where hot ones are split at run time.
BROADCAST_HOSTS = 100_000
#: The shrunk failure rate above which a domain's documents go.
MAX_RATE = 0.5


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare != "", F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def repeat_words(words: Column, width: int = 3) -> Column:
    """How many words lie in a window of ``width`` words that the text has twice or more.

    Windows are sorted with their places, so equal ones are neighbours; the flagged places, sorted again, each cover the
    words up to the next one, ``width`` at most. Nothing is compared pairwise, so a long text of one word is no worse
    than any other. A text without repeated windows is known by its number of distinct ones and not sorted.
    """

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.when(k == 0, F.lit(width)).otherwise(F.least(F.lit(width), x - F.get(p, k - 1))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def flagged(s: Column) -> Column:
        equal = lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
        return let(F.array_sort(F.transform(F.filter(s, lambda x, k: F.coalesce(equal(x, k), F.lit(False))), lambda x: x["i"])), covered)

    def among(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - width)
        hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))

        def counted(h: Column) -> Column:
            pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(pairs), flagged))

        return F.when(F.size(w) < width, F.lit(0)).otherwise(let(hashes, counted))

    return let(words, among)


def text_stats(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) of each whole text.

    A kept column of one of these names stays as it is; the statistic then gets an underscore more.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_RE))
    from_words = let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), F.char_length(F.array_join(w, "")).alias("c"), repeat_words(w).alias("r")))
    kept = docs.select(*keep)
    at = fresh(kept, "_stats")
    stats = F.struct(from_words.alias("w"), F.regexp_count(text, F.lit(SYMBOLS)).alias("s"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("d"))
    named = {"n_words": "w.n", "word_chars": "w.c", "n_symbols": "s", "n_dup_lines": "d", "n_repeat_words": "w.r"}
    return docs.select(*keep, stats.alias(at)).select(*[f"`{c}`" for c in kept.columns], *[F.col(f"{at}.{v}").cast("long").alias(fresh(kept, k)) for k, v in named.items()])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def host_verdicts(judged: DataFrame, host_col: str, failed_col: str, max_rate: float = MAX_RATE) -> DataFrame:
    """``(host, n, failed, rate, host_kept)`` for every domain that is not null.

    The beta prior has the mean and variance of the domains' rates; where the variance is 0, or too large for a beta
    distribution, it is uniform.
    """
    hosts = judged.where(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col(failed_col).cast("long")).alias("failed"))
    rates = hosts.agg(F.avg(F.col("failed") / F.col("n")).alias("m"), F.var_pop(F.col("failed") / F.col("n")).alias("v")).first()  # two numbers
    size = rates.m * (1 - rates.m) / rates.v - 1 if rates.v else 0
    a, b = (rates.m * size, (1 - rates.m) * size) if size > 0 else (1.0, 1.0)
    rate = (F.col("failed") + a) / (F.col("n") + a + b)
    return hosts.select("host", "n", "failed", rate.alias("rate"), (rate <= max_rate).alias("host_kept"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    stats = scratch.cut(text_stats(docs, "text", [F.col("doc_id"), F.col("source").alias("host")]).withColumn("base_failed", base_failed()))
    hosts = scratch.cut(host_verdicts(stats, "host", "base_failed").select("host", "host_kept"))
    hosts = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    kept = ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))
    return stats.join(hosts, "host", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, source, t, {_WORDS} AS w FROM d),
p AS (SELECT k, unnest(range(1, len(w) - 1)) AS i, w FROM w),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, w[i], w[i + 1], w[i + 2]) AS c FROM p),
r AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY k),
s AS (
  SELECT w.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) -
     len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (k)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM s),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS failed FROM f WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT avg(failed / n) AS m, var_pop(failed / n) AS v FROM h),
z AS (SELECT m, m * (1 - m) / nullif(v, 0) - 1 AS size FROM m),
b AS (SELECT CASE WHEN size > 0 THEN m * size ELSE 1 END AS a, CASE WHEN size > 0 THEN (1 - m) * size ELSE 1 END AS b FROM z),
v AS (SELECT source, (failed + a) / (n + a + b) <= {MAX_RATE} AS host_kept FROM h, b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(host_kept, true) AS kept
FROM f LEFT JOIN v USING (source)
"""

QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLE = {"op8_quality_rules": ORACLE_SQL}
