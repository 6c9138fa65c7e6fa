"""Operator 7, mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Token weights of (source, language, topic) cells are raked: in turn for each of the three dimensions, cells are scaled so
that their sums meet that dimension's target shares. What a target does not name is one value, ``OTHER``, so there are
at most as many cells as the product of the targets' sizes, whatever the corpus holds: cells are counted where the
documents are, and only their sums are raked on the driver. A document is kept with its cell's probability. Nothing is
repeated, so no probability may be above 1: after each scaling cells are cut at 1, and the next scalings give what that
takes to the others. Whether this ends at the targets depends on how many tokens are to be kept, so it is done for a
series of kept shares (``SHARES``, each ``STEP`` of the one before), and the largest is taken whose shares come within
``NEAR`` of all targets after ``ROUNDS`` rounds. Where none does, since cells that the targets need are empty, cells are
kept in proportion to their raked factors without a cut. The draw hashes the id, so it is repeatable and independent of
how rows are spread.

A null id is drawn as the empty string; a null source, language or text counts as ``OTHER``, as ``OTHER`` and as no tokens.
A value that has a target but no tokens keeps none, and the others share what it leaves; if no value with tokens has a
target, nothing is kept. Without any tokens, all rows are kept with probability ``keep``. Rows of one id share a draw. An
empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .arrow import table
from .scratch import Scratch
from .words import WORD_RE

OTHER = "*"
DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 100
#: The share of all tokens to keep, if the targets allow as much.
KEEP = 0.8
#: Kept shares that are tried, each as a part of the one before, and how near every share has to come to its target.
SHARES, STEP, NEAR = 90, 0.95, 1e-3
#: The production targets, as shares of tokens.
TARGETS = {
    "source": {"src0": 0.25, "src1": 0.05, "src2": 0.05, OTHER: 0.65},
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.1, OTHER: 0.05},
    "topic": {"legal": 0.05, "data": 0.25, "prose": 0.7},
}


def topic_of(text: Column) -> Column:
    """A coarse topic by what a text mentions."""
    return F.when(text.ilike("%license%") | text.ilike("%rights reserved%"), "legal").when(text.rlike("[0-9]"), "data").otherwise("prose")


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def rake(weights: np.ndarray, targets: list[np.ndarray], kept: np.ndarray, most: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Factors by which ``weights`` (one axis a dimension) meet the marginal ``targets`` of ``kept`` tokens.

    ``kept`` and ``most``, the bound that factors are cut at, hold a number for each problem; so does the first axis of
    the result. Values without weight are left out of their targets.
    """
    sums = [weights.sum(tuple(k for k in range(weights.ndim) if k != axis)) for axis in range(weights.ndim)]
    shares = [np.where(h > 0, t, 0.0) for h, t in zip(sums, targets)]
    shares = [s / s.sum() if s.sum() else s for s in shares]
    total, one = weights.sum(), [1] * weights.ndim
    factor = np.ones((len(kept), *weights.shape)) * (kept / total).reshape(-1, *one)
    for _ in range(rounds):
        for axis, share in enumerate(shares):
            have = (weights * factor).sum(tuple(k + 1 for k in range(weights.ndim) if k != axis))
            scale = np.divide(share * kept[:, None], have, out=np.ones_like(have), where=have > 0)
            scale = scale.reshape(-1, *[n if k == axis else 1 for k, n in enumerate(weights.shape)])
            factor = np.minimum(factor * scale, most.reshape(-1, *one))
    return factor


def distance(weights: np.ndarray, targets: list[np.ndarray], kept: float, p: np.ndarray) -> float:
    """How far the kept shares are from their targets, at most."""
    far = 0.0
    for axis, target in enumerate(targets):
        others = tuple(k for k in range(weights.ndim) if k != axis)
        share = np.where(weights.sum(others) > 0, target, 0.0)
        if share.sum():
            far = max(far, float(np.abs((weights * p).sum(others) / kept - share / share.sum()).max()))
    return far


def probabilities(weights: np.ndarray, targets: list[np.ndarray], keep: float = KEEP, rounds: int = ROUNDS) -> np.ndarray:
    """Probabilities of at most 1 under which the kept weights meet the marginal ``targets``; see the module's text."""
    total = weights.sum()
    if not total:
        return np.full(weights.shape, min(keep, 1.0))
    kept = np.append(keep * total * STEP ** np.arange(SHARES), total)
    most = np.append(np.ones(SHARES), np.inf)
    p = rake(weights, targets, kept, most, rounds)
    for k in range(SHARES):
        if distance(weights, targets, kept[k], p[k]) <= NEAR:
            return p[k]
    largest = p[-1][weights > 0].max()
    return np.where(weights > 0, p[-1], 0) * (min(keep, 1 / largest) if largest else 0)


@dataclass
class Mixture:
    """Keep probabilities by cell, with the folded values of each dimension."""

    targets: dict[str, dict[str, float]]
    probability: np.ndarray

    def column(self, values: dict[str, Column]) -> Column:
        """The probability of a row whose dimensions are ``values``; every factor is a literal of the plan."""
        index, size = F.lit(0), 1
        for name, shares in reversed(self.targets.items()):
            keys = list(shares)
            folded = fold(values[name], shares)
            place = F.coalesce(*[F.when(folded == k, F.lit(i)) for i, k in enumerate(keys)])
            index, size = index + place * size, size * len(keys)
        return F.get(F.array(*[F.lit(float(p)) for p in self.probability.ravel()]), index)


def fold(value: Column, shares: dict[str, float]) -> Column:
    return F.when(value.isin(*[k for k in shares if k != OTHER]), value).otherwise(OTHER)


def with_other(targets: dict[str, dict[str, float]]) -> dict[str, dict[str, float]]:
    return {d: s if OTHER in s else {**s, OTHER: 0.0} for d, s in targets.items()}


def calibrate(docs: DataFrame, values: dict[str, Column], tokens: Column, targets: dict[str, dict[str, float]], keep: float = KEEP, rounds: int = ROUNDS) -> Mixture:
    """Counts tokens by cell and rakes them. The cells that reach the driver are bounded by ``targets``."""
    targets = with_other(targets)
    weights = np.zeros([len(s) for s in targets.values()])
    for row in docs.groupBy(*[fold(values[d], s).alias(d) for d, s in targets.items()]).agg(F.sum(tokens).alias("n")).collect():
        weights[tuple(list(s).index(row[d]) for d, s in targets.items())] = row.n or 0
    return Mixture(targets, probabilities(weights, [np.array(list(s.values())) for s in targets.values()], keep, rounds))


def draw(doc_id: Column) -> Column:
    """A number from 0 to 1 that an id always gets."""
    return F.conv(F.substr(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("double") / float(2**32)


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]], topic: Column | None = None, keep: float = KEEP) -> DataFrame:
    """The sampled rows of ``docs`` (doc_id, text, source, lang and any more). ``topic``: a column of theirs that gives it."""
    topic = topic_of(F.coalesce("text", F.lit(""))) if topic is None else topic
    values = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic}
    return docs.where(draw(F.col("doc_id")) < calibrate(docs, values, tokens_of(F.col("text")), targets, keep).column(values))


def judged(docs: DataFrame, targets: dict[str, dict[str, float]], scratch: Scratch, topic: Column | None = None, keep: float = KEEP) -> DataFrame:
    """``(doc_id, tokens, topic, keep_probability, kept)`` of every row of ``docs``; texts are read once."""
    topic = topic_of(F.coalesce("text", F.lit(""))) if topic is None else topic
    counted = scratch.cut(docs.select("doc_id", "source", "lang", topic.alias("topic"), tokens_of(F.col("text")).alias("tokens")))
    values = {d: F.col(d) for d in DIMENSIONS}
    p = calibrate(counted, values, F.col("tokens"), targets, keep).column(values)
    return counted.select("doc_id", "tokens", "topic", F.round(p, 6).alias("keep_probability"), (draw(F.col("doc_id")) < p).alias("kept"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), TARGETS, Scratch(spark))


def _oracle() -> str:
    def folded(d: str, column: str) -> str:
        return f"CASE WHEN {column} IN ({', '.join(repr(k) for k in TARGETS[d] if k != OTHER)}) THEN {column} ELSE '{OTHER}' END"

    targets = with_other(TARGETS)
    axis = "CASE i % 3 WHEN 0 THEN source WHEN 1 THEN lang ELSE topic END"
    goal = "CASE d " + " ".join(f"WHEN '{d}' THEN CASE v " + " ".join(f"WHEN '{v}' THEN {x}" for v, x in s.items()) + " END" for d, s in targets.items()) + " END"
    return f"""WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '{WORD_RE}')), 0)::BIGINT AS tokens, {folded('source', 'source')} AS source, {folded('lang', 'lang')} AS lang,
    CASE WHEN coalesce(text, '') ILIKE '%license%' OR coalesce(text, '') ILIKE '%rights reserved%' THEN 'legal' WHEN regexp_matches(coalesce(text, ''), '[0-9]') THEN 'data' ELSE 'prose' END AS topic
  FROM documents),
c AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS n FROM d GROUP BY ALL),
total AS MATERIALIZED (SELECT sum(n) AS total FROM c),
h AS (SELECT 'source' AS d, source AS v, sum(n) AS h FROM c GROUP BY ALL UNION ALL SELECT 'lang', lang, sum(n) FROM c GROUP BY ALL UNION ALL SELECT 'topic', topic, sum(n) FROM c GROUP BY ALL),
g AS MATERIALIZED (SELECT d, v, coalesce(s / nullif(sum(s) OVER (PARTITION BY d), 0), 0) AS share FROM (SELECT d, v, CASE WHEN h > 0 THEN {goal} ELSE 0 END AS s FROM h)),
cells AS MATERIALIZED (
  SELECT source, lang, topic, n, gs.share AS s0, gl.share AS s1, gt.share AS s2 FROM c
  JOIN g gs ON gs.d = 'source' AND gs.v = source JOIN g gl ON gl.d = 'lang' AND gl.v = lang JOIN g gt ON gt.d = 'topic' AND gt.v = topic),
problems AS MATERIALIZED (
  SELECT j, CASE WHEN j < {SHARES} THEN {KEEP} * total * pow({STEP}, j) ELSE total END AS kept, CASE WHEN j < {SHARES} THEN 1 ELSE 1e300 END AS most
  FROM range({SHARES + 1}) t(j), total WHERE total > 0),
r(i, j, kept, most, source, lang, topic, n, s0, s1, s2, p) AS (
  SELECT 0, j, kept, most, source, lang, topic, n, s0, s1, s2, kept / total FROM problems, cells, total
  UNION ALL
  SELECT i + 1, j, kept, most, source, lang, topic, n, s0, s1, s2,
    least(p * coalesce(CASE i % 3 WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END * kept / nullif(sum(n * p) OVER (PARTITION BY j, {axis}), 0), 1), most)
  FROM r WHERE i < {3 * ROUNDS}),
f AS MATERIALIZED (SELECT * FROM r WHERE i = {3 * ROUNDS}),
e AS (
  SELECT j, abs(sum(n * p) / any_value(kept) - any_value(s0)) AS e FROM f GROUP BY j, source UNION ALL
  SELECT j, abs(sum(n * p) / any_value(kept) - any_value(s1)) FROM f GROUP BY j, lang UNION ALL
  SELECT j, abs(sum(n * p) / any_value(kept) - any_value(s2)) FROM f GROUP BY j, topic),
best AS (SELECT coalesce(min(j), {SHARES}) AS best FROM (SELECT j FROM e WHERE j < {SHARES} GROUP BY j HAVING max(e) <= {NEAR})),
o AS MATERIALIZED (
  SELECT source, lang, topic, CASE WHEN best < {SHARES} THEN p WHEN n > 0 THEN p * least({KEEP}, 1 / (SELECT max(p) FROM f WHERE j = {SHARES} AND n > 0)) ELSE 0 END AS p
  FROM f, best WHERE j = best)
SELECT doc_id, tokens, topic, round(coalesce(p, {KEEP}), 6) AS keep_probability,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < coalesce(p, {KEEP}) AS kept
FROM d LEFT JOIN o USING (source, lang, topic)"""


QUERIES = {"op7_mixing": op7_mixing}
ORACLE = {"op7_mixing": _oracle()}
