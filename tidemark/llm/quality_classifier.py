"""Operator 1, quality classifier: histogram gradient-boosted trees over document statistics.

Every document becomes a vector of statistics of its text. Features are binned by quantiles, trees grow level by level
from histograms of gradients, and the fitted trees are flattened into arrays (feature, threshold, children, value) that
score a batch of documents with one numpy traversal for all trees at once.

Trees are fitted on the driver from a bounded sample of labelled documents (``max_labelled``, those with the smallest
hash of doc_id); scores cover every document. Null and empty texts have the statistics of no words and are scored like
any other. Labels that are null are left out; several labels or rows of one id count once, by their largest. Without
labels, or with labels of one kind, all scores are that kind's share (0.5 without any). An empty table gives an empty one.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .arrow import fresh, hashed_sample, prepare, table

#: Labelled documents that are fitted at most.
MAX_LABELLED = 20_000
#: Scores from here on count as label 1.
KEEP_FROM = 0.3
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "symbols", "shouts", "bars", "stops", "non_ascii", "spaces", "lines",
    "distinct_words", "top_word", "repetition", "repeated_lines", "stutter", "longest_word", "entropy", "capital_words", "line_words", "letters",
)


def statistics(text: str | None) -> list[float]:
    """The features of a whole text, in the order of ``FEATURES``."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    seen, size = np.bincount(raw, minlength=256), max(len(raw), 1)
    words, lines = text.split(), [x for x in text.split("\n") if x and not x.isspace()]
    n, counts = max(len(words), 1), Counter(words)
    upper, lower, beyond = int(seen[65:91].sum()), int(seen[97:123].sum()), int(seen[128:].sum())
    share = seen[seen > 0] / size
    return [
        math.log1p(len(raw)), math.log1p(len(words)), sum(map(len, words)) / n, upper / max(upper + lower, 1), int(seen[48:58].sum()) / size,
        int(seen[SYMBOLS].sum()) / size, int(seen[33]) / n, int(seen[124]) / n, int(seen[44] + seen[46] + seen[58] + seen[59]) / n, beyond / size,
        int(seen[32] + seen[9:14].sum()) / size, len(lines) / n, len(counts) / n, max(counts.values(), default=0) / n,
        sum(c * c for c in counts.values()) / n / n, (len(lines) - len(set(lines))) / max(len(lines), 1), sum(map(operator.eq, words, words[1:])) / n,
        math.log1p(max(map(len, words), default=0)), float(-(share * np.log2(share)).sum()), sum(map(str.isupper, words)) / n,
        len(words) / max(len(lines), 1), (upper + lower + beyond) / size,
    ]


@dataclass
class Trees:
    """Fitted trees, one row each of flat node arrays; a leaf leads to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of ``x``; every level steps all rows through all trees."""
        if not self.feature.size or not len(x):
            return np.full(len(x), 1 / (1 + math.exp(-self.start)))
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int32)
        for _ in range(self.depth):
            right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = np.where(right, self.right[trees, node], self.left[trees, node])
        return 1 / (1 + np.exp(-(self.start + self.value[trees, node].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 5, bins: int = 64, rate: float = 0.1, least: float = 5.0, shrink: float = 1.0) -> Trees:
    """Boosts ``trees`` trees of ``depth`` levels on log loss. ``least``: hessian that a child needs."""
    none = np.zeros((0, 1))
    share = y.mean() if len(y) else 0.5
    if share in (0, 1) or len(y) < 2:
        return Trees(none, none, none, none, none, 40.0 * (2 * share - 1), depth)
    n, width = x.shape
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f]) for f in range(width)], 1)  # bin b: cuts[b - 1] < x <= cuts[b]
    flat = binned + np.arange(width) * bins
    nodes = 2 ** (depth + 1) - 1
    feature, threshold, value = np.zeros((trees, nodes), np.int32), np.full((trees, nodes), np.inf), np.zeros((trees, nodes))
    left = np.tile(np.arange(nodes, dtype=np.int32), (trees, 1))
    right = left.copy()
    logit = start = math.log(share / (1 - share))
    logit = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - y, p * (1 - p)
        node, live = np.zeros(n, np.int64), np.ones(n, bool)
        for level in range(depth):
            first, m = 2**level - 1, 2**level
            at = np.flatnonzero(live)
            key = ((node[at] - first)[:, None] * (width * bins) + flat[at]).ravel()
            hist = [np.bincount(key, np.repeat(w[at], width), m * width * bins).reshape(m, width, bins).cumsum(2) for w in (g, h)]
            gl, hl = hist
            ga, ha = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + shrink) + (ga - gl) ** 2 / (ha - hl + shrink) - ga**2 / (ha + shrink)
            gain[(hl < least) | (ha - hl < least)] = -1
            best = gain.reshape(m, -1).argmax(1)
            for k in np.flatnonzero(gain.reshape(m, -1).max(1) > 1e-6):
                f, b = divmod(int(best[k]), bins)
                if b < len(cuts[f]):
                    i = first + k
                    feature[t, i], threshold[t, i], left[t, i], right[t, i] = f, cuts[f][b], 2 * i + 1, 2 * i + 2
            split = threshold[t, node] < np.inf
            live &= split
            goes = x[np.arange(n), feature[t, node]] > threshold[t, node]
            node = np.where(live, np.where(goes, right[t, node], left[t, node]), node)
        gs, hs = np.bincount(node, g, nodes), np.bincount(node, h, nodes)
        value[t] = -rate * gs / (hs + shrink)
        logit += value[t, node]
    return Trees(feature, threshold, left, right, value, start, depth)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _statistics(texts: pd.Series) -> pd.Series:
    return texts.map(statistics)


def scorer(model: Trees):
    """A column function from text to the probability of label 1."""

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts]).reshape(len(texts), len(FEATURES))))

    return score


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> Trees:
    """Trees from at most ``max_labelled`` labelled documents. At most that many vectors reach the driver."""
    prepare(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    sample = hashed_sample(known, "_id", max_labelled, known.count())
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(sample), "_id")  # bounded by max_labelled
    rows = found.select("_id", "_y", _statistics("_t").alias("_x")).groupBy("_id").agg(F.max("_y").alias("y"), F.max("_x").alias("x")).toPandas().sort_values("_id")
    return fit(np.array(rows["x"].tolist()).reshape(len(rows), len(FEATURES)), rows["y"].to_numpy(float))


def score_documents(docs: DataFrame, model: Trees, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a score more, under a name like ``out_col`` that is free; every column and row stays."""
    prepare(docs.sparkSession)
    return docs.withColumn(fresh(docs, out_col), scorer(model)(F.col(text_col)))


def production_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Trees:
    return learn(docs, table(spark, sf_dir, "labels").where(~is_held_out(F.col("doc_id"))))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, production_model(spark, docs, sf_dir))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))


QUERIES = {"op1_quality_classifier": op1_quality_classifier}
ORACLE: dict[str, str] = {}
