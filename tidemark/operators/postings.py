"""The inverted index: which terms occur in which segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tokenize import MAX_TERM, MIN_TERM, distinct_terms


def postings(messages: DataFrame, body: Column | None = None, shortest: int = MIN_TERM, longest: int = MAX_TERM, keep: tuple[str, ...] = ()) -> DataFrame:
    """Distinct ``(term, segment_id)`` and ``keep``. Repeats go within a message, then before the shuffle."""
    text = F.col("body") if body is None else body
    return messages.select(F.explode(distinct_terms(text, shortest, longest)).alias("term"), "segment_id", *keep).distinct()


def compact(index: DataFrame, partitions: int) -> DataFrame:
    """The postings in few files sorted by term, so that a prefix reads few row groups."""
    return index.repartitionByRange(partitions, "term").sortWithinPartitions("term", "segment_id")


def document_frequency(messages: DataFrame, body: Column, shortest: int = MIN_TERM, longest: int = MAX_TERM) -> DataFrame:
    """In how many messages each term occurs."""
    return messages.select(F.explode(distinct_terms(body, shortest, longest)).alias("term")).groupBy("term").agg(F.count("*").alias("messages"))


def prefix_lookup(index: DataFrame, prefix: str) -> DataFrame:
    return index.where(F.col("term").startswith(prefix))


def without_segments(index: DataFrame, removed: DataFrame) -> DataFrame:
    return index.join(removed.select("segment_id").distinct(), "segment_id", "left_anti")
