"""Search: prune segments by the index, then match every message that is left."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import bound
from ..functions.tokenize import MAX_TERM, MIN_TERM, query_terms
from ..plans.match import balanced, matches
from ..plans.prune import candidates
from ..qlang.ast import Node
from ..qlang.parser import QuerySyntaxError, parse

ORDER = ("date", "file", "pos_from")
#: Segments that are looked up by their ids in the scan at most; and ranges of ids that these become there.
LISTED, RANGES = 4096, 8


def check_query(query: str, date_from: str | datetime | None = None, date_to: str | datetime | None = None) -> tuple[Node, datetime | None, datetime | None]:
    """The tree and bounds of a user's query; ``ValueError`` says what is wrong with it."""
    if not query.strip():
        raise QuerySyntaxError("The query is empty")
    lo, hi = bound(date_from), bound(date_to)
    if lo and hi and lo > hi:
        raise ValueError("the first date is after the last")
    return parse(query), lo, hi


def date_range(messages: DataFrame, lo: datetime | None, hi: datetime | None) -> DataFrame:
    """Messages from ``lo`` to ``hi``, both included. The bounds take the column's type, so they reach the scan."""
    kind = messages.schema["date"].dataType.simpleString()
    for value, keep in ((lo, lambda c, b: c >= b), (hi, lambda c, b: c <= b)):
        if value is not None:
            micros = int(value.timestamp()) * 1_000_000 + value.microsecond
            at = F.timestamp_micros(F.lit(micros)) if kind == "timestamp" else F.expr(f"timestampadd(MICROSECOND, {micros}L, TIMESTAMP_NTZ'1970-01-01')")
            messages = messages.where(keep(F.col("date"), at))
    return messages


def of_segments(messages: DataFrame, segments: DataFrame) -> DataFrame:
    """The messages of some segments.

    The ids of a few thousand are looked up now. Those of one ingest rise with the bytes of its files, so the ranges that
    they lie in tell the scan which pages to skip, if that is most of them. More ids meet the messages in a join.
    """
    ids = sorted(r.segment_id for r in segments.limit(LISTED + 1).collect())
    if len(ids) > LISTED:
        return messages.join(segments, "segment_id", "left_semi").select(*messages.columns)
    if not ids:
        return messages.limit(0)
    gaps = sorted(range(1, len(ids)), key=lambda k: ids[k - 1] - ids[k])[: RANGES - 1]
    cuts = [0, *sorted(gaps), len(ids)]
    runs = [(ids[a], ids[b - 1]) for a, b in zip(cuts, cuts[1:])]
    if len(ids) <= RANGES or 2 * sum(hi - lo for lo, hi in runs) < ids[-1] - ids[0]:
        messages = messages.where(balanced(lambda a, b: a | b, [F.col("segment_id").between(lo, hi) for lo, hi in runs], False))
    return messages.where(F.col("segment_id").isin(ids))


def search(
    messages: DataFrame,
    query: str | Node,
    date_from: str | datetime | None = None,
    date_to: str | datetime | None = None,
    index: DataFrame | None = None,
    segments: DataFrame | None = None,
    shortest: int = MIN_TERM,
    longest: int = MAX_TERM,
    sort: bool = True,
) -> DataFrame:
    """The messages (file, pos_from, date, body and any more) that match, by date, file and position.

    With an ``index`` (term, segment_id) only messages of segments that may match are read; literals are then found at
    the beginning of terms, wherever else the same segment holds the term. Without, literals are found anywhere.
    ``segments``: the ids of those that may match, found before.
    """
    if isinstance(query, str):
        node, lo, hi = check_query(query, date_from, date_to)
    else:
        node, lo, hi = query, bound(date_from), bound(date_to)
    found = date_range(messages, lo, hi)
    if index is not None:
        segments = candidates(index, node, lambda t: query_terms(t, shortest, longest))
    if segments is not None:
        found = of_segments(found, segments)
    found = found.where(matches(node, F.col("body")))
    return found.orderBy(*ORDER) if sort else found


def page(found: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    """Hits ``skip`` to ``skip + limit``, by date: a top-k, not a sort of all."""
    return found.orderBy(*ORDER).offset(skip).limit(limit)


def summary(found: DataFrame) -> DataFrame:
    """One row: hits, and their first and last date."""
    return found.agg(F.count("*").alias("messages"), F.min("date").alias("date_min"), F.max("date").alias("date_max"))


def histogram(found: DataFrame, width: str = "1 hour") -> DataFrame:
    """Hits by time window."""
    return found.groupBy(F.window("date", width).alias("w")).agg(F.count("*").alias("messages")).select(F.col("w.start").alias("window_start"), "messages")
