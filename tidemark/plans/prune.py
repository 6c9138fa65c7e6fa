"""Which segments may hold a match: a query tree over the terms that segments are indexed by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..qlang.ast import Expr, Literal, Node, keywords
from .match import balanced

Tokenize = Callable[[str], list[str]]


def full_scan(node: Node, tokenize: Tokenize) -> bool:
    """Whether the index cannot rule out any segment."""
    if isinstance(node, Literal):
        return not tokenize(node.text)
    if not isinstance(node, Expr) or node.op == "NOT":
        return True
    if not node.operands:
        return False
    every = [full_scan(x, tokenize) for x in node.operands]
    return all(every) if node.op == "AND" else any(every)


def prefixes(node: Node, tokenize: Tokenize) -> list[str]:
    """The distinct terms of all literals, in order."""
    return sorted({t for k in keywords(node) for t in tokenize(k)})


def may_match(node: Node, tokenize: Tokenize, flag: Callable[[str], Column]) -> Column:
    """Over flags of which terms a segment has: false only if no message there can match."""
    if isinstance(node, Literal):
        return balanced(lambda a, b: a & b, [flag(t) for t in tokenize(node.text)], True)
    if not isinstance(node, Expr) or node.op == "NOT":
        return F.lit(True)
    parts = [may_match(x, tokenize, flag) for x in node.operands]
    if node.op == "AND":
        return balanced(lambda a, b: a & b, parts, True)
    return balanced(lambda a, b: a | b, parts, False)


def candidates(postings: DataFrame, node: Node, tokenize: Tokenize) -> DataFrame | None:
    """``segment_id`` of the segments that may match; None if that is all of them.

    One pass over the postings whose term begins with one of the query's terms, a filter that reaches the scan; each
    segment becomes one row of flags, combined before the shuffle.
    """
    if full_scan(node, tokenize):
        return None
    found = prefixes(node, tokenize)
    if not found:
        return postings.select("segment_id").limit(0)
    wanted = balanced(lambda a, b: a | b, [F.col("term").startswith(p) for p in found], False)
    flags = [F.bool_or(F.col("term").startswith(p)).alias(f"k{i}") for i, p in enumerate(found)]
    place = {p: f"k{i}" for i, p in enumerate(found)}
    return postings.where(wanted).groupBy("segment_id").agg(*flags).where(may_match(node, tokenize, lambda t: F.col(place[t]))).select("segment_id")
