"""Terms of a text: lower-cased, split at separators, too short ones dropped, long ones cut."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: The characters between terms.
SEPARATORS = " \r\n\t!()-[]{};:`'\"\\,<>./?@#$%^&*_~"
SPLIT = "[" + re.escape(SEPARATORS).replace('"', '\\"') + "]+"
MIN_TERM, MAX_TERM = 4, 8


def _check(shortest: int, longest: int) -> None:
    if shortest < 1 or shortest > longest:
        raise ValueError("term lengths: 1 <= min <= max")


def terms(text: Column, shortest: int = MIN_TERM, longest: int = MAX_TERM) -> Column:
    """The terms of a text in order, repeats included; lengths count characters."""
    _check(shortest, longest)
    parts = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda x: F.char_length(x) >= shortest)
    return F.transform(parts, lambda x: F.substring(x, 1, longest))


def distinct_terms(text: Column, shortest: int = MIN_TERM, longest: int = MAX_TERM) -> Column:
    return F.array_distinct(terms(text, shortest, longest))


def query_terms(text: str, shortest: int = MIN_TERM, longest: int = MAX_TERM) -> list[str]:
    """The same for one text, on the driver."""
    _check(shortest, longest)
    return [x[:longest] for x in re.split(SPLIT, text.lower()) if len(x) >= shortest]


def sure_terms(text: str, shortest: int = MIN_TERM, longest: int = MAX_TERM) -> list[str]:
    """Of the terms of a literal, those that begin a term of every text that holds it: all but one that it begins amid."""
    _check(shortest, longest)
    first, *rest = re.split(SPLIT, text.lower())
    return [x[:longest] for x in rest if len(x) >= shortest]
