"""Dates: layouts written as a reference time, microseconds since the epoch, bounds of a search."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column, functions as F

#: Parts of the reference time 2006-01-02 15:04:05 -07:00 and Spark's letters for them, longest first.
LAYOUT_PARTS = [
    ("January", "MMMM"), ("Monday", "EEEE"), ("-07:00", "xxx"), ("Z07:00", "XXX"), ("-0700", "xx"), ("Z0700", "XX"), ("2006", "yyyy"), ("Jan", "MMM"), ("Mon", "EEE"), ("MST", "z"),
    ("01", "MM"), ("02", "dd"), ("15", "HH"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("06", "yy"), ("PM", "a"), ("_2", "d"), ("1", "M"), ("2", "d"), ("3", "h"), ("4", "m"), ("5", "s"),
]
_PART = re.compile(r"[.,](?:0+|9+)(?!\d)|" + "|".join(re.escape(k) for k, _ in LAYOUT_PARTS))
_LETTERS = dict(LAYOUT_PARTS)


def spark_pattern(layout: str) -> str:
    """Spark's date pattern for a layout; letters that are no part of the reference time are quoted."""
    out, at = [], 0

    def text(s: str) -> str:
        return re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", s.replace("'", "''"))

    for m in _PART.finditer(layout):
        out.append(text(layout[at : m.start()]))
        found = m[0]
        if found[0] in ".,":
            out.append(found[0] + "S" * (len(found) - 1) if found[1] == "0" else f"[{found[0]}{'S' * (len(found) - 1)}]")
        else:
            out.append(_LETTERS[found])
        at = m.end()
    return "".join([*out, text(layout[at:])])


def parse_date(text: Column, layout: str) -> Column:
    """The time that a text gives, or null. As many digits of a second as the text has are taken, up to six."""
    pattern = spark_pattern(layout)
    exact = F.try_to_timestamp(text, F.lit(pattern))
    if "S" in re.sub(r"'[^']*'", "", pattern):
        return exact
    return F.coalesce(exact, F.try_to_timestamp(text, F.lit(pattern.replace("ss", "ss[.SSSSSS][.SSS]"))))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(n: Column) -> Column:
    return F.timestamp_micros(n)


def bound(value: str | datetime | None) -> datetime | None:
    """A search bound: RFC 3339 text (an offset is needed) or a time; one without zone is UTC."""
    if value is None or value == "":
        return None
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
        if value.tzinfo is None:
            raise ValueError("a date needs its offset from UTC")
    return value if value.tzinfo else value.replace(tzinfo=timezone.utc)
