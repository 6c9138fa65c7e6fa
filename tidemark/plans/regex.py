"""Regular expressions of the query dialect: linear time, no look-around, no back-references.

Java's engine backtracks: on a long text ``(a|b)*`` overflows its stack and ``[a-z]+x`` takes quadratic time. So only
patterns that try a bounded number of ways at each place (``cheap``) become Java patterns, within generated code; all
others run in Arrow's RE2, which needs time linear in the text for any pattern. Both find the same.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession, functions as F

from ..workers import prepare

WORD_EDGE = r"(?-i:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
NO_WORD_EDGE = r"(?-i:(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<![0-9A-Za-z_])(?![0-9A-Za-z_]))"
#: Named ASCII classes and Java's names for them.
ASCII_CLASSES = {
    "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct",
    "space": "Space", "upper": "Upper", "word": "w", "xdigit": "XDigit",
}


#: Characters that stand for word characters and nothing else, in any letter case.
PLAIN = frozenset("0123456789_ABCDEFGHIJLMNOPQRTUVWXYZabcdefghijlmnopqrtuvwxyz")


def _edge(p: str, at: int) -> str:
    """The word edge at ``p[at]``: one look at the other side where what stands on this side is a word character."""
    nxt, after = p[at + 2 : at + 3], p[at + 3 : at + 4]
    if nxt in PLAIN and nxt and after not in ("?", "*", "{"):
        return "(?-i:(?<![0-9A-Za-z_]))"
    if p[at - 1 : at] in PLAIN and at and "\\" not in p[max(0, at - 4) : at]:
        return "(?-i:(?![0-9A-Za-z_]))"
    return WORD_EDGE


class BadPattern(ValueError):
    """The pattern is not one of the dialect."""


def _named(m: re.Match) -> str:
    name = ASCII_CLASSES.get(m[2])
    if name is None:
        raise BadPattern(f"unknown class [:{m[2]}:]")
    if name == "w":
        return r"\W" if m[1] else r"\w"
    return (r"\P" if m[1] else r"\p") + "{" + name + "}"


def _class(p: str, at: int) -> tuple[str, int]:
    """The class that begins at ``p[at] == '['``, and where it ends."""
    out, i = "[", at + 1
    if p[i : i + 1] == "^":
        out, i = out + "^", i + 1
    first = True
    while i < len(p):
        c = p[i]
        if c == "]" and not first:
            return out + "]", i + 1
        if m := re.compile(r"\[:(\^?)(\w+):\]").match(p, i):
            out, i = out + _named(m), m.end()
        elif c == "\\" and i + 1 < len(p):
            e = p[i + 1]
            out, i = out + (r"\t\n\f\r " if e == "s" else p[i : i + 2]), i + 2
            if e in "pP" and p[i : i + 1] == "{":
                end = p.find("}", i) + 1
                out, i = out + p[i:end], end
            elif e == "x" and p[i : i + 1] == "{":
                end = p.find("}", i) + 1
                out, i = out + p[i:end], end
        else:
            out, i = out + ("\\" + c if c in "[&]~" else c), i + 1
        first = False
    raise BadPattern("missing ]")


def to_java(pattern: str, case_sensitive: bool) -> str:
    """The Java pattern, flags included, that finds what ``pattern`` finds."""
    out, i, p, multiline = [], 0, pattern, False
    repeated = False  # whether what came last is a repetition
    while i < len(p):
        c, again = p[i], False
        if c == "\\":
            e = p[i + 1 : i + 2]
            if not e:
                raise BadPattern("trailing backslash")
            if e in "123456789" or e in "ZkGRXhHV":
                raise BadPattern(f"\\{e} is not supported")
            if e == "Q":
                end = p.find("\\E", i)
                end = len(p) if end < 0 else end
                out.append(re.sub(r"[^\w\s]", lambda m: "\\" + m[0], p[i + 2 : end]))
                i = min(end + 2, len(p))
                repeated = False
                continue
            out.append({"b": _edge(p, i), "B": NO_WORD_EDGE, "s": r"[\t\n\f\r ]", "S": r"[^\t\n\f\r ]", "C": r"[\s\S]"}.get(e, "\\" + e))
            i += 2
            if e in "pPx" and p[i : i + 1] == "{":
                end = p.find("}", i) + 1
                out.append(p[i:end])
                i = end
        elif c == "[":
            text, i = _class(p, i)
            out.append(text)
        elif c == "(" and p[i + 1 : i + 2] == "?":
            if m := re.compile(r"\(\?P?<([A-Za-z]\w*)>").match(p, i):
                out.append(f"(?<{m[1].replace('_', '')}>")
            elif m := re.compile(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])").match(p, i):
                on, off = m[1].replace("U", ""), (m[2] or "").replace("U", "")
                multiline = multiline or "m" in on
                flags = on + ("-" + off if off else "")
                out.append(f"(?{flags}{m[3]}" if flags or m[3] == ":" else "")
            else:
                raise BadPattern("look-around is not supported")
            i = m.end()
        elif c == "$":
            out.append("$" if multiline else r"\z")
            i += 1
        elif c in "*+?" or (c == "{" and re.compile(r"\{\d+(,\d*)?\}").match(p, i)):
            if repeated and c != "?":
                raise BadPattern("a repetition of a repetition")
            end = i + 1 if c != "{" else p.index("}", i) + 1
            out.append(p[i:end])
            again, i = not (repeated and c == "?"), end
        elif c == "{":
            out.append(r"\{")
            i += 1
        elif c in "}]":
            out.append("\\" + c)
            i += 1
        else:
            out.append(c)
            i += 1
        repeated = again
    return ("(?d)" if case_sensitive else "(?iud)") + "".join(out)


#: Ways that a cheap pattern may have to match at one place.
WAYS = 64


def cheap(pattern: str) -> bool:
    """Whether the pattern repeats nothing without bound, no group at all, and leaves no more than ``WAYS`` choices."""
    ways, i, p, after = 1, 0, pattern, ""
    while i < len(p):
        c = p[i]
        if c == "\\":
            if p[i + 1 : i + 2] == "Q":
                end = p.find("\\E", i)
                i = len(p) if end < 0 else end + 2
            else:
                i += 2
                if p[i - 1 : i] in ("p", "P", "x") and p[i : i + 1] == "{":
                    i = p.find("}", i) + 1 or len(p)
            after = "atom"
            continue
        if c == "[":
            _, i = _class(p, i)
            after = "atom"
            continue
        if c == "(" and p[i + 1 : i + 2] == "?":
            i = min([k + 1 for k in (p.find(e, i) for e in ":>)") if k >= 0], default=len(p))
            after = ""
            continue
        counted = re.compile(r"\{(\d+)(,?)(\d*)\}").match(p, i) if c == "{" else None
        if c in "*+" or (counted and (after == "group" or (counted[2] and not counted[3]) or int(counted[3] or counted[1]) > 100)):
            return False
        if c in "?|":
            ways *= 2
        elif counted:
            ways *= max(1, int(counted[3] or counted[1]) - int(counted[1]) + 1)
        i = counted.end() if counted else i + 1
        after = "group" if c == ")" else "atom"
    return ways <= WAYS


def checked(pattern: str, case_sensitive: bool) -> str:
    """The Java pattern; ``BadPattern`` if it is none of the dialect, found here and not in a failing job."""
    java, spark = to_java(pattern, case_sensitive), SparkSession.getActiveSession()
    try:
        pc.match_substring_regex(pa.array([""]), pattern)
        if spark is not None:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(java)
    except Exception as e:
        raise BadPattern(f"invalid regular expression: {pattern}") from e
    return java


def finds(text: Column, pattern: str, case_sensitive: bool) -> Column:
    """Whether the pattern occurs in a text, in time linear in its length."""
    java = checked(pattern, case_sensitive)
    if cheap(pattern):
        return text.rlike(java)
    if spark := SparkSession.getActiveSession():
        prepare(spark)

    @F.arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, pattern, ignore_case=not case_sensitive)

    return found(text)
