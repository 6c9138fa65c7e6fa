"""A query tree as one boolean column over the message body."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ..qlang.ast import Expr, Literal, Node
from .regex import finds


def balanced(join: Callable[[Column, Column], Column], parts: list[Column], none: bool) -> Column:
    """All parts joined as a tree of the least depth: thousands of operands must not nest as deep. ``none``: of no parts."""
    while len(parts) > 1:
        parts = [join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else F.lit(none)


def matches(node: Node, body: Column) -> Column:
    """True where the body matches. Literals match anywhere, in any letter case; a null body is empty."""
    body = F.coalesce(body, F.lit(""))
    folded = F.lower(body)

    def of(n: Node) -> Column:
        if isinstance(n, Literal):
            return F.contains(folded, F.lower(F.lit(n.text)))
        if not isinstance(n, Expr):
            return finds(body, n.pattern, n.case_sensitive)
        parts = [of(x) for x in n.operands]
        if n.op == "AND":
            return balanced(lambda a, b: a & b, parts, True)
        either = balanced(lambda a, b: a | b, parts, False)
        return either if n.op == "OR" else ~either

    return of(node)
