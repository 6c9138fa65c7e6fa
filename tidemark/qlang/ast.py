"""Query trees: literals, regular expressions and n-ary AND, OR and NOT."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass


@dataclass(frozen=True)
class Literal:
    text: str

    def __str__(self) -> str:
        return self.text


@dataclass(frozen=True)
class Regex:
    pattern: str
    case_sensitive: bool = False

    def __str__(self) -> str:
        return ("@" if self.case_sensitive else "~") + self.pattern


@dataclass(frozen=True)
class Expr:
    """``op`` is AND, OR or NOT; NOT holds if none of its operands does."""

    op: str
    operands: tuple[Node, ...] = ()

    def __str__(self) -> str:
        return f"{self.op}({','.join(map(str, self.operands))})"


Node = Literal | Regex | Expr


def visit(node: Node) -> Iterator[Node]:
    """All nodes, operands before what holds them."""
    if isinstance(node, Expr):
        for x in node.operands:
            yield from visit(x)
    yield node


def map_leaves(node: Node, f: Callable[[Literal | Regex], Node]) -> Node:
    return Expr(node.op, tuple(map_leaves(x, f) for x in node.operands)) if isinstance(node, Expr) else f(node)


def keywords(node: Node) -> list[str]:
    """The texts of all literals, also those under NOT."""
    return [n.text for n in visit(node) if isinstance(n, Literal)]


def ordered(node: Node) -> Node:
    """The same tree with operands in a fixed order."""
    if not isinstance(node, Expr):
        return node
    return Expr(node.op, tuple(sorted(map(ordered, node.operands), key=lambda x: (type(x).__name__, str(x)))))


def digest(node: Node) -> str:
    """Equal for trees that differ in the order of operands alone."""

    def tagged(n: Node) -> str:
        if isinstance(n, Expr):
            return f"{n.op}[{' '.join(map(tagged, n.operands))}]"
        kind = "literal" if isinstance(n, Literal) else "cs" if n.case_sensitive else "ci"
        text = str(n) if isinstance(n, Literal) else n.pattern
        return f"{kind}{len(text)}:{text}"

    return hashlib.sha256(tagged(ordered(node)).encode()).hexdigest()


def simplify(node: Node) -> Node:
    """Lifts operands of AND in AND and OR in OR, and unwraps an AND of one expression. Keeps double negation."""
    if not isinstance(node, Expr):
        return node
    flat: list[Node] = []
    for x in map(simplify, node.operands):
        same = isinstance(x, Expr) and x.op == node.op and node.op != "NOT"
        single = isinstance(x, Expr) and x.op == "AND" and len(x.operands) == 1
        flat += x.operands if same or single else [x]
    if node.op == "AND" and len(flat) == 1 and isinstance(flat[0], Expr):
        return flat[0]
    return Expr(node.op, tuple(flat))
