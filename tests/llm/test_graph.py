import random

import pytest

from tidemark.llm.graph import connected_components
from tidemark.llm.scratch import Scratch


def brute(edges):
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        out[start] = min(seen)
    return out


rng = random.Random(1)
CASES = {
    "empty": [],
    "loops and nulls": [(1, 1), (None, 2), (3, None)],
    "chain": [(i, i + 1) for i in range(64)],
    "shuffled chain": (lambda p: list(zip(p, p[1:])))(rng.sample(range(80), 80)),
    "star, twice": [(0, i) for i in range(1, 50)] * 2,
    "hub is largest": [(99, i) for i in range(50)],
    "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(120)],
}


@pytest.mark.parametrize("name", CASES)
def test_components(spark, name):
    edges = spark.createDataFrame(CASES[name], "a long, b long")
    rows = connected_components(edges, "a", "b", Scratch(spark)).collect()
    assert {r.node: r.component for r in rows} == brute(CASES[name]) and len(rows) == len(brute(CASES[name]))
