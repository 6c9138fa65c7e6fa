"""Connected components of an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch


def _ordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")


def connected_components(edges: DataFrame, src: str, dst: str, scratch: Scratch) -> DataFrame:
    """``(node, component)`` for every node of an edge; ``component`` is the smallest node that can be reached.

    Each round hooks every node to its smallest neighbour (a ``min`` that combines before the shuffle), flattens the
    hooks by pointer jumping and contracts the edges, so that the edge table shrinks geometrically; a chain costs
    log2(length) jumps. No neighbour list is ever built, so a hub needs no more memory than any other node. Nothing
    but one row count a step reaches the driver.

    Null ends and self loops add nothing; an empty table gives an empty result.
    """
    e = scratch.cut(edges.select(*_ordered(F.col(src), F.col(dst))).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("hi") != F.col("lo"))).distinct())
    labels = None
    while not e.isEmpty():
        hooks = scratch.cut(e.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("p")))
        while True:
            q = hooks.select(F.col("node").alias("q"), F.col("p").alias("pp"))
            jumped = scratch.cut(hooks.join(q, F.col("p") == F.col("q"), "left").select("node", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
            scratch.drop(hooks)
            moved = not jumped.where("moved").isEmpty()
            hooks = jumped
            if not moved:
                break
        flat = hooks.select("node", "p")
        a, b = flat.toDF("an", "ap"), flat.toDF("bn", "bp")
        nxt = e.join(a, F.col("hi") == F.col("an")).join(b, F.col("lo") == F.col("bn"), "left")
        nxt = scratch.cut(nxt.select(*_ordered(F.col("ap"), F.coalesce("bp", "lo"))).where("hi != lo").distinct())
        if labels is None:
            merged = flat.unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("p")).join(flat, "node", "left_anti").distinct())
        else:
            merged = labels.join(a, F.col("p") == F.col("an"), "left").select("node", F.coalesce("ap", "p").alias("p"))
        merged = scratch.cut(merged)
        scratch.drop(labels, e, hooks)
        labels, e = merged, nxt
    if labels is None:
        return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return labels.select("node", F.col("p").alias("component"))
