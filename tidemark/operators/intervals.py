"""Algebra of half-open ranges, as expressions over structs and arrays of structs and as operations on tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def location(pos_from: Column, pos_to: Column) -> Column:
    return F.struct(pos_from.cast("long").alias("pos_from"), pos_to.cast("long").alias("pos_to"))


def checked_location(pos_from: Column, pos_to: Column) -> Column:
    """A range; the job fails where it would end before it begins."""
    bad = F.raise_error(F.lit("a range ends before it begins"))
    return F.when(pos_to >= pos_from, location(pos_from, pos_to)).otherwise(bad.cast("struct<pos_from:bigint,pos_to:bigint>"))


def length(a: Column) -> Column:
    return a["pos_to"] - a["pos_from"]


def contains(a: Column, pos: Column) -> Column:
    return (a["pos_from"] <= pos) & (pos < a["pos_to"])


def intersects(a: Column, b: Column) -> Column:
    """Ranges that only touch count."""
    return (a["pos_from"] <= b["pos_to"]) & (a["pos_to"] >= b["pos_from"])


def overlaps(a: Column, b: Column) -> Column:
    """Ranges that share a position."""
    return (a["pos_from"] < b["pos_to"]) & (a["pos_to"] > b["pos_from"])


def split(a: Column, longest: int) -> Column:
    """The range in pieces of ``longest`` positions; the last may be shorter."""
    cuts = F.when(length(a) > 0, F.sequence(a["pos_from"], a["pos_to"] - 1, F.lit(longest).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(cuts, lambda x: location(x, F.least(x + longest, a["pos_to"])))


def remove(a: Column, b: Column) -> Column:
    """What of ``a`` is outside ``b``: no, one or two ranges, none of them empty."""
    parts = F.array(location(a["pos_from"], F.least(a["pos_to"], b["pos_from"])), location(F.greatest(a["pos_from"], b["pos_to"]), a["pos_to"]))
    return F.when(length(b) == 0, F.filter(F.array(location(a["pos_from"], a["pos_to"])), lambda x: length(x) > 0)).otherwise(F.filter(parts, lambda x: length(x) > 0))


def remove_all(a: Column, others: Column) -> Column:
    start = F.filter(F.array(location(a["pos_from"], a["pos_to"])), lambda x: length(x) > 0)
    return F.aggregate(others, start, lambda acc, b: F.flatten(F.transform(acc, lambda x: remove(x, b))))


def merge(ranges: Column) -> Column:
    """Overlapping and touching ranges as one, in order. For arrays of a few dozen: each step copies what it has; ``merge_rows``
    takes any number."""
    none = F.array().cast("array<struct<pos_from:bigint,pos_to:bigint>>")

    def add(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(location(last["pos_from"], F.greatest(last["pos_to"], x["pos_to"]))))
        return F.when((F.size(acc) > 0) & (last["pos_to"] >= x["pos_from"]), joined).otherwise(F.concat(acc, F.array(location(x["pos_from"], x["pos_to"]))))

    return F.aggregate(F.sort_array(ranges), none, add)


def exclude(a: Column, others: Column) -> Column:
    return merge(remove_all(a, others))


def pick_next(ranges: Column, pos: Column, longest: int) -> Column:
    """From ``pos`` on, at most ``longest`` of the first range that contains it; an empty range at 0 if none does."""
    found = F.get(F.filter(ranges, lambda x: contains(x, pos)), F.lit(0))
    return F.when(found.isNotNull(), location(pos, F.least(pos + longest, found["pos_to"]))).otherwise(location(F.lit(0), F.lit(0)))


def merge_rows(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """``merge`` of a table's rows (keys, pos_from, pos_to) by key: one sort, no arrays."""
    w = Window.partitionBy(*keys).orderBy("pos_from", "pos_to")
    before = F.max("pos_to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = ranges.withColumn("_new", F.when(F.col("pos_from") <= before, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w))
    return islands.groupBy(*keys, "_island").agg(F.min("pos_from").alias("pos_from"), F.max("pos_to").alias("pos_to")).drop("_island")


def difference_rows(whole: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """What of each key's one range in ``whole`` no row of ``others`` covers: the gaps between merged neighbours."""
    w = Window.partitionBy(*keys).orderBy("o_from")
    merged = merge_rows(others, keys).withColumnsRenamed({"pos_from": "o_from", "pos_to": "o_to"})
    near = whole.join(merged, [*map(lambda k: whole[k] == merged[k], keys), whole.pos_from < merged.o_to, whole.pos_to > merged.o_from], "left").select(whole["*"], "o_from", "o_to")
    before = F.coalesce(F.lag("o_to").over(w), F.col("pos_from"))
    gaps = near.select(
        *keys,
        F.array(
            location(before, F.coalesce("o_from", "pos_to")),
            F.when(F.lead("o_from").over(w).isNull() & F.col("o_to").isNotNull(), location(F.col("o_to"), F.col("pos_to"))),
        ).alias("g"),
    )
    return gaps.select(*keys, F.explode("g").alias("g")).where("g IS NOT NULL AND g.pos_to > g.pos_from").select(*keys, "g.pos_from", "g.pos_to")


#: Positions of one bin: ranges meet rows by key and bin, so a key with many of both is many small joins.
BIN = 1 << 22


def _binned(ranges: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Merged ranges, each once for every bin that it has a part in."""
    every = merge_rows(ranges.where("pos_to > pos_from"), keys)
    bins = F.explode(F.sequence(F.floor(F.col("pos_from") / width), F.floor((F.col("pos_to") - 1) / width)))
    return every.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("pos_from").alias("_from"), F.col("pos_to").alias("_to"), bins.alias("_bin"))


def within(rows: DataFrame, ranges: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """The rows whose ``pos_from`` lies in a range of their key. Ranges are merged before, so a row meets few of its bin."""
    r = _binned(ranges, keys, width)
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.floor(F.col("pos_from") / width) == F.col("_bin"), F.col("pos_from") >= F.col("_from"), F.col("pos_from") < F.col("_to")]
    return rows.join(r, reduce(lambda a, b: a & b, on), "left_semi")


def touched(rows: DataFrame, ranges: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """The rows that share a position with a range of their key, each once: it is looked for in each bin that it is in."""
    r = _binned(ranges, keys, width)
    bins = F.explode(F.sequence(F.floor(F.col("pos_from") / width), F.floor((F.col("pos_to") - 1) / width)))
    spread = rows.where("pos_to > pos_from").withColumn("_row", F.monotonically_increasing_id()).withColumn("_own", bins)
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_own") == F.col("_bin"), F.col("pos_from") < F.col("_to"), F.col("pos_to") > F.col("_from")]
    return spread.join(r, reduce(lambda a, b: a & b, on), "left_semi").dropDuplicates(["_row"]).drop("_row", "_own")
