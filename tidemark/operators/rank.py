"""Places in an order of a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..workers import own_dir


def ranked(rows: DataFrame, order: list[str | Column], name: str = "nth") -> DataFrame:
    """``rows`` with their place, from 1, in this order; ties are placed in any order.

    Sorted by ranges and written once, so that parts do not change between the two looks at them; then each part is
    numbered for itself, and adds the rows of those before it: one number a part is all that tasks share.
    """
    spark = rows.sparkSession
    path = own_dir(spark, "rank")
    rows.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias("_at")).write.parquet(path)
    placed = spark.read.parquet(path)
    before, total = [], 0
    for r in placed.groupBy("_part").count().orderBy("_part").collect():  # a row a partition of the sort
        before.append((r["_part"], total))
        total += r["count"]
    offsets = F.broadcast(spark.createDataFrame(before, "_part int, _before long"))
    return placed.join(offsets, "_part").select(*[f"`{c}`" for c in rows.columns], (F.col("_at") + F.col("_before") + 1).alias(name))
