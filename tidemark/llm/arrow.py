"""Helpers of the operators: tables, free column names, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..workers import prepare as prepare, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hashed_sample(rows: DataFrame, key: str, size: int, total: int) -> DataFrame:
    """The ``size`` rows of ``total`` whose key has the smallest hash.

    A threshold on the hash leaves about that many rows before they are ordered, so no task sends more than its share.
    """
    space = 1 << 40
    at = F.pmod(F.xxhash64(key), F.lit(space))
    share = min(1.0, 1.5 * size / total + 1e-3) if total else 1.0
    return rows.where(at < int(share * space)).orderBy(at, key).limit(size)
