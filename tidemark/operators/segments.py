"""Segments: runs of neighbouring messages of one file, the unit that the index points at."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..workers import prepare
from .intervals import location
from .rank import ranked

SEGMENT_LENGTH = 5_000_000


def assign_segments(layouts: DataFrame, segment_length: int = SEGMENT_LENGTH, file_col: str = "file") -> DataFrame:
    """``layouts`` (file, pos_from, pos_to and any more) with ``segment_no``, from 0 in each file.

    A segment ends once its messages reach ``segment_length``, or where the next message does not begin at its end. The
    running length starts anew at each segment, so rows are walked in order of file and position; a task holds one batch
    and a few numbers, however long a file is. Give it positions alone: rows meet by file.
    """
    prepare(layouts.sparkSession)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, filled, end, number = None, 0, None, 0
        for pdf in batches:
            numbers = np.zeros(len(pdf), np.int64)
            for i, (f, a, b) in enumerate(zip(pdf[file_col].tolist(), pdf["pos_from"].tolist(), pdf["pos_to"].tolist())):
                if f != file:
                    file, filled, number = f, 0, 0
                elif filled >= segment_length or a != end:
                    filled, number = 0, number + 1
                filled, end = filled + b - a, b
                numbers[i] = number
            yield pdf.assign(segment_no=numbers)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in layouts.schema.fields) + ", segment_no long"
    return layouts.repartition(file_col).sortWithinPartitions(file_col, "pos_from").mapInPandas(walk, schema)


def segment_bounds(messages: DataFrame, *more: Column) -> DataFrame:
    """A row a segment: where it begins and ends, its true first and last date, its messages, and ``more`` aggregates."""
    return messages.groupBy("file", "segment_id").agg(
        F.min("pos_from").alias("pos_from"), F.max("pos_to").alias("pos_to"), F.min("date").alias("date_min"), F.max("date").alias("date_max"), F.count("*").alias("messages"), *more
    )


def ranges_by_file(segments: DataFrame) -> DataFrame:
    """``(file, ranges)``: the ranges of each file's segments, in order."""
    return segments.groupBy("file").agg(F.sort_array(F.collect_list(location(F.col("pos_from"), F.col("pos_to")))).alias("ranges"))


def near_even(rows: DataFrame, order: list[str], chunks: int, number: str = "chunk") -> DataFrame:
    """``rows`` with the number, from 1, of the one of ``chunks`` that they are in: runs in this order that differ by one row at most."""
    n, places = rows.count(), ranked(rows, order, "_nth")
    long, size = n % chunks, n // chunks
    nth = F.col("_nth") - 1
    at = F.when(nth < long * (size + 1), F.floor(nth / (size + 1))).otherwise(long + F.floor((nth - long * (size + 1)) / max(size, 1)))
    return places.withColumn(number, at.cast("long") + 1).drop("_nth")


def misaligned_files(segments: DataFrame, layouts: DataFrame) -> DataFrame:
    """Files of which a segment begins or ends where no message does any more."""
    starts = segments.join(layouts.select("file", "pos_from"), ["file", "pos_from"], "left_anti")
    ends = segments.join(layouts.select("file", "pos_to"), ["file", "pos_to"], "left_anti")
    return starts.select("file").unionByName(ends.select("file")).distinct()


def incomplete_trailing(segments: DataFrame, files: DataFrame, segment_length: int = SEGMENT_LENGTH) -> DataFrame:
    """``(file, segment_id)`` of last segments that are short although their file goes on."""
    last = segments.groupBy("file").agg(F.max_by(F.struct("segment_id", "pos_from", "pos_to"), "pos_to").alias("s"))
    short = last.join(files.select("file", "size"), "file").where((F.col("s.pos_to") - F.col("s.pos_from") < segment_length) & (F.col("s.pos_to") < F.col("size")))
    return short.select("file", "s.segment_id")
