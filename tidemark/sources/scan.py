"""Messages of raw log files that only Spark's readers reach: from one match of the start pattern to the next, with byte positions.

Files that executors can open by themselves are read by ``ranges``, which needs not read a file whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.dates import parse_date
from ..workers import own_dir, prepare

#: ``part``: 0 messages, 1 those that meet others of another split, 2 the length of a split.
_FOUND = "part int, file string, block long, size long, at long, bytes long, date_at_byte int, date_bytes int, date_text string, date_at int, last boolean, body string"
_COLUMNS = [c.split()[0] for c in _FOUND.split(", ")]


class _Block:
    """Finds the messages of one split of a file, whose lines come in order, a batch at a time.

    What follows the last start seen stays here until the next start, so a message may span batches.
    """

    def __init__(self, pattern: re.Pattern, file: str, block: int, size: int):
        self.pattern, self.file, self.block, self.size = pattern, file, block, size
        self.at, self.held, self.date = 0, [], None  # where what is held begins; its bytes; its date's range in it

    def _row(self, last: bool) -> tuple:
        raw = b"".join(self.held)
        if self.date is None:  # before the first start: the rest of a message of the split before
            return 1, self.file, self.block, self.size, self.at, len(raw), -1, 0, "", 0, last, raw.decode("utf-8", "replace")
        a, b = self.date
        head, date = raw[:a].decode("utf-8", "replace"), raw[a:b].decode("utf-8", "replace")
        return int(last), self.file, self.block, self.size, self.at, len(raw), a, b - a, date, len(head), last, head + raw[b:].decode("utf-8", "replace")

    def add(self, text: bytes) -> Iterator[tuple]:
        begin = 0
        for m in self.pattern.finditer(text):
            self.held.append(text[begin : m.start()])
            size = sum(map(len, self.held))
            if size or self.date is not None:
                yield self._row(False)
            self.at, self.held, begin = self.at + size, [], m.start()
            a, b = m.span(1)
            self.date = (a - m.start(), b - m.start()) if a >= 0 else (0, 0)
        self.held.append(text[begin:])

    def end(self) -> Iterator[tuple]:
        if any(self.held):
            yield self._row(True)
        yield 2, self.file, self.block, self.size, 0, self.at + sum(map(len, self.held)), -1, 0, "", 0, True, ""


def _finder(start_re: str):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pattern, now = re.compile(start_re.encode(), re.M), None
        for pdf in batches:
            rows = []
            split = (pdf["file"] != pdf["file"].shift()) | (pdf["block"] != pdf["block"].shift())
            cuts = [*split.to_numpy().nonzero()[0].tolist(), len(pdf)]
            for a, b in zip(cuts, cuts[1:]):
                file, block, size = pdf["file"].iat[a], int(pdf["block"].iat[a]), int(pdf["size"].iat[a])
                if now is None or (now.file, now.block) != (file, block):
                    rows += now.end() if now else ()
                    now = _Block(pattern, file, block, size)
                rows += now.add(b"\n".join(map(bytes, pdf["value"].iloc[a:b])) + b"\n")
            yield pd.DataFrame(rows, columns=_COLUMNS)
        if now:
            yield pd.DataFrame(now.end(), columns=_COLUMNS)

    return find


def scan_messages(spark: SparkSession, files: list[str], start_re: str, date_layout: str | None = None, at: str | None = None) -> DataFrame:
    """``(file, pos_from, pos_to, date_from, date_to, date_text, date_at, is_tail, body, date)`` of every message.

    Group 1 of ``start_re`` is the date; ``^`` and ``$`` match at lines. A start should not span lines, as splits are cut
    between them. ``body`` lacks the date, which was at character ``date_at`` of it. What comes before a file's first
    match belongs to no message.

    Files are read in splits like any text, so their size does not matter, and messages are found where they are read, in
    one pass that is written once, to ``at`` or below the shared folder. Of each split only its length, the message that it ends in
    and what it begins with meet others of the same file.
    """
    prepare(spark)
    raw = spark.read.option("lineSep", "\n").text(files)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), "value")
    path = at or own_dir(spark, "scan")
    raw.select("file", "block", "size", F.col("value").cast("binary").alias("value")).mapInPandas(_finder(start_re), _FOUND).write.partitionBy("part").parquet(path)
    found = spark.read.schema(_FOUND.partition(", ")[2] + ", part int").parquet(path)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = found.where("part = 2").select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    placed = found.where("part < 2").join(base, ["file", "block"]).withColumn("pos_from", F.col("base") + F.col("at"))
    part = ["file", "size", "pos_from", "bytes", "date_at_byte", "date_bytes", "date_text", "date_at", "body"]
    whole = placed.where("part = 0").select(*part)
    # the last message of a split, and what other splits begin with: a row or two of each split
    rest = placed.where("part = 1")
    place = Window.partitionBy("file").orderBy("pos_from").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = rest.withColumn("start", F.last(F.when(F.col("date_at_byte") >= 0, F.col("pos_from")), ignorenulls=True).over(place)).where("start IS NOT NULL")
    first = lambda c: F.min_by(c, "pos_from").alias(c)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos_from", "body"))), lambda r: r["body"]), "").alias("text")
    joined = rest.groupBy("file", "start").agg(F.max("size").alias("size"), F.sum("bytes").alias("sum"), *map(first, ("date_at_byte", "date_bytes", "date_text", "date_at")), text)
    joined = joined.select("file", "size", F.col("start").alias("pos_from"), F.col("sum").alias("bytes"), "date_at_byte", "date_bytes", "date_text", "date_at", F.col("text").alias("body"))
    messages = whole.unionByName(joined.select(*part))
    over = F.col("pos_from") + F.col("bytes") > F.col("size")  # the last line of a file may lack its end
    date_from = F.col("pos_from") + F.col("date_at_byte")
    out = messages.select(
        "file", "pos_from", F.least(F.col("pos_from") + F.col("bytes"), F.col("size")).alias("pos_to"), date_from.alias("date_from"), (date_from + F.col("date_bytes")).alias("date_to"), "date_text", "date_at",
        (F.col("pos_from") + F.col("bytes") >= F.col("size")).alias("is_tail"), F.when(over, F.substr("body", F.lit(1), F.char_length("body") - 1)).otherwise(F.col("body")).alias("body"),
    )
    return out.withColumn("date", parse_date(F.col("date_text"), date_layout) if date_layout else F.lit(None).cast("timestamp"))


def raw_body(body: Column, date_text: Column, date_at: Column) -> Column:
    """The message as it is in the file."""
    return F.concat(F.substr(body, F.lit(1), date_at), date_text, F.substr(body, date_at + 1))


def rejected_files(messages: DataFrame) -> DataFrame:
    """Files with a message whose date cannot be read."""
    return messages.where("date IS NULL").select("file").distinct()
