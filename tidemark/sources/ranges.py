"""Messages of byte ranges of log files that executors can open themselves: no byte outside the ranges is parsed.

A range is cut into splits. A message belongs to the split that it begins in, whose task reads on to its end, so nothing
has to be put together afterwards, positions are known at once, and a file that grew costs what was added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dates import parse_date
from ..workers import prepare

#: Bytes of a split and task: at least, if all machines have work then, and at most; of one read; of one Arrow batch.
SPLITS, READ, BATCH = (2 << 20, 64 << 20), 4 << 20, 8 << 20
MESSAGE = pa.schema([
    ("file", pa.string()), ("pos_from", pa.int64()), ("pos_to", pa.int64()), ("date_from", pa.int64()), ("date_to", pa.int64()), ("date_text", pa.string()), ("date_at", pa.int32()),
    ("is_tail", pa.bool_()), ("body", pa.string()), ("segment_id", pa.int64()),
])
_SCHEMA = "file string, pos_from long, pos_to long, date_from long, date_to long, date_text string, date_at int, is_tail boolean, body string, segment_id long"


def opens(file: str) -> bool:
    """Whether executors can open the file by its path: it is in no store, or in a folder that all machines mount."""
    return file.startswith(("file:", "/"))


def local_path(file: str) -> str:
    return re.sub(r"^file:/+", "/", file)


@dataclass(frozen=True)
class Split:
    file: str
    start: int
    end: int
    size: int
    #: The id of its first segment; a split has at most as many as bytes.
    first_segment: int


def split_bytes(spark: SparkSession, ranges: list[tuple[str, int, int]]) -> int:
    """The length of splits that gives every core some, within ``SPLITS``."""
    share = sum(size - start for _, start, size in ranges) // (3 * spark.sparkContext.defaultParallelism)
    return max(SPLITS[0], min(SPLITS[1], share))


def splits_of(ranges: list[tuple[str, int, int]], first_segment: int = 0, longest: int = SPLITS[1]) -> list[Split]:
    """Splits of ``(file, start, size)``: from ``start`` to the file's end. Segment ids rise with file and position."""
    out, at = [], first_segment
    for file, start, size in ranges:
        for a in range(start, size, longest):
            out.append(Split(file, a, min(a + longest, size), size, at))
            at += min(longest, size - a)
    return out


def split_messages(split: Split, pattern: re.Pattern, segment_length: int) -> Iterator[tuple]:
    """The messages that begin in a split, each with the segment it is in; memory holds one read and one message."""
    with open(local_path(split.file), "rb") as file:
        at = max(split.start - 1, 0)  # one byte before tells whether a line begins
        file.seek(at)
        rest, held, began, date = b"", [], None, (0, 0)
        filled, segment = 0, split.first_segment - 1

        def message(last: bool) -> tuple:
            raw = b"".join(held)
            a, b = date
            head = raw[:a].decode("utf-8", "replace")
            return (split.file, began, began + len(raw), began + a, began + b, raw[a:b].decode("utf-8", "replace"), len(head), last, head + raw[b:].decode("utf-8", "replace"), segment)

        while True:
            chunk = file.read(min(max(READ, len(rest)), split.size - at - len(rest)))  # a long line is read in growing steps
            text, over = rest + chunk, not chunk
            cut = len(text) if over else text.rfind(b"\n") + 1
            skip = min(len(text), 1 if at or began is not None else 0)
            if cut <= skip and not over:
                rest = text
                continue
            begin = skip
            for m in pattern.finditer(text, skip, cut):
                if began is not None:
                    held.append(text[begin : m.start()])
                    filled += at + m.start() - began
                    yield message(False)
                if at + m.start() >= split.end:
                    return
                if at + m.start() < split.start:
                    began = None
                    continue
                if began is None or filled >= segment_length:
                    filled, segment = 0, segment + 1
                began, held, begin = at + m.start(), [], m.start()
                a, b = m.span(1)
                date = (a - m.start(), b - m.start()) if a >= 0 else (0, 0)
            if began is not None:
                held.append(text[begin:cut])
            if over:
                if began is not None:
                    yield message(True)
                return
            if began is None and at + cut >= split.end:
                return
            rest, at = text[cut - 1 :], at + cut - 1


def read_ranges(spark: SparkSession, splits: list[Split], start_re: str, date_layout: str | None = None, segment_length: int = 5_000_000) -> DataFrame:
    """The messages of all splits, in order of file and position.

    A task reads one split, or several small ones that follow each other, so that many small files are few tasks. The
    driver holds the list of splits, as Spark's own readers do.
    """
    prepare(spark)
    most, tasks, size = max((s.end - s.start for s in splits), default=0), [], 0
    for s in splits:
        if not tasks or size + s.end - s.start > max(most, SPLITS[0]):
            tasks.append([])
            size = 0
        tasks[-1].append(s)
        size += s.end - s.start
    shared = spark.sparkContext.broadcast(tasks)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(start_re.encode(), re.M)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rows, size = [], 0
                for row in (row for s in shared.value[k] for row in split_messages(s, pattern, segment_length)):
                    rows.append(row)
                    size += row[2] - row[1] + 64
                    if size >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), MESSAGE)], schema=MESSAGE)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), MESSAGE)], schema=MESSAGE)

    found = spark.range(0, len(tasks), 1, max(1, len(tasks))).mapInArrow(find, _SCHEMA)
    return found.withColumn("date", parse_date(F.col("date_text"), date_layout) if date_layout else F.lit(None).cast("timestamp"))


def is_start(file, at: int, size: int, pattern: re.Pattern) -> bool:
    """Whether a message begins at a position of an open file."""
    if at >= size:
        return at == size
    skip = min(at, 1)
    file.seek(at - skip)
    text = b""
    while b"\n" not in text[skip:]:
        chunk = file.read(min(1 << 16, size - at + skip - len(text)))
        if not chunk:
            break
        text += chunk
    end = text.find(b"\n", skip) + 1 or len(text)
    return bool((m := pattern.match(text, skip, end)) and m.end() > skip)


def still_starts(segments: DataFrame, start_re: str) -> DataFrame:
    """``segments`` (file, pos_from, size and any more) with ``ok``: whether a message begins at ``pos_from`` now.

    Of a file, only the lines at these positions are read.
    """
    prepare(segments.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema.fields) + ", ok boolean"

    def probe(batches):
        pattern, name, file = re.compile(start_re.encode(), re.M), None, None
        for pdf in batches:
            ok = []
            for path, at, size in zip(pdf["file"], pdf["pos_from"].tolist(), pdf["size"].tolist()):
                if path != name:
                    if file:
                        file.close()
                    name, file = path, open(local_path(path), "rb")
                ok.append(is_start(file, at, size, pattern))
            yield pdf.assign(ok=ok)
        if file:
            file.close()

    return segments.mapInPandas(probe, schema)
