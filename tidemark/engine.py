"""The engine: ingest files, search them, keep results."""

from __future__ import annotations

import threading
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from .config import Config
from .functions.dates import bound, parse_date
from .functions.tokenize import query_terms, sure_terms
from .operators.ingest import compacted, ingest, rewritten
from .operators.results import Results
from .operators.search import check_query, search
from .operators.store import Store
from .plans.prune import candidates
from .sources.discover import discover
from .sources.ranges import opens, read_ranges, splits_of
from .sources.scan import raw_body, scan_messages

#: How segments are ruled out by the index: a literal must begin a term of the segment; only where no hit can be lost; not at all.
PRUNING = ("prefix", "exact", "none")
#: Folders of postings and of messages from which on ``run`` merges them; bytes that a stored query searches between two reports.
MERGE_POSTINGS, MERGE_MESSAGES, REPORT_BYTES = 20, 500, 4 << 30


class Engine:
    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config.checked()
        self.store = Store(spark, config.storage_path)
        self.results = Results(self.store)

    @property
    def globs(self) -> list[str]:
        return [g.strip() for g in self.config.files_glob_pattern.split(",")]

    def ingest(self) -> dict[str, int]:
        c = self.config
        return ingest(self.spark, self.store, self.globs, c.message_start_re, c.date_format, c.segment_length, c.min_term_len, c.max_term_len)

    def run(self, period: float = 60, stop: threading.Event | None = None) -> None:
        """Ingests every ``period`` seconds and merges what has piled up, never twice at a time, until ``stop`` is set."""
        stop = stop or threading.Event()
        while not stop.is_set():
            self.ingest()
            self.merge()
            stop.wait(period)

    def merge(self) -> None:
        tables = self.store.manifest()["tables"]
        if len(tables["messages"]) >= MERGE_MESSAGES:
            rewritten(self.store)
        elif len(tables["postings"]) >= MERGE_POSTINGS:
            compacted(self.store)

    def compact(self) -> None:
        """Merges the index now; searches read the merged one from then on."""
        compacted(self.store)

    def segments(self, query: str, pruning: str = "prefix", manifest: dict | None = None) -> DataFrame | None:
        """The ids of the segments that may hold a hit; None: the index cannot rule out any."""
        if pruning not in PRUNING:
            raise ValueError(f"pruning: one of {', '.join(PRUNING)}")
        if pruning == "none":
            return None
        node, split = check_query(query)[0], query_terms if pruning == "prefix" else sure_terms
        return candidates(self.store.read("postings", manifest), node, lambda t: split(t, self.config.min_term_len, self.config.max_term_len))

    def search(self, query: str, date_from: str | datetime | None = None, date_to: str | datetime | None = None, pruning: str = "prefix", sort: bool = True) -> DataFrame:
        """Matching messages by date. By default a literal must begin a term of a message's segment, wherever else it then
        is found; ``pruning="exact"`` finds it anywhere, and still leaves out segments where it can be nowhere."""
        check_query(query, date_from, date_to)
        manifest = self.store.manifest()
        return search(self.store.read("messages", manifest), query, date_from, date_to, segments=self.segments(query, pruning, manifest), sort=sort)

    def kept_share(self, query: str, pruning: str = "prefix") -> float:
        """The share of segments that a search reads."""
        found, every = self.segments(query, pruning), self.store.read("segments").count()
        return 1.0 if found is None or not every else found.join(self.store.read("segments"), "segment_id", "left_semi").count() / every

    def bodies(self, found: DataFrame) -> DataFrame:
        """Hits with their text as it is in the file."""
        return found.select("file", "pos_from", "date", raw_body(F.col("body"), F.col("date_text"), F.col("date_at")).alias("text"))

    def submit(self, query: str, date_from: str | datetime | None = None, date_to: str | datetime | None = None, wait: bool = True, pruning: str = "prefix") -> int:
        """Stores the hits under a new id. They and their number appear as parts of the messages have been searched."""
        found = self.search(query, date_from, date_to, pruning, sort=False)
        bounds = self.store.read("segments").agg(F.sum(F.col("pos_to") - F.col("pos_from")).alias("n"), F.min("segment_id").alias("lo"), F.max("segment_id").alias("hi")).first()
        parts = max(1, -(-(bounds.n or 0) // REPORT_BYTES))  # ids rise with bytes, so equal ranges of ids are about equal parts
        cuts = [bounds.lo + (bounds.hi - bounds.lo) * k // parts for k in range(1, parts)] if bounds.n else []
        return self.results.submit(query, found, bound(date_from), bound(date_to), wait, cuts)

    def test_config(self) -> str:
        """Reads the first file's first message and date; returns the file, or raises ``ValueError``."""
        first = discover(self.spark, self.globs).orderBy("file").first()
        if first is None:
            raise ValueError(f"unable to find files at {self.config.files_glob_pattern}: no files found")
        if opens(first.file):
            some = read_ranges(self.spark, splits_of([(first.file, 0, first["size"])])[:1], self.config.message_start_re)
        else:
            some = scan_messages(self.spark, [first.file], self.config.message_start_re)
        message = some.orderBy("pos_from").first()
        if message is None:
            raise ValueError(f"no messages found in {first.file} (check regular expression again)")
        date = self.spark.range(1).select(parse_date(F.lit(message.date_text), self.config.date_format)).first()[0]
        if date is None:
            raise ValueError(f"unable to test the file at {first.file}: parse date: {message.date_text}")
        return first.file
