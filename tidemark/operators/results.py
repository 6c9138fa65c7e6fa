"""Stored results of queries: submit, list, page, wipe."""

from __future__ import annotations

import threading
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F

from .store import Store

QUERY = "query_id int, text string, date_min timestamp, date_max timestamp, messages long, finished boolean, failed boolean, built_at timestamp"
HIT = "file string, pos long, len long, date timestamp, body string"


_ids = threading.Lock()


class Results:
    """Each query's hits are a folder of their own, written by parts; its metadata is a row for each report, of which the last
    counts. Nothing is written over, so readers are never in the way."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark
        self._running: dict[int, threading.Thread] = {}

    def _path(self, name: str, query_id: int | None = None) -> str:
        return f"{self.store.root}/{name}" + ("" if query_id is None else f"/query_id={query_id}")

    def _new_id(self) -> int:
        """An id that no other call gets: the file system decides between processes, the lock between threads."""
        with _ids:
            query_id = max(self._ids(), default=0) + 1
            while not self.store.create_exclusively(f"{self._path('query_ids')}/{query_id}"):
                query_id += 1
            return query_id

    def _ids(self) -> list[int]:
        if not self.store.exists(self._path("query_ids")):
            return []
        fs, p = self.store._fs(self._path("query_ids"))
        return [int(s.getPath().getName()) for s in fs.listStatus(p)]

    def _describe(self, *row) -> None:
        report = self.spark.createDataFrame([row], QUERY).coalesce(1).drop("query_id").withColumn("report", F.lit(time.time_ns()))
        report.write.mode("append").parquet(self._path("queries", row[0]))

    def submit(self, text: str, found: DataFrame, date_min: datetime | None = None, date_max: datetime | None = None, wait: bool = True, cuts: list[int] | None = None) -> int:
        """Stores the hits of ``found`` under a new id; with ``wait`` false the id returns while they are being written.

        ``cuts``: ids of segments at which the search is cut into parts. Hits can be listed, and are counted in the query's
        metadata, as soon as the part that they are in has been searched.
        """
        query_id, built = self._new_id(), datetime.now(timezone.utc)
        self._describe(query_id, text, date_min, date_max, 0, False, False, built)

        def run() -> None:
            try:
                n = 0
                for k, (lo, hi) in enumerate(zip([None, *(cuts or [])], [*(cuts or []), None])):
                    part = found if lo is None else found.where(F.col("segment_id") >= lo)
                    part = part if hi is None else part.where(F.col("segment_id") < hi)
                    rows = part.select("file", F.col("pos_from").alias("pos"), (F.col("pos_to") - F.col("pos_from")).alias("len"), F.col("date").cast("timestamp").alias("date"), "body")
                    rows.write.mode("overwrite").parquet(f"{self._path('query_results', query_id)}/part={k}")
                    n += self.spark.read.parquet(f"{self._path('query_results', query_id)}/part={k}").count()
                    self._describe(query_id, text, date_min, date_max, n, hi is None, False, built)
            except Exception:
                self._describe(query_id, text, date_min, date_max, 0, False, True, built)
                raise

        if wait:
            run()
        else:
            self._running[query_id] = threading.Thread(target=run, daemon=True)
            self._running[query_id].start()
        return query_id

    def wait(self, query_id: int) -> None:
        if thread := self._running.pop(query_id, None):
            thread.join()

    def list(self, ids: list[int] | None = None) -> DataFrame:
        """Metadata of all queries, or of ``ids``, newest first."""
        path = self._path("queries")
        rows = self.spark.read.schema(f"{QUERY}, report long").parquet(path) if self.store.exists(path) else self.spark.createDataFrame([], f"{QUERY}, report long")
        last = rows.groupBy("query_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("query_id", "report")]), "report").alias("q"))
        rows = last.select("query_id", "q.*")
        return history(rows if ids is None else rows.where(F.col("query_id").isin(ids)))

    def page(self, query_id: int, skip: int = 0, limit: int = 100) -> DataFrame:
        """Hits by date; none for an unknown id or one without hits yet."""
        path = self._path("query_results", query_id)
        done = [n for n in self.store.names(path) if self.store.exists(f"{path}/{n}/_SUCCESS")]
        rows = self.spark.read.schema(HIT).parquet(*[f"{path}/{n}" for n in done]) if done else self.spark.createDataFrame([], HIT)
        return hits_page(rows, skip, limit)

    def wipe(self, query_id: int) -> None:
        for name in ("queries", "query_results"):
            self.store.delete(self._path(name, query_id))


def history(queries: DataFrame) -> DataFrame:
    """All of them, newest first."""
    return queries.orderBy(F.desc("built_at"), F.desc("query_id"))


def hits_page(hits: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    return hits.orderBy("date", "file", "pos").offset(skip).limit(limit)


def page_count(queries: DataFrame, per_page: int) -> DataFrame:
    return queries.select("query_id", F.ceil(F.col("messages") / per_page).alias("pages"))
