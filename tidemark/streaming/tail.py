"""Streams: periodic reconciliation of growing files, and standing queries over a stream of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..plans.match import matches
from ..qlang.parser import parse


def tail(engine: Engine, period: str = "60 seconds", checkpoint: str | None = None) -> StreamingQuery:
    """Ingests once a micro-batch, so runs never overlap and a restart goes on. Text appended to a known file is found too."""

    def once(batch: DataFrame, number: int) -> None:
        engine.ingest()
        engine.merge()

    ticks = engine.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(once).trigger(processingTime=period)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def standing_query(messages: DataFrame, query: str) -> DataFrame:
    """The messages of a stream that match, as they come."""
    return messages.where(matches(parse(query), F.col("body")))


def hits_by_time(messages: DataFrame, query: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Hits of a stream by window of ``date``; windows close ``late`` after their end."""
    found = standing_query(messages, query).withWatermark("date", late)
    return found.groupBy(F.window("date", width).alias("w")).agg(F.count("*").alias("messages")).select(F.col("w.start").alias("window_start"), "messages")
