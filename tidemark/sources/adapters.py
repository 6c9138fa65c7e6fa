"""Tables as messages: file, pos_from, date, body."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..workers import spread


def as_messages(df: DataFrame, file: str, pos: str, body: str, date: str | None = None) -> DataFrame:
    when = F.expr(date) if date else F.lit(None).cast("timestamp")
    return df.select(F.expr(file).cast("string").alias("file"), F.expr(pos).cast("long").alias("pos_from"), when.alias("date"), F.expr(body).alias("body"))


def table_messages(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver's text tables and events as messages."""
    shape = {
        "documents": ("source", "doc_id", "text", None),
        "conversations": ("conv_id", "turn", "text", None),
        "pages": ("url", "page_id", "html", None),
        "events": ("event_type", "event_id", "concat(event_type, ' user_', user_id, ' ', props)", "ts"),
    }
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return as_messages(rows if name == "events" else spread(rows), *shape[name])
