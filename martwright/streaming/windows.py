"""Event-time windows and the audit log as streams. Beyond what a batch mart needs, and labelled so.

Each function takes a streaming or a batch DataFrame; watermarks bound the state of a stream and mean nothing to a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(events: DataFrame, at: str, width: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sliding(events: DataFrame, at: str, width: str, hop: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark(at, late).groupBy(F.window(at, width, hop), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, at: str, gap: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    """Sessions end when no event comes for the gap; end is the last event's time plus the gap."""
    w = events.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def audit_stream(spark: SparkSession, path: str) -> DataFrame:
    """The audit log as a stream of new files."""
    from ..sources.logs import RECORD

    return spark.readStream.schema(RECORD).json(path)


def reasons(records: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Refusals by reason and window."""
    return tumbling(records.where(F.col("reason_code").isNotNull()), "timestamp", width, "reason_code")


def write_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that has come so far, then stops; started again it goes on where it stopped, exactly once into Parquet."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
