"""Sessions that end by themselves: events of a user with no pause as long as the gap (L3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts", by: str = "user_id") -> DataFrame:
    """(by, session_start, session_end, n): a row for each session; it ends ``gap`` after its last event.

    On a stream a session is state until the watermark, ``late`` behind the newest event,
    passes its end; then it comes out as a row and its state goes, whether or not its user
    is ever heard of again. Events without a time or a user are in no session; an event that
    comes just as a session ends is still of it; events later than the watermark are
    left out by the stream.
    """
    src = events.where(F.col(ts).isNotNull() & F.col(by).isNotNull())
    src = src.withWatermark(ts, late) if events.isStreaming else src
    held = src.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return held.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def start_sessions(ended: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append sessions that have ended to Parquet, once for all that is there."""
    return ended.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
