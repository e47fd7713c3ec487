"""Windowed counts over the decision log or any stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evigraph.session import materialise


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", ts: str = "ts", by: str = "event_type") -> DataFrame:
    """(window_start, by, n): works on a batch and, with a watermark, on a stream (L1)."""
    src = events.withWatermark(ts, late) if events.isStreaming else events
    counted = src.groupBy(F.window(ts, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), by, "n")


def start_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished windows to Parquet, once for all that is there."""
    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)


def ingest_new(docs: DataFrame, table, checkpoint: str, write) -> StreamingQuery:
    """Feed only documents that the manifest lacks to ``write``, batch by batch (L4).

    Of equal texts one is fed, the same that a batch ingest takes; it is written down once,
    so that ``write`` and the manifest name the same.
    """
    from evigraph.sources.stores import firsts, not_ingested

    def batch(df: DataFrame, _: int) -> None:
        order = [c for c in ("doc_id", "text", "ticker", "company") if c in df.columns]
        rest = [c for c in df.columns if c not in (*order, "content_hash")]
        new = materialise(firsts(not_ingested(df, table.read()), [*order, *rest]).select(df.columns), "new")
        write(new)
        table.upsert(new.select(F.col("content_hash").alias("hash"), "ticker", "company", F.current_timestamp().alias("ingested_at")))

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
