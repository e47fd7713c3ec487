"""Sliding-window rate limit.

A hit is accepted unless ``limit`` accepted hits of its key lie in the ``seconds``
before it; refused hits are not counted. Whether a hit is accepted depends on all
before it, so exactness needs state for each key: at most ``limit`` times.
"""

from __future__ import annotations

import bisect
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window_counts(events: DataFrame, seconds: int = 60, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Hits of the key in the window ending at each hit, refused ones included: an upper bound (L2)."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("_at").rangeBetween(-seconds * 1_000_000, Window.currentRow)
    return events.withColumn("_at", at).withColumn("n_window", F.count(F.lit(1)).over(w)).drop("_at")


def exact(events: DataFrame, limit: int, seconds: int = 60, key: str = "user_id", ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """(id, key, ts, accepted) of a batch of events (L2).

    Events are dealt by key, sorted within their partition and read as a stream of
    Arrow batches; only the accepted times of one key are held, so a hot key costs time
    but no memory; that one task must see a key's hits in order is in the question. Hits
    without a time are left out.
    """
    src = events.select(F.col(id_col), F.col(key), F.col(ts)).where(F.col(ts).isNotNull())
    dealt = src.repartition(key).sortWithinPartitions(key, ts, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken = None, deque()
        for batch in batches:
            ok = []
            times = batch.column(2).cast(pa.int64()).to_pylist()
            for who, t in zip(batch.column(1).to_pylist(), times, strict=True):
                if who != now:
                    now, taken = who, deque()
                while taken and taken[0] <= t - seconds * 1_000_000:
                    taken.popleft()
                ok.append(len(taken) < limit)
                if ok[-1]:
                    taken.append(t)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok, pa.bool_())], [id_col, key, ts, "accepted"])

    return dealt.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema) + ", accepted boolean")


def streaming(events: DataFrame, limit: int, seconds: int = 60, late: str = "1 minute", key: str = "user_id", ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """The same over a stream: a key's accepted times are its state (L2).

    A hit is judged by the accepted hits of its window that are known when it comes: in
    order of time within a micro-batch, so a stream in order equals ``exact``. One that
    comes late, after later hits, counts those at or before its own time only, and
    accepted hits stay accepted; later than ``late`` behind the newest it is dropped. State
    goes by event time, once the watermark has passed the window of its newest hit.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    width = seconds * 1_000_000

    def run(who: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        mark = state.getCurrentWatermarkMs() * 1000
        taken = [t for t in (state.get[0] if state.exists else []) if t > mark - width]
        rows = pd.concat(list(frames)).sort_values([ts, id_col])
        ok = []
        for t in rows[ts].astype("datetime64[us]").astype("int64"):
            ok.append(bisect.bisect_right(taken, t) - bisect.bisect_right(taken, t - width) < limit)
            if ok[-1]:
                bisect.insort(taken, t)
        state.update((taken,))
        newest = max(taken, default=mark)
        state.setTimeoutTimestamp(max(newest + width, mark) // 1000 + 1)
        yield pd.DataFrame({id_col: rows[id_col].to_numpy(), key: who[0], "accepted": ok})

    kinds = dict(events.dtypes)
    grouped = events.select(id_col, key, ts).where(F.col(ts).isNotNull()).withWatermark(ts, late).groupBy(key)
    return grouped.applyInPandasWithState(run, f"{id_col} {kinds[id_col]}, {key} {kinds[key]}, accepted boolean", "taken array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def live_sessions(sessions: DataFrame, now, hours: int = 12, created: str = "created_at") -> DataFrame:
    """Sessions no older than their time to live (L3)."""
    return sessions.where(F.col(created) > F.lit(now) - F.expr(f"INTERVAL {hours} HOURS"))
