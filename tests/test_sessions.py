"""Sessions of a stream against those of a batch, and the state that is left."""

import datetime as dt
import random

from evigraph.streaming.sessions import sessions, start_sessions

EVENTS = "user_id long, ts timestamp, x int"


def rows(df):
    return sorted(map(tuple, df.select("user_id", "session_start", "session_end", "n").collect()))


def test_stream_equals_batch_and_state_expires(spark, tmp_path):
    """Files in the order of time; a last event far ahead ends all sessions before it."""
    r, t0 = random.Random(3), dt.datetime(2024, 5, 1)
    data = sorted(((r.randrange(12), t0 + dt.timedelta(minutes=r.randrange(3000)), 1) for _ in range(600)), key=lambda e: e[1])
    data += [(None, t0, 1), (5, None, 1)]
    last = (99, t0 + dt.timedelta(days=30), 1)
    parts = [data[k : k + 151] for k in range(0, len(data), 151)] + [[last]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = start_sessions(sessions(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/cp")
        q.awaitTermination(300)
        left = q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress else None
    want = rows(sessions(spark.createDataFrame(data, EVENTS)))
    got = rows(spark.read.parquet(f"{tmp_path}/out"))
    assert got == want and len(want) > 100 and left <= 1
    by_hand, ends = 0, {}
    for user, ts, _ in data:
        if user is not None and ts is not None:
            by_hand += user not in ends or ts > ends[user]
            ends[user] = ts + dt.timedelta(minutes=30)
    assert len(want) == by_hand
