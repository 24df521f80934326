"""Windowed counts with watermarks and the limiter as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_counts(events: DataFrame, ts: str, kind: str, width: str, late: str) -> DataFrame:
    """(start, kind, n) per window; on a stream, rows later than ``late`` are left out. Works on batches too."""
    timed = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", width).alias("w"), F.col(kind)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def session_counts(events: DataFrame, ts: str, user: str, gap: str, late: str) -> DataFrame:
    timed = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.session_window("_t", gap).alias("w"), F.col(user)).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def limiter(requests: DataFrame, client: str, ts: str, limit: int, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Stream of (client, ts, allowed, retry_after_s): a window opens with the first request after the last one closed.

    State per client is two numbers; it expires when the watermark (``late`` behind the newest request) has passed its window.
    """

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        for pdf in batches:
            out = []
            for t in pdf.sort_values("ts")["ts"]:
                micros = int(t.value // 1000)
                if start is None or micros - start >= seconds * 1_000_000:
                    start, count = micros, 0
                count += 1
                wait = None if count <= limit else (start + seconds * 1_000_000 - micros + 999_999) // 1_000_000
                out.append((key[0], t, count <= limit, wait))
            yield pd.DataFrame(out, columns=["client", "ts", "allowed", "retry_after_s"]).astype({"retry_after_s": "Int64"})
        state.update((start, count))
        state.setTimeoutTimestamp(max(start // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    shaped = requests.select(F.col(client).cast("string").alias("client"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", late)
    return shaped.groupBy("client").applyInPandasWithState(decide, "client string, ts timestamp, allowed boolean, retry_after_s long", "start long, count long", "append", GroupStateTimeout.EventTimeTimeout)
