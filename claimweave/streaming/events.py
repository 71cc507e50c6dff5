"""Extensions for streams of events: windowed counts with a watermark, and lease expiry as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LEASE_MS = 900_000


def windowed(events: DataFrame, size: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Counts and sums by type in tumbling windows; events later than ``late`` are dropped by the watermark, as streams do."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # a time without zone is read in the session's
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def expiring(events: DataFrame) -> DataFrame:
    """(item, status, expired): an item's claim expires when event time passes its lease without a heartbeat."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"item": [key[0]], "status": ["queued"], "expired": [True]})
            return
        for pdf in batches:
            last = pdf.sort_values("ts").iloc[-1]
            if last["event_type"] in ("click", "view"):
                state.update((str(last["event_type"]),))
                due = int(last["ts"].value // 1_000_000) + LEASE_MS
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame({"item": [key[0]], "status": ["leased" if state.exists else "done"], "expired": [False]})

    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour").groupBy(F.col("user_id").alias("item"))
    return rows.applyInPandasWithState(step, "item long, status string, expired boolean", "kind string", "append", GroupStateTimeout.EventTimeTimeout)
