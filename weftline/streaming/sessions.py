"""Sessions as streams: windowed counts with late data, deduplicated deliveries, and state per session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ORDER_SCHEMA = "session long, idx long, place long, updates long"


def activity(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by time window and event type; rows later than ``late`` are not counted."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("_w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("_w.start").alias("start"), "event_type", "n", "total")


def once(deliveries: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each payload of a session once within the watermark."""
    return deliveries.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session", "payload"])


def first_selection(rows: DataFrame, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """(session, idx, place, updates): segments of (session, idx, ts) in order of first selection, as they arrive.

    A session's places survive from batch to batch; its state goes once the watermark is ``idle_ms`` past its last row, so that state
    is bounded by the sessions at work, and an idle stream asks for no more batches. A batch's new segments are placed by idx.
    """

    def place(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known, updates = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        seen, found, last = set(known), set(), state.getCurrentWatermarkMs()
        for batch in batches:
            found |= {int(i) for i in batch["idx"]}
            last = max(last, int(batch["ms"].max()))
        new = sorted(found - seen)
        start = len(known)
        state.update((known + new, updates + 1))
        state.setTimeoutTimestamp(last + idle_ms)
        yield pd.DataFrame({"session": [key[0]] * len(new), "idx": new, "place": range(start, start + len(new)), "updates": updates + 1}).astype("int64")

    timed = rows.withWatermark("ts", late).select("session", "idx", "ts", F.unix_millis("ts").alias("ms"))
    return timed.groupBy("session").applyInPandasWithState(place, ORDER_SCHEMA, "known array<long>, updates long", "append", GroupStateTimeout.EventTimeTimeout)
