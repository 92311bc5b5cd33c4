"""Live accounting: the changelog of connections and traffic per tick as streaming queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "uplink_total long, downlink_total long, uplink long, downlink long, closed_ms long, known boolean"
OUT = "id string, uplink_total long, downlink_total long, uplink long, downlink long, closed_ms long"
EVICT_MS = 5 * 60 * 1000


def states(events: DataFrame) -> DataFrame:
    """The state of each connection after every batch of its events (id, seq, type, ts_ms, up_delta, down_delta).

    State is one small row for each live connection; it goes five minutes after the connection closed.
    """

    def step(key: tuple, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        up, down, rate_up, rate_down, closed, known = state.get if state.exists else (0, 0, 0, 0, None, False)
        rows = pd.concat(list(batches)).sort_values("seq")
        for kind, ts, u, d in zip(rows["type"], rows["ts_ms"], rows["up_delta"], rows["down_delta"]):
            if kind == "NEW":
                up, down, rate_up, rate_down, closed, known = int(u), int(d), 0, 0, None, True
            elif known and kind == "UPDATE":
                up, down, rate_up, rate_down = up + int(u), down + int(d), int(u), int(d)
            elif known and kind == "CLOSED":
                rate_up, rate_down, closed = 0, 0, int(ts)
        state.update((up, down, rate_up, rate_down, closed, known))
        if closed is not None:
            state.setTimeoutDuration(EVICT_MS)
        if known:
            yield pd.DataFrame({"id": [key[0]], "uplink_total": [up], "downlink_total": [down], "uplink": [rate_up], "downlink": [rate_down], "closed_ms": pd.array([closed], "Int64")})

    return events.groupBy("id").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def per_tick(flows: DataFrame, seconds: int = 1, late: str = "1 minute") -> DataFrame:
    """Upload and download of each tick; late rows beyond the watermark are left out. created_at must be a TIMESTAMP or TIMESTAMP_NTZ."""
    at = flows.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    return at.groupBy(F.window("created_at", f"{seconds} seconds")).agg(F.sum("upload").alias("up"), F.sum("download").alias("down")).select(F.col("window.start").alias("tick"), "up", "down")
