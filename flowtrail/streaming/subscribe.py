"""Connections as a subscriber sees them: a snapshot first, then changes; and changes from samples of running totals.

State is one small row a connection, kept by transformWithState; an earlier batch result may be its initial state. What
Spark hands to it costs far more by row than by value, so a connection's rows of a batch are packed into arrays first. A micro-batch is one write, under its number, so a batch that is replayed after a failure replaces what
it wrote.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CONNECTION = "uplink_total long, downlink_total long, uplink long, downlink long, created_ms long, closed_ms long, seq long"
COLUMNS = [c.split()[0] for c in CONNECTION.split(", ")]
CHANGE, SAMPLE, DELTA = ["seq", "type", "ts_ms", "up_delta", "down_delta"], ["ts", "upload", "download"], ["ts", "up_delta", "down_delta"]
_CONNECTION, _DELTAS = Row("id", *COLUMNS), Row("id", *DELTA)
#: A task packs so many rows at a time, some 50 MB.
PACK_ROWS = 1 << 19
#: A connection's state goes so long after it closed.
EVICT_MS = 5 * 60 * 1000


@contextmanager
def settings(spark: SparkSession) -> Iterator[None]:
    """What stateful queries need while they are started and run to the end of what is there."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def packed(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """The rows of each batch by id: an array of each column, in the order of one of them. An id of more than PACK_ROWS may have several rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = [], 0
        for batch in batches:
            block.append(batch)
            size += batch.num_rows
            if size >= PACK_ROWS:
                yield arrays(block)
                block, size = [], 0
        if size:
            yield arrays(block)

    def arrays(block: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(block).sort_by([("id", "ascending"), (order, "ascending")]).combine_chunks()
        ids = t["id"].combine_chunks()
        starts = np.flatnonzero(np.diff(ids.dictionary_encode(null_encoding="encode").indices.to_numpy(), prepend=-1))
        bounds = pa.array(np.append(starts, len(ids)), pa.int32())
        return pa.RecordBatch.from_arrays([ids.take(pa.array(starts)), *[pa.ListArray.from_arrays(bounds, t[c].combine_chunks()) for c in columns]], ["id", *columns])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in columns}
    return rows.select("id", *columns).repartition("id").mapInArrow(pack, ", ".join(["id string", *[f"{c} array<{k}>" for c, k in kinds.items()]]))


def _unpacked(rows: Iterator[Row], columns: list[str]) -> list[tuple]:
    """The packed rows of one id, by the first column."""
    return sorted((x for row in rows for x in zip(*(row[c] for c in columns))), key=itemgetter(0))


class _Follow(StatefulProcessor):
    """The connection after each batch of its events. Events that the snapshot has seen already are passed over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("connection", CONNECTION)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.state.update(tuple(initialState[c] for c in COLUMNS))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.state.get()
        known = before is not None
        up, down, rate_up, rate_down, created, closed, seq = before or (0, 0, 0, 0, None, None, None)
        timed, changed = closed is not None, False
        for at, kind, ts, u, d in _unpacked(rows, CHANGE):
            if seq is not None and at <= seq:
                continue
            if kind == "NEW":
                up, down, rate_up, rate_down, created, closed, known = u, d, 0, 0, ts, None, True
            elif known and kind == "UPDATE":
                up, down, rate_up, rate_down = up + u, down + d, u, d
            elif known and kind == "CLOSED":
                rate_up, rate_down, closed = 0, 0, ts
            else:
                continue
            seq, changed = at, True
        if not changed:
            return
        now = (up, down, rate_up, rate_down, created, closed, seq)
        self.state.update(now)
        if timed:  # only a closed connection has a timer
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if closed is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + EVICT_MS)
        yield _CONNECTION(key[0], *now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def follow(changes: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """The state (id and COLUMNS) of each connection that a batch of changes touched, from changes (id, seq, type, ts_ms, up_delta, down_delta).

    snapshot: connections as accounting.apply_changes gives them, with the seq that each has seen; it may overlap with
    the changes. Updates of connections that neither has told of are ignored.
    """
    first = snapshot.select("id", *COLUMNS).groupBy("id") if snapshot is not None else None
    return packed(changes, "seq", CHANGE).groupBy("id").transformWithState(_Follow(), f"id string, {CONNECTION}", "Update", "ProcessingTime", first)


def subscribe(changes: DataFrame, snapshot: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that writes the snapshot (reset is true) with the first batch, and then what each batch changed, until all that is there is read.

    The folder of a batch is written as a whole, so a replay leaves the same rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        out = batch.withColumn("reset", F.lit(False))
        if number == 0:
            out = snapshot.select("id", *COLUMNS).withColumn("reset", F.lit(True)).unionByName(out)
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return follow(changes, snapshot).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def subscribed(spark: SparkSession, path: str) -> DataFrame:
    """The connections that a subscriber knows of after all batches: of each, what came last."""
    rows = spark.read.schema(f"id string, {CONNECTION}, reset boolean, batch long").parquet(path)
    return rows.groupBy("id").agg(F.max_by(F.struct(*COLUMNS), F.struct("seq", "batch")).alias("s")).select("id", "s.*")


EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _millis(at: datetime) -> int:
    """Milliseconds since 1970; a time without a zone is in UTC."""
    return ((at if at.tzinfo else at.replace(tzinfo=timezone.utc)) - EPOCH) // timedelta(milliseconds=1)


class _Deltas(StatefulProcessor):
    """Updates from samples; a connection that falls silent gives one zero, by its next sample or by its timer."""

    def __init__(self, quiet_ms: int | None) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("sample", "upload long, download long, had boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        up, down, had = self.state.get() or (0, 0, False)
        made, timed, last = [], had, None
        for ts, u, d in _unpacked(rows, SAMPLE):
            more = u - up, d - down
            moved = min(more) >= 0 and max(more) > 0
            if moved or had:
                made.append((ts, *(more if moved else (0, 0))))
            up, down, had, last = u, d, moved, ts
        self.state.update((up, down, had))
        if self.quiet_ms is not None:
            if timed:  # only after traffic there is a timer
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
            if had:
                self.handle.registerTimer(_millis(last) + self.quiet_ms)
        if made:
            yield _DELTAS(key[0], *map(list, zip(*made)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        up, down, had = self.state.get()
        if had:
            self.state.update((up, down, False))
            yield _DELTAS(key[0], [EPOCH + timedelta(milliseconds=expiredTimerInfo.getExpiryTimeInMs())], [0], [0])

    def close(self) -> None:
        pass


def deltas(samples: DataFrame, quiet: str | None = None) -> DataFrame:
    """accounting.change_events over a stream of samples (id, ts, upload, download), the same for any split into batches.

    quiet: how long after its last traffic a connection without a further sample gives its zero; ts is then a TIMESTAMP and
    rows count up to that long after the latest one. Without it only samples give zeros, and ts may be of any type.
    """
    kind = samples.schema["ts"].dataType.simpleString()
    out = f"id string, ts array<{kind}>, up_delta array<long>, down_delta array<long>"
    if quiet is None:
        made = packed(samples, "ts", SAMPLE).groupBy("id").transformWithState(_Deltas(None), out, "Append", "None")
    else:
        ms = int(pd.Timedelta(quiet).total_seconds() * 1000)
        # the watermark is told by row, so rows stay apart
        single = samples.withWatermark("ts", quiet).select("id", *[F.array(c).alias(c) for c in SAMPLE], F.col("ts").alias("_at"))
        made = single.groupBy("id").transformWithState(_Deltas(ms), out, "Append", "EventTime")
    return made.select("id", F.inline(F.arrays_zip(*DELTA)))
