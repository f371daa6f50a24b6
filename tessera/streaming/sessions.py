"""Turns of sessions as a stream: each counts once, and carries the folder that its session was last known to work in.

Turns may arrive late, repeated and in any order.  State by session (``transformWithState`` on RocksDB) holds the turns seen, those that
wait for the watermark, and the last known folder; a turn is given on once the watermark has passed it, so folders are carried
in the order of event time across all micro-batches.  What comes later than ``late`` is left out; a repeat carries the time of its turn, so
a session needs to remember only turns that wait.  ``turns`` is the same for a table; a stream over any shuffling of it within ``late``
gives its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.messages import carry_forward

TURN = "session_id string, turn_id string, ts timestamp, text string, cwd string"
_HELD = "turn_id string, ms long, text string, cwd string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def turns(rows: DataFrame) -> DataFrame:
    """``rows`` (TURN) once each, by session and turn, with the last known ``cwd``; equal times keep the order of turn ids."""
    first = F.row_number().over(Window.partitionBy("session_id", "turn_id").orderBy("ts", F.asc_nulls_last("cwd"), "text"))
    once = rows.withColumn("place", first).where("place = 1").drop("place")
    return carry_forward(once, "cwd", ["session_id"], [F.col("ts"), F.col("turn_id")])


class Turns(StatefulProcessor):
    """One session's state; times are milliseconds, which timers count in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "turn_id string", "ms long")
        self.held = handle.getListState("held", _HELD)
        self.folder = handle.getValueState("folder", "cwd string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for row in rows:
            if not self.seen.containsKey((row.turn_id,)):
                ms = int(row.ms)
                self.seen.updateValue((row.turn_id,), (ms,))
                self.held.appendValue((row.turn_id, ms, row.text, row.cwd))
                self.handle.registerTimer(ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        held = [tuple(v) for v in self.held.get()]
        due = sorted((v for v in held if v[1] <= passed), key=lambda v: (v[1], v[0]))
        if not due:
            return
        left = [v for v in held if v[1] > passed]
        if left:
            self.held.put(left)
        else:
            self.held.clear()
        folder = self.folder.get()[0] if self.folder.exists() else None
        for turn_id, ms, text, cwd in due:
            folder = folder if cwd is None else cwd
            self.seen.removeKey((turn_id,))  # a repeat has its turn's time and would be late from here on
            yield Row(session_id=key[0], turn_id=turn_id, ms=ms, text=text, cwd=folder)
        if folder is not None:
            self.folder.update((folder,))

    def close(self) -> None:
        pass


def turns_stream(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """``turns`` of a stream (TURN); needs RocksDB as the state store, which is set for the session."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = rows.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late)
    out = "session_id string, turn_id string, ms long, text string, cwd string"
    found = timed.groupBy("session_id").transformWithState(Turns(), out, "append", "EventTime")
    return found.select("session_id", "turn_id", F.timestamp_millis("ms").alias("ts"), "text", "cwd")
