"""First completed event per submission, as events arrive."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from suitegauge.operators.submissions import completed_events

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_completed_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Passes on the first completed event seen per submission.

    State holds one key per submission and only until the watermark has passed
    it, so it is bounded by the submissions of one ``delay``, not by the history.
    "First" is the arrival order by micro-batch; within one batch any of a
    submission's completed events may be the one. The batch twin
    ``operators.submissions.first_completed`` picks by event time and agrees on
    which submissions completed.
    """
    timed = completed_events(events).withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["submission_id"])


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Processes what is there now and stops. The file sink commits each batch exactly once."""
    (stream.writeStream.format("parquet").outputMode("append")
     .option("path", path).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


class EarliestEvent(StatefulProcessor):
    """Per submission: the least (ts, event_id) seen, a timer at its time, and whether it was given out.

    When the watermark passes the least event's time, nothing earlier can come in time, so the answer is given. Events
    behind the watermark are given out at once as late, whether or not they would have changed the answer.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.least = handle.getValueState("least", "micros bigint, event_id bigint, props string, given boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        edge = timerValues.getCurrentWatermarkInMs() * 1000
        known = self.least.get() if self.least.exists() else None
        best = known
        for batch in rows:
            late = batch[batch["micros"] < edge]
            if len(late):
                yield self._out(late, "late")
            in_time = batch[batch["micros"] >= edge]
            if len(in_time) and not (known and known[3]):
                first = in_time.sort_values(["micros", "event_id"]).iloc[0]
                found = (int(first["micros"]), int(first["event_id"]), first["props"], False)
                best = found if best is None or found[:2] < tuple(best[:2]) else best
        if best is not known:
            if known is not None:
                self.handle.deleteTimer(_due(known[0]))
            self.least.update(tuple(best))
            self.handle.registerTimer(_due(best[0]))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        micros, event_id, props, given = self.least.get()
        if not given:
            # The mark stays, so that a later event is no second answer.
            self.least.update((micros, event_id, None, True))
            yield self._out(pd.DataFrame({"submission_id": [key[0]], "event_id": [event_id], "micros": [micros], "props": [props]}), "first")

    def close(self) -> None:
        pass

    @staticmethod
    def _out(rows: pd.DataFrame, kind: str) -> pd.DataFrame:
        return rows[["submission_id", "event_id", "micros", "props"]].assign(kind=kind)


def _due(micros: int) -> int:
    """The first whole millisecond at which no event of that time can still come."""
    return micros // 1000 + 1


def earliest_completed_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(submission_id, event_id, ts, props, kind): per submission the earliest completed event by (ts, event_id), once.

    ``kind`` is ``first`` for the answer, given when the watermark has passed its time, and ``late`` for each event that came
    behind the watermark: a reject, so that no event goes unseen. Over events that come within ``delay`` of the newest
    one, ``first`` rows equal ``operators.submissions.first_completed`` whatever the order of files. Needs the RocksDB state store
    (``keyed_state``); the state is one small row per submission. Answers of the last ``delay`` are given when time moves on.
    """
    clock = completed_events(events).withColumn("_clock", F.col("ts").cast("timestamp")).withWatermark("_clock", delay)
    # Without the clock's column Spark does not drop late rows, so the processor sees them.
    keyed = clock.select("submission_id", "event_id", F.unix_micros("_clock").alias("micros"), "props")
    found = keyed.groupBy("submission_id").transformWithStateInPandas(
        EarliestEvent(), "submission_id bigint, event_id bigint, micros bigint, props string, kind string", "append", "eventTime")
    return found.select("submission_id", "event_id", F.timestamp_micros("micros").cast("timestamp_ntz").alias("ts"), "props", "kind")


def keyed_state(spark: SparkSession) -> None:
    """Sets the state store that keyed state and timers need; call it before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
