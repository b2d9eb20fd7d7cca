"""State that event time ends: alerts for keys that fall silent."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.operators.sessions import sessionize
from millrace.streaming.windows import _timed

ALERTS = "user_id long, first_ts timestamp, last_ts timestamp, n_events long, n_types long"


class _Silence(StatefulProcessor):
    """Per user the first and last time and, as a map, events by type since the last alert. One timer, behind the last event."""

    def __init__(self, idle_ms: int) -> None:
        self._idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._span = handle.getValueState("span", "first_ms long, last_ms long")
        self._types = handle.getMapState("types", "event_type string", "n long")

    def _alert(self, key: Any) -> pd.DataFrame:
        first, last = self._span.get()
        counts = [v[0] for v in self._types.values()]
        self._span.clear()
        self._types.clear()
        return pd.DataFrame({"user_id": [key[0]], "first_ts": pd.to_datetime([first], unit="ms"), "last_ts": pd.to_datetime([last], unit="ms"), "n_events": [sum(counts)], "n_types": [len(counts)]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = sorted((int(ms), kind) for batch in rows for ms, kind in zip(batch["ms"], batch["event_type"], strict=True))
        at = 0
        while at < len(events):
            span = self._span.get() if self._span.exists() else None
            # Events of one batch may lie on both sides of a silence.
            run, low, high = at, events[at][0], events[at][0]
            if span is not None:
                if low > span[1] + self._idle_ms:
                    yield self._alert(key)
                    span = None
                else:
                    low, high = min(span[0], low), max(span[1], high)
            counts: Counter = Counter()
            while run < len(events) and events[run][0] <= high + self._idle_ms:
                high = max(high, events[run][0])
                counts[events[run][1]] += 1
                run += 1
            for kind, n in counts.items():
                before = self._types.getValue((kind,))[0] if self._types.containsKey((kind,)) else 0
                self._types.updateValue((kind,), (before + n,))
            self._span.update((low, high))
            at = run
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        self._handle.registerTimer(self._span.get()[1] + self._idle_ms + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self._span.exists():
            yield self._alert(key)

    def close(self) -> None:
        pass


def silence_alerts(events: DataFrame, idle_seconds: int, lateness: str = "1 hour") -> DataFrame:
    """For each run of a user's events without a gap above idle_seconds (whole seconds), when it is over: user_id, its first
    and last time, how many events and how many types of events it had. events: user_id, ts, event_type.

    On a stream a run is over when the watermark has passed its last event by the gap. A timer of event time then ends the
    run and clears all of the user's state, so that only users of late have any. Events up to `lateness` behind count with
    the run they belong to. In a batch all runs are over. Rows without a user or a time are left out; a null type counts
    as one. The state needs the RocksDB provider."""
    known = events.where("user_id is not null and ts is not null").select("user_id", "ts", F.coalesce("event_type", F.lit("")).alias("event_type"))
    if not events.isStreaming:
        runs = sessionize(known.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", idle_seconds)
        return runs.groupBy("user_id", "session_no").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_events"), F.count_distinct("event_type").alias("n_types")).drop("session_no")
    timed = _timed(known, lateness, "ts").withColumn("ms", F.unix_millis("ts"))
    return timed.groupBy("user_id").transformWithStateInPandas(_Silence(1000 * idle_seconds), ALERTS, "Append", "EventTime")
