"""Arbitrary state by key over streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGES = "user_id long, from_type string, to_type string, changes long"


class _Changes(StatefulProcessor):
    """Holds a user's last event type and the number of changes so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "event_type string, changes long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kind, changes = self._last.get() if self._last.exists() else (None, 0)
        out = []
        arrived = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for now in arrived["event_type"]:
            if kind is not None and now != kind:
                changes += 1
                out.append((key[0], kind, now, changes))
            kind = now
        self._last.update((kind, changes))
        yield pd.DataFrame(out, columns=["user_id", "from_type", "to_type", "changes"])

    def close(self) -> None:
        pass


def type_changes(events: DataFrame) -> DataFrame:
    """A row for each change of a user's event type in a stream of (event_id, ts, user_id, event_type): from what, to
    what, and which of the user's changes it is. Events of a batch are put in order; ones that come in a later batch
    count as later. The state is one row per user. Needs the state store provider for RocksDB."""
    narrow = events.where("user_id is not null and event_type is not null").select("event_id", "ts", "user_id", "event_type")
    return narrow.groupBy("user_id").transformWithStateInPandas(_Changes(), CHANGES, "Append", "None")
