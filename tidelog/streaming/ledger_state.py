"""The acknowledgement ledger as keyed state: reservations and acks in, commit frontier out."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Operations of a queue: reserve (start_off, end_off) or ack (end_off), in order of `at`.
INPUT = "queue_id string, at long, op string, start_off long, end_off long"
OUTPUT = "queue_id string, frontier long, outstanding long, invalid long"


class Ledger(StatefulProcessor):
    """State: the commit cursor, and outstanding reservations by their end; retired ones leave the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._cursor = handle.getValueState("cursor", "off long")
        self._held = handle.getMapState("held", "end_off long", "start_off long, acked boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        cursor = (self._cursor.get() or (0,))[0] if self._cursor.exists() else 0
        invalid = 0
        for r in sorted(rows, key=lambda r: r["at"]):
            if r["op"] == "reserve":
                self._held.updateValue((r["end_off"],), (r["start_off"], False))
            elif self._held.containsKey((r["end_off"],)):
                self._held.updateValue((r["end_off"],), (self._held.getValue((r["end_off"],))[0], True))
            elif r["end_off"] > cursor:
                invalid += 1
        held = sorted((k[0], v[0], v[1]) for k, v in self._held.iterator())
        left = len(held)
        for end, start, acked in held:
            if not acked or start > cursor:
                break
            cursor = end
            left -= 1
            self._held.removeKey((end,))
        self._cursor.update((cursor,))
        yield Row(queue_id=key[0], frontier=cursor, outstanding=left, invalid=invalid)

    def close(self) -> None:
        pass


def live_frontier(operations: DataFrame) -> DataFrame:
    """Frontier of each queue after every micro-batch; needs the RocksDB state store provider."""
    return operations.groupBy("queue_id").transformWithState(statefulProcessor=Ledger(), outputStructType=OUTPUT, outputMode="Update", timeMode="None")
