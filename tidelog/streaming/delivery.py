"""Delivery disciplines on Structured Streaming.

The stream's source is the log's folder of manifests: a record reaches a handler only when a manifest names it,
and what a crash left behind is never seen. The log's manifest, not the stream's checkpoint, says what is
committed: take writes the cursor before the rows are handed out (at most once), reserve after the handler
returns (at least once).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import DurableLog


def published(log: DurableLog) -> DataFrame:
    """The log's manifests as a stream: epoch, write_off, commit_off."""
    text = log.spark.readStream.option("wholetext", True).text(f"{log.path}/manifest")
    return text.select(F.from_json("value", "epoch long, write_off long, commit_off long").alias("m")).select("m.*")


def _start(log: DurableLog, each: Callable[[DataFrame], None], checkpoint: str, every: str | None) -> StreamingQuery:
    def batch(manifests: DataFrame, _: int) -> None:
        end = manifests.agg(F.max("write_off")).first()[0]
        if end is not None:
            with log._change:
                each(log.frames(max(log.head_off, log.state.commit_off)).filter(F.col("end_off") <= end))

    writer = published(log).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _seen(log: DurableLog, rows: DataFrame) -> int | None:
    """Moves the head past the rows; the offset behind them, None where there are none."""
    end, last, n = rows.agg(F.max("end_off"), F.max("seq"), F.count("*")).first()
    if not n:
        return None
    log.head_off, log.n_head = end, last + 1
    log.counters["delivered"] += n
    return end


def take(log: DurableLog, handler: Callable[[DataFrame], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """At most once: the cursor is committed before `handler` sees a batch. Without `every` this drains."""

    def each(rows: DataFrame) -> None:
        end = _seen(log, rows)
        if end is not None:
            log._commit_to(end, reclaim=False)
            handler(log.decoded(rows).filter("_ok").orderBy("seq"))

    return _start(log, each, checkpoint, every)


def reserve(log: DurableLog, handler: Callable[[DataFrame], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """At least once: the cursor is committed after `handler` has returned."""

    def each(rows: DataFrame) -> None:
        if rows.isEmpty():
            return
        handler(log.decoded(rows).filter("_ok").orderBy("seq"))
        end = _seen(log, rows)
        if end is not None:
            log._commit_to(end, reclaim=False)

    return _start(log, each, checkpoint, every)
