"""Durability accounting: exposure between flushes and header writes of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unsynced(frames: DataFrame, sync_every: int, queue: str = "queue_id") -> DataFrame:
    """Adds unsynced_bytes after each append: bytes since the last flush, 0 where the append is the flush.

    Each append is one operation, so the window is bounded by sync_every records.
    """
    w = Window.partitionBy(queue, F.expr(f"seq div {sync_every}")).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("unsynced_bytes", F.when(F.col("seq") % sync_every == sync_every - 1, F.lit(0)).otherwise(F.sum("framed_len").over(w)).cast("long"))


def header_writes(frames: DataFrame, queue: str = "queue_id") -> DataFrame:
    """Spans of one AddBatch of all records under per-operation durability, and its header writes.

    A span ends at each segment crossing and at the end; a crossing also writes the new segment's header.
    """
    out = frames.groupBy(queue).agg(F.countDistinct("segment").alias("spans"))
    return out.select(queue, "spans", (2 * (F.col("spans") - 1) + 1).alias("header_writes"))
