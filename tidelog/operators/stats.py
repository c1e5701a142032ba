"""The Stats row of each queue, and reclaiming of committed segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reclaim(headers: DataFrame, cursors: DataFrame, queue: str = "queue_id") -> DataFrame:
    """Adds dropped: the segment is wholly committed and not the active one."""
    active = headers.groupBy(queue).agg(F.max("segment").alias("_active"))
    met = headers.join(active, queue).join(cursors.select(queue, "commit_off"), queue)
    return met.withColumn("dropped", (F.col("base") + F.col("size") <= F.col("commit_off")) & (F.col("segment") != F.col("_active"))).drop("_active", "commit_off")


def disk(headers: DataFrame, segment_size: int, max_bytes: int = 0, queue: str = "queue_id") -> DataFrame:
    """Segments and DiskBytes of live segments; with a byte cap also whether the promised bound holds."""
    out = headers.groupBy(queue).agg(F.count("*").alias("segments"), F.sum(F.col("capacity") + 64).cast("long").alias("disk_bytes"))
    bound = F.lit(max_bytes + 2 * segment_size) + 64 * F.col("segments")
    return out.withColumn("within_bound", F.lit(True) if not max_bytes else F.col("disk_bytes") <= bound)


def stats(frames: DataFrame, headers: DataFrame, cursors: DataFrame, max_segments: int = 0, max_bytes: int = 0, sync_every: int = 1, queue: str = "queue_id") -> DataFrame:
    """Gauges, configuration and counters of each queue; one pass over records, one over segments. Bytes are
    unsynced behind the last of every `sync_every` appends. Refusals and failed deletions are counted by a log
    that lives, see counters() for the former."""
    c = cursors
    live = reclaim(headers, cursors, queue).filter(~F.col("dropped")).groupBy(queue).agg(F.count("*").alias("segments"), F.sum(F.col("capacity") + 64).cast("long").alias("disk_bytes"))
    rows = frames.join(c, queue).groupBy(queue).agg(
        F.max(F.col("write_off") - F.col("commit_off")).alias("backlog_bytes"),
        F.count_if(F.col("end_off") > F.col("commit_off")).alias("backlog"),
        F.max(F.greatest(F.col("head_off") - F.col("commit_off"), F.lit(0).cast("long"))).alias("in_flight_bytes"),
        F.count("*").alias("added"),
        F.count_if(F.col("end_off") <= F.col("head_off")).alias("delivered"),
        F.count_if(F.col("end_off") <= F.col("commit_off")).alias("committed"),
        F.coalesce(F.sum(F.when(F.col("seq") >= F.col("n") - F.col("n") % sync_every, F.col("framed_len"))), F.lit(0).cast("long")).alias("unsynced_bytes"),
    )
    return rows.join(live, queue).select("*", F.lit(max_segments).cast("long").alias("max_segments"), F.lit(max_bytes).cast("long").alias("max_bytes"))


def counters(operations: DataFrame, queue: str = "queue_id") -> DataFrame:
    """Added, Delivered, Committed and Full from a log of operations (op, n): a requeue adds, delivers and
    commits; a skip delivers and commits; a refused add counts under Full only."""
    total = lambda *ops: F.coalesce(F.sum(F.when(F.col("op").isin(*ops), F.col("n"))), F.lit(0)).cast("long")
    return operations.groupBy(queue).agg(total("add", "requeue").alias("added"), total("take", "reserve", "skip", "requeue").alias("delivered"), total("take", "commit", "skip", "requeue").alias("committed"), total("refused").alias("full"))
