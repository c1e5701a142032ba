"""Consumption: commits, out-of-order acknowledgements, rewind, skip, requeue, drains and reader groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frontier(ledger: DataFrame, commit_off: Column | int = 0, queue: str = "queue_id", span: int = 1 << 26) -> DataFrame:
    """Per queue the end of the longest run of acknowledged, adjoining reservations from the commit cursor on.

    `ledger` has start_off, end_off, acked; a gap stops the run as an unacknowledged entry does. Entries are
    cut into spans of `span` bytes by their end, so a long ledger is spread over tasks; the first of a span
    follows the last of the spans before.
    """
    base = F.lit(commit_off) if isinstance(commit_off, int) else commit_off
    live = ledger.withColumn("_c", base.cast("long")).filter("end_off > _c").withColumn("_span", F.floor(F.col("end_off") / span))
    earlier = Window.partitionBy(queue).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    ends = live.groupBy(queue, "_span").agg(F.max("end_off").alias("_e"))
    ends = ends.select(F.col(queue).alias("_q"), F.col("_span").alias("_s"), F.max("_e").over(earlier).alias("_before"))
    w = Window.partitionBy(queue, "_span").orderBy("end_off")
    marked = live.withColumn("_lag", F.lag("end_off").over(w)).join(ends, (F.col(queue) == F.col("_q")) & (F.col("_span") == F.col("_s")))
    previous = F.coalesce("_lag", "_before", "_c")
    marked = marked.withColumn("_stop", F.when(~F.col("acked") | (F.col("start_off") > previous), previous))
    return marked.groupBy(queue).agg(F.coalesce(F.min("_stop"), F.max("end_off")).alias("frontier"))


def commit(frames: DataFrame, asked: DataFrame, cursors: DataFrame, queue: str = "queue_id") -> DataFrame:
    """Prefix commits (columns queue, off): status OK, NOOP or INVALID and the commit cursor that results.

    An offset inside a record rounds down to its start.
    """
    from .layout import lookup

    c = cursors.select(queue, "commit_off", "head_off")
    known = asked.join(c, queue).dropDuplicates([queue, "off"])
    inside = lookup(frames, known.select(queue, "off"), queue, columns=("start_off", "end_off"))
    met = known.join(inside, [queue, "off"], "left")
    status = F.when(F.col("off") > F.col("head_off"), "INVALID").when(F.col("off") <= F.col("commit_off"), "NOOP").otherwise("OK")
    landed = F.greatest(F.coalesce(F.col("start_off"), F.col("off")), F.col("commit_off"))
    return met.select(queue, "off", status.alias("status"), F.when(status == "OK", landed).otherwise(F.col("commit_off")).alias("commit_off"))


def classify_acks(ledger: DataFrame, asked: DataFrame, cursors: DataFrame, queue: str = "queue_id") -> DataFrame:
    """AckBatch: each offset is RETIRED (at or before the commit cursor), ACKED (a reservation) or INVALID."""
    c = cursors.select(queue, "commit_off", "head_off")
    known = ledger.select(queue, F.col("end_off").alias("off"), F.lit(True).alias("_in"))
    met = asked.join(c, queue).join(known, [queue, "off"], "left")
    verdict = F.when(F.col("off") > F.col("head_off"), "INVALID").when(F.col("off") <= F.col("commit_off"), "RETIRED").when(F.col("_in"), "ACKED").otherwise("INVALID")
    return met.select(queue, "off", verdict.alias("verdict"))


def with_cursors(frames: DataFrame, cursors: DataFrame, queue: str = "queue_id") -> DataFrame:
    return frames.join(cursors, queue)


def in_flight(frames: DataFrame, cursors: DataFrame, queue: str = "queue_id") -> DataFrame:
    """Bytes and records read but not committed; also what Rewind makes readable again."""
    met = with_cursors(frames, cursors, queue)
    on = (F.col("start_off") >= F.col("commit_off")) & (F.col("end_off") <= F.col("head_off"))
    return met.groupBy(queue).agg(F.coalesce(F.sum(F.when(on, F.col("framed_len"))), F.lit(0).cast("long")).alias("bytes"), F.count_if(on).alias("records"))


def requeue(frames: DataFrame, rotations: int, queue: str = "queue_id") -> DataFrame:
    """Each of the first `rotations` heads is appended to the tail, then retired: adds new_seq."""
    n = frames.groupBy(queue).agg(F.count("*").alias("_n"))
    met = frames.join(n, queue)
    return met.withColumn("new_seq", F.when(F.col("seq") < rotations, F.col("seq") + F.col("_n")).otherwise(F.col("seq"))).drop("_n")


def skip(frames: DataFrame, skipped: Column) -> DataFrame:
    """Records delivered when those for which `skipped` holds are discarded undecoded."""
    return frames.filter(~skipped)


def take(frames: DataFrame, k: int, queue: str = "queue_id") -> DataFrame:
    """The first k records of each queue; seq is stored, so no sort is needed."""
    return frames.filter(F.col("seq") < k)


def peek(frames: DataFrame, cursors: DataFrame, queue: str = "queue_id") -> DataFrame:
    """The record at the head of each queue."""
    return with_cursors(frames, cursors, queue).filter("start_off = head_off")


def drain(frames: DataFrame, snapshot: Column) -> DataFrame:
    """Records present when the drain began: those below the write offset seen then."""
    return frames.filter(F.col("end_off") <= snapshot)


def cooperate(frames: DataFrame, readers: int) -> DataFrame:
    """Readers of one queue share its cursor; in turn each gets the next record."""
    return frames.withColumn("reader", F.col("seq") % readers)
