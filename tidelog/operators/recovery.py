"""Corruption accounting and recovery decisions, over frames and segment headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verdicts of opening a segment, in the order the conditions are tested.
VERDICTS = ["REMOVED", "DROPPED", "SALVAGED", "FOREIGN", "MISMATCH", "TRUNCATED", "REPAIRED", "ACCEPTED"]


def bad_payloads(frames: DataFrame, bad: Column, queue: str = "queue_id") -> DataFrame:
    """A checksum mismatch loses one record and is reported once."""
    return frames.groupBy(queue).agg(F.count_if(~bad).alias("delivered"), F.count_if(bad).alias("lost_records"), F.coalesce(F.sum(F.when(bad, F.col("framed_len"))), F.lit(0).cast("long")).alias("lost_bytes"), F.count_if(bad).alias("corruptions"))


def bad_framing(frames: DataFrame, bad: Column, queue: str = "queue_id") -> DataFrame:
    """A length that cannot be read loses the rest of its segment: per segment what is delivered and lost."""
    out = frames.groupBy(queue, "segment").agg(F.min(F.when(bad, F.col("start_off"))).alias("cut"), F.max("end_off").alias("end"))
    met = frames.join(out.select(queue, "segment", "cut", "end"), [queue, "segment"])
    lost = F.col("cut").isNotNull()
    return met.groupBy(queue, "segment").agg(
        F.count_if(F.col("cut").isNull() | (F.col("start_off") < F.col("cut"))).alias("delivered"),
        F.coalesce(F.max(F.col("end") - F.col("cut")), F.lit(0).cast("long")).alias("lost_bytes"),
        F.max(F.when(lost, 1).otherwise(0)).cast("long").alias("lost_segments"),
    )


def verified_prefix(frames: DataFrame, bad: Column, queue: str = "queue_id") -> DataFrame:
    """A torn header is rebuilt from the longest prefix of whole, verified frames; its commit cursor goes back
    to the segment's start, so the whole prefix is replayed."""
    first = frames.groupBy(queue, "segment").agg(F.min(F.when(bad, F.col("seq"))).alias("_bad"))
    on = F.col("_bad").isNull() | (F.col("seq") < F.col("_bad"))
    met = frames.join(first, [queue, "segment"])
    zero = F.lit(0).cast("long")
    return met.groupBy(queue, "segment").agg(F.min("base").alias("commit_off"), F.count_if(on).alias("replayed"), F.coalesce(F.sum(F.when(on, F.col("framed_len"))), zero).alias("replayed_bytes"))


def truncated(frames: DataFrame, cuts: DataFrame, queue: str = "queue_id") -> DataFrame:
    """`cuts` (queue, segment, cut offset): whole frames below the cut survive; the rest is counted."""
    met = frames.join(cuts, [queue, "segment"])
    on = F.col("end_off") <= F.col("cut")
    return met.groupBy(queue, "segment", "cut").agg(F.count_if(on).alias("survivors"), F.count_if(~on).alias("lost_records"), F.coalesce(F.sum(F.when(~on, F.col("framed_len"))), F.lit(0).cast("long")).alias("discarded_bytes"))


def verdicts(headers: DataFrame, seg_size: int) -> DataFrame:
    """The decision on each segment found on opening, one CASE over its header."""
    sql = f"""CASE
      WHEN file_len = 0 AND tail THEN 'REMOVED'
      WHEN file_len = 0 THEN 'DROPPED'
      WHEN hdr_len < 64 THEN 'DROPPED'
      WHEN NOT magic_ok AND tail AND all_zero THEN 'REMOVED'
      WHEN NOT magic_ok THEN 'DROPPED'
      WHEN NOT header_ok AND version = 1 THEN 'SALVAGED'
      WHEN NOT header_ok THEN 'DROPPED'
      WHEN version <> 1 THEN 'FOREIGN'
      WHEN seg_size <> {seg_size} THEN 'MISMATCH'
      WHEN file_len < 64 + capacity AND write_cursor > file_len THEN 'TRUNCATED'
      WHEN file_len < 64 + capacity THEN 'REPAIRED'
      ELSE 'ACCEPTED' END"""
    return headers.withColumn("verdict", F.expr(sql))


def recovered_cursor(headers: DataFrame, queue: str = "queue_id") -> DataFrame:
    """The commit cursor: in the first segment whose own cursor is short of its end, else the write offset."""
    short = F.col("commit_cursor") < F.col("size") + 64
    first = F.min(F.when(short, F.struct("segment", (F.col("base") + F.col("commit_cursor") - 64).alias("off"))))
    return headers.groupBy(queue).agg(F.coalesce(first["off"], F.max(F.col("base") + F.col("size"))).cast("long").alias("commit_off"), F.sum("size").cast("long").alias("write_off"))


def reconciled_counts(headers: DataFrame, recovered: DataFrame, queue: str = "queue_id") -> DataFrame:
    """Committed counts after recovery: all below the cursor, none above, the header's where it straddles."""
    met = headers.join(recovered.select(queue, "commit_off"), queue)
    end = F.col("base") + F.col("size")
    fixed = F.when(end <= F.col("commit_off"), F.col("written")).when(F.col("base") >= F.col("commit_off"), F.lit(0).cast("long")).otherwise(F.least("committed", "written"))
    return met.select(queue, "segment", "written", fixed.alias("committed"))


def replay(frames: DataFrame, cursors: DataFrame, queue: str = "queue_id") -> DataFrame:
    """Records delivered again after a crash: everything past the commit cursor."""
    return frames.join(cursors.select(queue, "commit_off"), queue).filter("end_off > commit_off")

