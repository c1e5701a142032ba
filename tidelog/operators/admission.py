"""Admission: which records a bounded queue accepts, and why it refuses others."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def batch_prefix(frames: DataFrame, max_bytes: int, queue: str = "queue_id") -> DataFrame:
    """AddBatch on an empty queue: per queue n_placed leading records and the reason it stopped.

    The running size is already in end_off, so this is one aggregation.
    """
    bad = F.col("end_off") > max_bytes
    first = F.min(F.when(bad, F.struct("seq", "framed_len")))
    out = frames.groupBy(queue).agg(F.count("*").alias("n"), first.alias("f"))
    reason = F.when(F.col("f").isNull(), "NONE").when(F.col("f.framed_len") > max_bytes, "TOO_LARGE").otherwise("FULL")
    return out.select(queue, F.coalesce("f.seq", "n").alias("n_placed"), reason.alias("reason"))


def greedy(frames: DataFrame, max_bytes: int, queue: str = "queue_id", id_column: str = "id") -> DataFrame:
    """A loop of Add without commits: per record OK, FULL or TOO_LARGE; a refused record changes nothing.

    Whether a record fits depends on all decisions before it, so a queue is one group in seq order.
    """

    def run(t):
        t = t.sort_by("seq").combine_chunks()
        size = t.column("framed_len").to_numpy()
        out, used = np.empty(len(size), dtype=object), 0
        for k, x in enumerate(size.tolist()):
            if x > max_bytes:
                out[k] = "TOO_LARGE"
            elif used + x > max_bytes:
                out[k] = "FULL"
            else:
                out[k] = "OK"
                used += x
        return t.append_column("admit", pa.array(out.tolist(), pa.string()))

    rows = frames.select(queue, id_column, "seq", "framed_len")
    return rows.groupBy(queue).applyInArrow(run, T.StructType([*rows.schema.fields, T.StructField("admit", T.StringType())]))


def first_refused_by_segments(frames: DataFrame, max_segments: int, queue: str = "queue_id") -> DataFrame:
    """Per queue the first record that would need one segment too many, nothing being committed; -1: none."""
    over = F.min(F.when(F.col("segment") - F.col("_least") >= max_segments, F.col("seq")))
    least = frames.groupBy(queue).agg(F.min("segment").alias("_least"))
    return frames.join(least, queue).groupBy(queue).agg(F.coalesce(over, F.lit(-1).cast("long")).alias("first_refused"))
