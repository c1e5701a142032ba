"""Offsets and segments of a log: one totally ordered queue per queue_id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER_BYTES = 64


def with_offsets(rows: DataFrame, order: str, queue: str = "queue_id", chunk: int = 1_000_000) -> DataFrame:
    """Adds seq, start_off, end_off: place and byte offsets in the queue by integer column `order`.

    Running values are taken in two steps, within and across chunks of the order, so that one long queue is
    spread over tasks; only one row per chunk is ordered as a whole.
    """
    parted = rows.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)))
    before = Window.partitionBy(queue).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = parted.groupBy(queue, "_chunk").agg(F.count("*").alias("_k"), F.sum("framed_len").alias("_b"))
    zero = F.lit(0).cast("long")
    bases = sums.select(queue, "_chunk", F.coalesce(F.sum("_k").over(before), zero).alias("_first"), F.coalesce(F.sum("_b").over(before), zero).alias("_base"))
    within = Window.partitionBy(queue, "_chunk").orderBy(order)
    out = parted.withColumn("_rank", F.row_number().over(within)).withColumn("_upto", F.sum("framed_len").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(bases, [queue, "_chunk"])
    end = F.col("_base") + F.col("_upto")
    return out.withColumn("seq", F.col("_first") + F.col("_rank") - 1).withColumn("start_off", end - F.col("framed_len")).withColumn("end_off", end).drop("_chunk", "_rank", "_upto", "_first", "_base")


def segment_starts(start: np.ndarray, end: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Next-fit: (first record, segment number, capacity) of each segment, by one search per segment.

    A record that does not fit behind the others opens a segment of its own size at least; an oversized
    first record finds segment 1 empty and fully committed, so segment 1 vanishes and it opens segment 2.
    """
    out, n, at, number = [], len(start), 0, 1
    if n and end[0] - start[0] > size:
        number = 2
    while at < n:
        room = max(size, int(end[at] - start[at]))
        out.append((at, number, room))
        at = int(np.searchsorted(end, start[at] + room, side="right"))
        number += 1
    return out


def chunk_passes(start: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Next-fit through one chunk of a queue for every limit it can be entered with.

    The limit is where the segment open so far is full; the first record that ends beyond it opens the next.
    A limit lies less than `size` beyond the chunk's first byte, so few records can be that first one. For
    each: its end, the segments opened in the chunk, and the last one's base and limit.
    """
    n = len(start)
    entries = np.arange(min(n, int(np.searchsorted(end, start[0] + size, side="left")) + 1))
    following = np.searchsorted(end, start + np.maximum(size, end - start), side="right")
    at, opened = entries.copy(), np.ones(len(entries), dtype=np.int64)
    while True:
        on = np.flatnonzero(following[at] < n)
        if not len(on):
            break
        at[on] = following[at[on]]
        opened[on] += 1
    return end[entries], opened, start[at], start[at] + np.maximum(size, end[at] - start[at])


def with_segments(frames: DataFrame, segment_size: int, queue: str = "queue_id", chunk: int = 250_000) -> DataFrame:
    """Adds segment, capacity, base. Next-fit packing is a fold in queue order, taken in three steps so that one
    long queue is spread over tasks: each chunk of `chunk` records tells what becomes of every limit it can be
    entered with; a queue's chunks, a few rows each, are folded; each chunk then marks its own segments."""
    kind = frames.schema[queue].dataType
    parted = frames.withColumn("_chunk", F.floor(F.col("seq") / chunk))
    keys = parted.select(F.col(queue).alias("_q"), "_chunk", F.col("seq").alias("_s"), "start_off", "end_off")
    longs = lambda *names: [T.StructField(n, T.LongType()) for n in names]

    def passes(t):
        t = t.sort_by("_s").combine_chunks()
        start, end = t.column("start_off").to_numpy(), t.column("end_off").to_numpy()
        till, opened, base, limit = chunk_passes(start, end, segment_size)
        same = lambda x: pa.array(np.full(len(till), x, dtype=np.int64))
        first = max(segment_size, int(end[0] - start[0]))
        return pa.table([pa.chunked_array([t.column("_q").chunk(0).take(pa.array(np.zeros(len(till), np.int64)))]), same(t.column("_chunk")[0].as_py()), pa.array(till), pa.array(opened), pa.array(base), pa.array(limit), same(start[0]), same(end[-1]), same(first)], names=["_q", "_chunk", "till", "opened", "base", "limit", "from", "upto", "first"])

    told = keys.groupBy("_q", "_chunk").applyInArrow(passes, T.StructType([T.StructField("_q", kind), *longs("_chunk", "till", "opened", "base", "limit", "from", "upto", "first")]))

    def fold(t):
        t = t.sort_by([("_chunk", "ascending"), ("till", "ascending")]).combine_chunks()
        chunks, till, opened, bases, limits, begin, upto, first = (t.column(c).to_numpy() for c in ("_chunk", "till", "opened", "base", "limit", "from", "upto", "first"))
        edge = np.flatnonzero(np.r_[True, chunks[1:] != chunks[:-1], True])
        rows, limit, number, base = [], None, 0, 0
        for a, b in zip(edge[:-1], edge[1:]):
            if limit is None:  # an oversized first record finds segment 1 empty: it opens segment 2
                limit, number = int(begin[a]), int(first[a] > segment_size)
            rows.append((int(chunks[a]), limit, number, base))
            if upto[a] > limit:
                k = a + int(np.searchsorted(till[a:b], limit, side="right"))
                number, base, limit = number + int(opened[k]), int(bases[k]), int(limits[k])
        cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
        return pa.table([t.column("_q").chunk(0).take(pa.array([0] * len(rows))), *cols], names=["_q", "_chunk", "limit", "number", "open_base"])

    entered = told.groupBy("_q").applyInArrow(fold, T.StructType([T.StructField("_q", kind), *longs("_chunk", "limit", "number", "open_base")]))
    entered = entered.select(F.col("_q").alias("_eq"), F.col("_chunk").alias("_ec"), "limit", "number", "open_base")

    def mark(t):
        t = t.sort_by("_s").combine_chunks()
        start, end, seq = t.column("start_off").to_numpy(), t.column("end_off").to_numpy(), t.column("_s").to_numpy()
        limit, number = t.column("limit")[0].as_py(), t.column("number")[0].as_py()
        at = int(np.searchsorted(end, limit, side="right"))
        found = [(k + at, number + i, int(start[k + at]), room) for k, i, room in ((k, i, room) for i, (k, _, room) in enumerate(segment_starts(start[at:], end[at:], segment_size), 1))]
        names = ["_q", "_s", "segment", "base", "capacity"]
        rows = [(int(seq[k]), n, base, room) for k, n, base, room in found]
        return pa.table([t.column("_q").chunk(0).take(pa.array([0] * len(rows), pa.int64())), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]], names=names)

    met = keys.join(entered, (F.col("_q") == F.col("_eq")) & (F.col("_chunk") == F.col("_ec")))
    starts = met.groupBy("_q", "_chunk").applyInArrow(mark, T.StructType([T.StructField("_q", kind), *longs("_s", "segment", "base", "capacity")]))
    # one row per segment; within a chunk records find theirs as the last start at or before them, and those
    # before a chunk's first start belong to the segment that was open when it was entered
    starts = starts.withColumn("_of", F.struct("segment", "base", "capacity")).select("_q", "_s", "_of")
    marks = parted.join(starts, (F.col(queue) == F.col("_q")) & (F.col("seq") == F.col("_s")), "left").drop("_q", "_s")
    upto = Window.partitionBy(queue, "_chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    plain = [c for c in frames.columns if c not in ("segment", "base", "capacity")]
    carry = F.struct(F.col("number").alias("segment"), F.col("open_base").alias("base"), (F.col("limit") - F.col("open_base")).alias("capacity"))
    out = marks.withColumn("_of", F.last("_of", ignorenulls=True).over(upto)).join(entered.withColumn("_carry", carry), (F.col(queue) == F.col("_eq")) & (F.col("_chunk") == F.col("_ec")))
    return out.withColumn("_of", F.coalesce("_of", "_carry")).select(*plain, "_of.segment", "_of.base", "_of.capacity")


def segment_headers(frames: DataFrame, cursors: DataFrame, segment_size: int, queue: str = "queue_id") -> DataFrame:
    """One row per segment: the state its header holds, cursors counted from the 64-byte header on."""
    met = frames.join(cursors.select(queue, "commit_off"), queue) if cursors is not None else frames
    out = met.groupBy(queue, "segment", "base", "capacity").agg(
        F.sum("framed_len").cast("long").alias("size"), F.count("*").alias("written"),
        F.count_if(F.col("end_off") <= F.col("commit_off")).alias("committed"),
        F.max(F.when(F.col("end_off") <= F.col("commit_off"), F.col("end_off"))).alias("_upto"),
    )
    return out.select(
        queue, "segment", "base", "size", "capacity", (F.col("capacity") > segment_size).alias("oversized"), "written", "committed",
        (F.col("size") + HEADER_BYTES).alias("write_cursor"),
        (F.coalesce(F.col("_upto") - F.col("base"), F.lit(0).cast("long")) + HEADER_BYTES).alias("commit_cursor"),
    )


def cursors(frames: DataFrame, commit_share: tuple[int, int] = (3, 5), head_share: tuple[int, int] = (4, 5), queue: str = "queue_id") -> DataFrame:
    """Per queue: n, commit_off, head_off, write_off after the first shares of its records are committed and read."""
    counts = frames.groupBy(queue).agg(F.count("*").alias("n"), F.max("end_off").alias("write_off"))
    met = frames.join(counts, queue)
    upto = lambda s: F.coalesce(F.max(F.when(F.col("seq") < F.expr(f"n * {s[0]} div {s[1]}"), F.col("end_off"))), F.lit(0).cast("long"))
    return met.groupBy(queue).agg(F.max("n").alias("n"), upto(commit_share).alias("commit_off"), upto(head_share).alias("head_off"), F.max("write_off").alias("write_off"))


def lookup(frames: DataFrame, offsets: DataFrame, queue: str = "queue_id", at: str = "off", columns: tuple[str, ...] = ("seq", "segment", "start_off", "end_off"), span: int = 1 << 26) -> DataFrame:
    """The record that holds each offset, as an as-of join: one sort of both sides, no range join.

    Both sides are cut into spans of `span` bytes, so a long queue is spread over tasks; a record that reaches
    into further spans stands in each of them.
    """
    left = offsets.select(queue, F.col(at).alias("_at"), F.floor(F.col(at) / span).alias("_span"), F.lit(1).alias("_side"), *[F.lit(None).cast("long").alias(c) for c in columns])
    spans = F.sequence(F.floor(F.col("start_off") / span), F.floor((F.col("end_off") - 1) / span))
    right = frames.select(queue, F.col("start_off").alias("_at"), F.explode(spans).alias("_span"), F.lit(0).alias("_side"), *columns)
    w = Window.partitionBy(queue, "_span").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).select(queue, "_at", "_side", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in columns])
    return both.filter("_side = 1 and _at < end_off").select(queue, F.col("_at").alias(at), *columns)
