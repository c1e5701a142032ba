"""Best-fit-decreasing packing of token sequences, exact over the whole table.

Lengths are integers from 1 to the capacity, so open bins with equal room are interchangeable: the whole
packing is settled on at most `capacity` length counts. A segment tree over remaining capacities finds the
tightest open bin, whole runs of equal lengths are placed at once, and the plan that results has a size
bounded by the capacity, not by the data. Pieces then find their bin by their rank within their length;
ranks come from salted groups, so one very common length does not meet in one task.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import staged
from .tokenize import load

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class RoomTree:
    """Segment tree over rooms 0..capacity: which rooms have an open bin; tightest(n) in O(log capacity)."""

    def __init__(self, capacity: int):
        self.n = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.n)

    def set(self, room: int, on: bool) -> None:
        i = room + self.n
        self.any[i] = on
        i >>= 1
        while i:
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]
            i >>= 1

    def tightest(self, need: int) -> int:
        """Smallest room >= need with an open bin, or -1."""
        i = need + self.n
        if self.any[i]:
            return need
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.n
            i >>= 1
        return -1


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first_rank, n, first_bin, offset): ranks first_rank.. of that length go to bins
    first_bin.. one each, at that offset. Best fit decreasing, ties to the bin opened in a run last."""
    tree = RoomTree(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = {}
    rows, n_bins = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room:
            runs = open_bins.setdefault(room, [])
            if not runs:
                tree.set(room, True)
            if runs and runs[-1][0] + runs[-1][1] == first:
                runs[-1] = (runs[-1][0], runs[-1][1] + n)
            else:
                runs.append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                each = capacity // length  # new bins are filled with this length to the brim, one by one
                full, rest = divmod(left, each)
                for k in range(each):
                    n = full + (k < rest)
                    if n and full:
                        rows.append((length, rank, full, n_bins, k * length))
                        rank += full
                if full:
                    put(capacity - each * length, n_bins, full)
                for k in range(rest):
                    rows.append((length, rank, 1, n_bins + full, k * length))
                    rank += 1
                if rest:
                    put(capacity - rest * length, n_bins + full, 1)
                n_bins += full + bool(rest)
                left = 0
            else:
                runs = open_bins[room]
                first, n = runs.pop()
                take = min(n, left)
                if take < n:
                    runs.append((first + take, n - take))
                if not runs:
                    tree.set(room, False)
                rows.append((length, rank, take, first, capacity - room))
                put(room - length, first, take)
                rank, left = rank + take, left - take
    return rows


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document's ids (null text: empty), `end_id` last.

    A document longer than `capacity` is cut so that every piece but the first is full. `with_ids` adds
    column ids (array of int). Only doc_id and text are read, so other columns cannot clash.
    """
    schema = T._parse_datatype_string(PIECES)
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        bpe = load(tokenizer_path)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            cols: list[list] = [[] for _ in schema.fields]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.concatenate([bpe.ids(text or "").astype("<u4"), end])
                stop = len(ids) % capacity or min(capacity, len(ids))
                start = piece = 0
                while start < len(ids):
                    part = ids[start:stop]
                    row = (doc_id, piece, start, len(part), zlib.crc32(part.tobytes()))
                    for col, value in zip(cols, (*row, part.astype(np.int32)) if with_ids else row):
                        col.append(value)
                    start, stop, piece = stop, stop + capacity, piece + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=schema.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def assign_bins(pieces: DataFrame, capacity: int = 2048, rows_per_group: int | None = None) -> DataFrame:
    """Columns sequence_id and offset added to pieces (column length, 1..capacity) by best fit decreasing.

    `pieces` is read three times; pass a staged table. A length with more than `rows_per_group` pieces, by
    default the square root of all, is split by a salt; the driver gets one count per length and salt.
    """
    keys = [c for c in pieces.columns if c != "ids"]
    total = pieces.count()
    rows_per_group = rows_per_group or max(500, math.isqrt(total))
    salts = max(1, -(-total // rows_per_group))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int"))
    per_length = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # a length commoner than a group keeps its salts; a rarer one needs a single group
    hot = [length for length, n in per_length.items() if n > rows_per_group]
    salted = salted.withColumn("_salt", F.when(F.col("length").isin(hot), F.col("_salt")).otherwise(F.lit(0)))
    firsts: dict[tuple[int, int], int] = {}
    if hot:
        seen: dict[int, int] = {}
        counts = salted.filter(F.col("length").isin(hot)).groupBy("length", "_salt").agg(F.count("*").alias("n"))
        for r in sorted(counts.collect()):
            firsts[r["length"], r["_salt"]] = seen.get(r["length"], 0)
            seen[r["length"]] = seen.get(r["length"], 0) + r["n"]
    plan = np.array(plan_bins(per_length, capacity), dtype=np.int64).reshape(-1, 5)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    base = 1 + int(plan[:, 2].sum(initial=0))
    sent = pieces.sparkSession.sparkContext.broadcast((plan, plan[:, 0] * base + plan[:, 1], firsts))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = pieces.columns

    def run(batches):
        plan, starts, firsts = sent.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            salt = batch.column("_salt").to_numpy()
            rank = batch.column("_rank").to_numpy() - 1
            if firsts:
                rank = rank + np.array([firsts.get(k, 0) for k in zip(length.tolist(), salt.tolist())], dtype=np.int64)
            at = np.searchsorted(starts, length * base + rank, side="right") - 1
            row = plan[at]
            out = [batch.column(n) for n in names]
            out += [pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    order = [F.col(k).asc_nulls_last() for k in keys if k != "length"]
    from pyspark.sql import Window

    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)).cast("long"))
    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Best-fit packing of whole documents into sequences of at most `capacity` tokens.

    Null and empty texts are the end id alone; repeated rows and repeated or null ids are packed each on
    their own; ties between pieces of one length go by doc_id, piece; an empty table gives no rows.
    """
    return assign_bins(staged(cut_pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pieces"), capacity)
