"""Binary segment files: a 64-byte header and checksummed frames, read and written byte for byte.

Files are read through Spark's binaryFile source, one segment per row, and walked in Arrow batches; a
segment is a few megabytes, so a task holds one at a time. Damage becomes rows, never an error: a payload
that fails its checksum is one lost record, a length that cannot be read loses the rest of its segment.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the file format.
MAGIC = b"WALGOseg"
VERSION = 1
HEADER = 64
SUM = 8


def _xxh(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data)


def uvarint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def encode_frame(payload: bytes) -> bytes:
    return uvarint(len(payload)) + payload + struct.pack("<Q", _xxh(payload))


def decode_frame(data: bytes, at: int, end: int) -> tuple[str, int, bytes]:
    """Status OK, BAD_SUM or BAD_FRAME, end of the frame, payload."""
    size = shift = 0
    for k in range(at, min(at + 10, end)):
        size |= (data[k] & 0x7F) << shift
        shift += 7
        if data[k] < 0x80:
            body = k + 1
            stop = body + size + SUM
            if stop > end:
                break
            payload = data[body : body + size]
            good = struct.unpack_from("<Q", data, body + size)[0] == _xxh(payload)
            return "OK" if good else "BAD_SUM", stop, payload
    return "BAD_FRAME", end, b""


@dataclass
class Header:
    commit_cursor: int = HEADER
    write_cursor: int = HEADER
    written: int = 0
    committed: int = 0
    capacity: int = 4096
    seg_size: int = 4096
    version: int = VERSION
    magic_ok: bool = True
    header_ok: bool = True

    def pack(self) -> bytes:
        flags = 1 if self.capacity > self.seg_size else 0
        head = MAGIC + struct.pack("<QQQQBBQ", self.commit_cursor, self.write_cursor, self.written, self.committed, self.version, flags, self.capacity)
        head += self.seg_size.to_bytes(6, "little")
        return head + struct.pack("<Q", _xxh(head))

    @staticmethod
    def unpack(data: bytes) -> "Header":
        c, w, n, k, version, _, capacity = struct.unpack_from("<QQQQBBQ", data, 8)
        good = struct.unpack_from("<Q", data, 56)[0] == _xxh(data[:56])
        return Header(c, w, n, k, capacity, int.from_bytes(data[50:56], "little"), version, data[:8] == MAGIC, good)


def encode_segment(payloads: list[bytes], seg_size: int = 4096, committed: int = 0) -> bytes:
    """One segment file of these records, filled up with zeros to its capacity."""
    frames = [encode_frame(p) for p in payloads]
    body = b"".join(frames)
    capacity = max(seg_size, len(body))
    head = Header(HEADER + sum(map(len, frames[:committed])), HEADER + len(body), len(frames), committed, capacity, seg_size)
    return head.pack() + body + b"\0" * (capacity - len(body))


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "data.*").load(path)
    number = F.regexp_extract("path", r"/data\.(\d+)$", 1)
    named = files.withColumn("_n", number).filter("_n <> ''").withColumn("segment", F.col("_n").cast("long"))
    # data.7 is inert beside data.00000007 and data.123456789 is canonical
    return named.filter(F.lpad(F.col("segment").cast("string"), 8, "0") == F.col("_n")).select("segment", "length", "content")


def _empty_files(spark: SparkSession, path: str) -> list[int]:
    """Segments whose file holds nothing; Spark's file sources pass over them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    names = [s.getPath().getName() for s in listed if s.isFile() and not s.getLen()]
    return [int(n[5:]) for n in names if n.startswith("data.") and n[5:].isdigit() and n == f"data.{int(n[5:]):08d}"]


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per segment file, with what opening it tests (see operators.recovery.verdicts)."""

    def run(batches):
        for b in batches:
            rows = []
            for n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = Header.unpack(data) if len(data) >= HEADER else Header(0, 0, 0, 0, 0, 0, 0, False, False)
                rows.append((n, len(data), min(len(data), HEADER), not data.strip(b"\0"), h.magic_ok, h.header_ok, h.version, h.seg_size, h.capacity, h.write_cursor, h.commit_cursor, h.written, h.committed))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 13, names=[x.split()[0] for x in schema.split(", ")])

    schema = "segment long, file_len long, hdr_len long, all_zero boolean, magic_ok boolean, header_ok boolean, version long, seg_size long, capacity long, write_cursor long, commit_cursor long, written long, committed long"
    found = _files(spark, path).select("segment", "content").mapInArrow(run, schema)
    found = found.unionByName(spark.createDataFrame([(n, 0, 0, True, False, False, 0, 0, 0, 0, 0, 0, 0) for n in _empty_files(spark, path)], schema))
    last = found.agg(F.max("segment").alias("_last"))
    return found.crossJoin(F.broadcast(last)).withColumn("tail", F.col("segment") == F.col("_last")).drop("_last")  # one row


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """segment, idx, start, end (in the file), status, payload of every frame up to the write cursor."""

    def run(batches):
        for b in batches:
            for n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(data) < HEADER or data[:8] != MAGIC:
                    continue
                head = Header.unpack(data)
                # a torn header of a known version is rebuilt from its frames: walk the verified prefix
                end = min(head.write_cursor, len(data)) if head.header_ok else len(data)
                at, rows = HEADER, []
                while at < end:
                    status, stop, payload = decode_frame(data, at, end)
                    if not head.header_ok and (status != "OK" or not payload and stop == at + 9 and not any(data[at:])):
                        break
                    rows.append((n, len(rows), at, stop, status, payload))
                    at = stop
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["segment", "idx", "start", "end", "status", "payload"])

    return _files(spark, path).select("segment", "content").mapInArrow(run, "segment long, idx long, start long, end long, status string, payload binary")


def write_segments(frames: DataFrame, path: str, seg_size: int) -> DataFrame:
    """Encode records (columns segment, seq, payload) into one file image per segment: segment, file_name, content.

    The images are rows, so any sink can store them; a segment is a group of bounded size.
    """

    def run(t):
        t = t.sort_by("seq")
        n = t.column("segment")[0].as_py()
        image = encode_segment([p or b"" for p in t.column("payload").to_pylist()], seg_size)
        return pa.table({"segment": [n], "file_name": [f"{path}/data.{n:08d}"], "content": pa.array([image], pa.binary())})

    rows = frames.select("segment", "seq", F.col("payload").cast("binary").alias("payload"))
    return rows.groupBy("segment").applyInArrow(run, "segment long, file_name string, content binary")
