"""Opening a folder of binary segment files as a durable log: every whole record not yet committed moves over."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import codec, errors
from ..operators import recovery
from . import segment_files
from .store import DurableLog, Options


def restore(spark: SparkSession, folder: str, path: str, schema: str, options: Options | None = None) -> DurableLog:
    """A new log at `path` with the records of `folder` from each segment's commit cursor on, as they lie.

    Segments are judged as on opening: those of another version are dropped silently, those that cannot be
    read are dropped and owed as one report each; in the others a record that fails its checksum is lost
    alone, and a length that cannot be read loses the rest of its segment. A torn header gives its verified
    prefix, replayed from its start. Segments of another size are refused. An existing log is refused.
    """
    options = options or Options()
    size = codec.segment_capacity(options.segment_size)
    judged = recovery.verdicts(segment_files.read_headers(spark, folder), size).select("segment", "verdict", "file_len", "commit_cursor", "header_ok", "committed", "written")
    found = {r["segment"]: r for r in judged.collect()}  # one row per segment file
    if any(r["verdict"] == "MISMATCH" for r in found.values()):
        raise errors.SegmentSizeMismatch(f"{size} asked for")
    log = DurableLog(spark, path, schema, options)
    try:
        if log.state.epoch:
            raise errors.LogError(f"{path} holds a log already")
        frames = segment_files.read_frames(spark, folder)
        cursor = F.when(F.col("header_ok"), F.col("commit_cursor")).otherwise(segment_files.HEADER)
        usable = judged.filter(F.col("verdict").isin("SALVAGED", "TRUNCATED", "REPAIRED", "ACCEPTED")).select("segment", cursor.alias("from"))
        live = frames.join(usable, "segment").filter(F.col("start") >= F.col("from"))
        bad = live.filter("status <> 'OK'").groupBy("segment", "status").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bytes"), F.min("start").alias("start"), F.max("end").alias("end"))
        good = live.filter("status = 'OK'").select(
            F.lit("").alias("queue_id"), (F.col("segment") * (1 << 32) + F.col("idx")).alias("_order"), "payload",
            codec.framed_len(F.octet_length("payload")).alias("framed_len"), F.lit(None).cast("long").alias("_stamp"),
        )
        with log._change:
            log._append(good, forced=True)
        for r in bad.collect():  # at most two rows per segment file
            whole = r["status"] == "BAD_FRAME"
            log._lose("segment" if whole else "record", r["segment"], r["start"], r["end"], 0 if whole else r["n"])
            log.counters["lost_bytes"] += r["bytes"]
            log.counters["lost_segments" if whole else "lost_records"] += 1 if whole else r["n"]
            log.counters["corruptions"] += r["n"]
        for n, r in found.items():
            body = max(0, r["file_len"] - segment_files.HEADER)
            if r["verdict"] in ("DROPPED", "FOREIGN"):
                foreign = r["verdict"] == "FOREIGN"
                log._lose("foreign" if foreign else "dropped", n, 0, body, 0)
                log.counters["foreign_segments" if foreign else "lost_segments"] += 1
                log.counters["foreign_bytes" if foreign else "lost_bytes"] += body
            if r["verdict"] in ("DROPPED", "SALVAGED", "TRUNCATED"):
                log.counters["corruptions"] += 1
                log._owed += 1
    except BaseException:
        log.close()
        raise
    return log
