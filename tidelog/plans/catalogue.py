"""The query catalogue: each log operation as a relation, with the same relation in SQL.

A log is a table of records in queue order. `events` is one queue per event_type in event_id order with
payload event_id|event_type|props; `documents` is one queue per source in doc_id order with the text as
payload. Three fifths of each queue are committed, four fifths read; segments hold 4096 bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import admission, durability, layout, ledger, recovery, stats

SEGMENT = 4096
MAX_BYTES = 32768
MAX_SEGMENTS = 8
SYNC_EVERY = 64

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _payload():
    return F.concat_ws("|", F.col("event_id").cast("string"), F.col("event_type"), F.col("props"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "props")
    return codec.frame(rows.withColumn("queue_id", F.col("event_type")), _payload())


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["queue_id", "event_id", "ts", "framed_len", "seq", "start_off", "end_off"]
    return layout.with_offsets(events(spark, sf_dir), "event_id").select(*cols)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    framed = codec.frame(rows.withColumn("queue_id", F.coalesce("source", F.lit(""))), F.col("text"))
    return layout.with_offsets(framed, "doc_id").select("queue_id", "doc_id", "framed_len", "seq", "start_off", "end_off")


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.with_segments(frames(spark, sf_dir), SEGMENT)


#: The same base relations in DuckDB SQL.
_LEN = "CASE WHEN len < 128 THEN 1 WHEN len < 16384 THEN 2 WHEN len < 2097152 THEN 3 WHEN len < 268435456 THEN 4 ELSE 5 END"
_FRAMES = f"""
p AS (SELECT event_id, ts, event_type AS queue_id,
        concat_ws('|', CAST(event_id AS VARCHAR), event_type, props) AS payload FROM events),
f0 AS (SELECT *, CAST(octet_length(encode(payload)) AS BIGINT) AS len FROM p),
f1 AS (SELECT *, CAST({_LEN} + len + 8 AS BIGINT) AS framed_len FROM f0),
frames AS (
  SELECT *, row_number() OVER w - 1 AS seq, CAST(sum(framed_len) OVER w AS BIGINT) AS end_off,
         CAST(sum(framed_len) OVER w AS BIGINT) - framed_len AS start_off,
         count(*) OVER (PARTITION BY queue_id) AS n
  FROM f1 WINDOW w AS (PARTITION BY queue_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
cur AS (
  SELECT queue_id, max(n) AS n, max(end_off) AS write_off,
         coalesce(max(end_off) FILTER (seq < n * 3 // 5), 0) AS commit_off,
         coalesce(max(end_off) FILTER (seq < n * 4 // 5), 0) AS head_off
  FROM frames GROUP BY queue_id)"""
_DOCS = f"""
d0 AS (SELECT doc_id, coalesce(source, '') AS queue_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS len FROM documents),
d1 AS (SELECT *, CAST({_LEN} + len + 8 AS BIGINT) AS framed_len FROM d0),
frames AS (
  SELECT *, row_number() OVER w - 1 AS seq, CAST(sum(framed_len) OVER w AS BIGINT) AS end_off,
         CAST(sum(framed_len) OVER w AS BIGINT) - framed_len AS start_off
  FROM d1 WINDOW w AS (PARTITION BY queue_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING))"""
_SEGMENTS = f"""
jump AS (
  SELECT DISTINCT queue_id, CAST(1 AS BIGINT) AS segment, CAST(0 AS BIGINT) AS base, CAST({SEGMENT} AS BIGINT) AS capacity FROM frames
  UNION ALL
  SELECT j.queue_id, j.segment + 1, min(f.start_off), greatest({SEGMENT}, arg_min(f.framed_len, f.start_off))
  FROM jump j JOIN frames f ON f.queue_id = j.queue_id AND f.end_off > j.base + j.capacity
  GROUP BY j.queue_id, j.segment),
seg AS (
  SELECT f.*, j.segment, j.base, j.capacity
  FROM frames f ASOF JOIN jump j ON f.queue_id = j.queue_id AND f.seq >= j.seq0)"""
# the as-of join is by place in the queue: an empty segment 1 and segment 2 can share an offset
_SEGMENTS = _SEGMENTS.replace(
    "seg AS (", "starts AS (SELECT j.*, f.seq AS seq0 FROM jump j JOIN frames f ON f.queue_id = j.queue_id AND f.start_off = j.base\n"
    "  QUALIFY row_number() OVER (PARTITION BY j.queue_id, f.seq ORDER BY j.segment DESC) = 1),\nseg AS ("
).replace("ASOF JOIN jump j", "ASOF JOIN starts j")
_HEADERS = f"""
hdr AS (
  SELECT s.queue_id, segment, base, capacity, CAST(sum(framed_len) AS BIGINT) AS size, count(*) AS written,
         count(*) FILTER (end_off <= commit_off) AS committed, capacity > {SEGMENT} AS oversized,
         CAST(sum(framed_len) AS BIGINT) + 64 AS write_cursor,
         coalesce(max(end_off) FILTER (end_off <= commit_off) - base, 0) + 64 AS commit_cursor
  FROM seg s JOIN cur USING (queue_id) GROUP BY s.queue_id, segment, base, capacity)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return "WITH " + ("RECURSIVE " if recursive else "") + ",".join(parts) + "\n"


_F, _D = _with(_FRAMES), _with(_DOCS)
_S, _SD = _with(_FRAMES, _SEGMENTS, recursive=True), _with(_DOCS, _SEGMENTS, recursive=True)
_H = _with(_FRAMES, _SEGMENTS, _HEADERS, recursive=True)


def query(sql: str):
    """Registers a query under its function's name with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"{_F}SELECT event_id, len AS payload_len, framed_len, framed_len - len - 8 AS uvarint_len, md5(payload) AS checksum FROM f1")
def q01_frame_layout(spark, sf):
    e = events(spark, sf)
    return e.select("event_id", "payload_len", "framed_len", codec.uvarint_len(F.col("payload_len")).alias("uvarint_len"), "checksum")


@query(f"{_F}SELECT queue_id, event_id, seq, start_off, end_off FROM frames")
def q02_offsets(spark, sf):
    return frames(spark, sf).select("queue_id", "event_id", "seq", "start_off", "end_off")


@query(f"{_S}SELECT queue_id, event_id, segment, base FROM seg")
def q03_segments(spark, sf):
    return segmented(spark, sf).select("queue_id", "event_id", "segment", "base")


def _headers(spark, sf):
    # cursors and counts need no segments, so packing runs once
    return layout.segment_headers(segmented(spark, sf), layout.cursors(frames(spark, sf)), SEGMENT)


@query(f"{_H}SELECT queue_id, segment, base, size, capacity, oversized, written, committed, write_cursor, commit_cursor FROM hdr")
def q04_segment_headers(spark, sf):
    return _headers(spark, sf)


@query(f"{_SD}SELECT queue_id, doc_id, segment, capacity, capacity > {SEGMENT} AS oversized FROM seg")
def q05_oversized(spark, sf):
    s = layout.with_segments(documents(spark, sf), SEGMENT)
    return s.select("queue_id", "doc_id", "segment", "capacity", (F.col("capacity") > SEGMENT).alias("oversized"))


@query(f"""{_H}, live AS (
  SELECT queue_id, count(*) AS segments, CAST(sum(capacity + 64) AS BIGINT) AS disk_bytes FROM hdr JOIN cur USING (queue_id)
  WHERE NOT (base + size <= commit_off AND segment < (SELECT max(segment) FROM hdr h WHERE h.queue_id = hdr.queue_id)) GROUP BY queue_id)
SELECT queue_id, max(write_off - commit_off) AS backlog_bytes, count(*) FILTER (end_off > commit_off) AS backlog,
       max(greatest(head_off - commit_off, 0)) AS in_flight_bytes, count(*) AS added,
       count(*) FILTER (end_off <= head_off) AS delivered, count(*) FILTER (end_off <= commit_off) AS committed,
       max(segments) AS segments, max(disk_bytes) AS disk_bytes,
       CAST(32 AS BIGINT) AS max_segments, CAST(0 AS BIGINT) AS max_bytes,
       coalesce(CAST(sum(framed_len) FILTER (seq >= frames.n - frames.n % {SYNC_EVERY}) AS BIGINT), 0) AS unsynced_bytes
FROM frames JOIN cur USING (queue_id) JOIN live USING (queue_id) GROUP BY queue_id""")
def q06_stats(spark, sf):
    f = frames(spark, sf)
    c = layout.cursors(f)
    return stats.stats(f, _headers(spark, sf), c, max_segments=codec.max_segments(0), sync_every=SYNC_EVERY)


@query(f"""{_F}, asked AS (SELECT queue_id, end_off + event_id % 3 - 1 AS off FROM frames)
SELECT a.queue_id, a.off,
       CASE WHEN off > head_off THEN 'INVALID' WHEN off <= commit_off THEN 'NOOP' ELSE 'OK' END AS status,
       CASE WHEN off > head_off OR off <= commit_off THEN commit_off
            ELSE greatest(commit_off, coalesce(f.end_off, 0)) END AS commit_off
FROM asked a JOIN cur USING (queue_id) ASOF LEFT JOIN frames f ON a.queue_id = f.queue_id AND a.off >= f.end_off""")
def q07_commit_round(spark, sf):
    f = frames(spark, sf)
    asked = f.select("queue_id", F.expr("end_off + event_id % 3 - 1").alias("off"))
    return ledger.commit(f, asked, layout.cursors(f))


@query(f"""{_F}SELECT queue_id, coalesce(min(start_off) FILTER (event_id % 97 = 0), max(end_off)) AS frontier FROM frames GROUP BY queue_id""")
def q08_ack_frontier(spark, sf):
    return ledger.frontier(frames(spark, sf).withColumn("acked", F.expr("event_id % 97 <> 0")), 0)


@query(f"""{_F}, asked AS (
  SELECT queue_id, end_off AS off FROM frames UNION ALL SELECT queue_id, end_off + 1 FROM frames WHERE event_id % 50 = 0)
SELECT queue_id, CASE WHEN off > head_off THEN 'INVALID' WHEN off <= commit_off THEN 'RETIRED'
  WHEN EXISTS (SELECT 1 FROM frames f WHERE f.queue_id = asked.queue_id AND f.end_off = asked.off) THEN 'ACKED' ELSE 'INVALID' END AS verdict,
  count(*) AS n
FROM asked JOIN cur USING (queue_id) GROUP BY 1, 2""")
def q09_ack_batch(spark, sf):
    f = frames(spark, sf)
    c = layout.cursors(f)
    held = ledger.with_cursors(f, c).filter("start_off >= commit_off and end_off <= head_off").select("queue_id", "end_off")
    asked = f.select("queue_id", F.col("end_off").alias("off")).unionByName(f.filter("event_id % 50 = 0").select("queue_id", (F.col("end_off") + 1).alias("off")))
    return ledger.classify_acks(held, asked, c).groupBy("queue_id", "verdict").agg(F.count("*").alias("n"))


_IN_FLIGHT = "coalesce(CAST(sum(framed_len) FILTER (start_off >= commit_off AND end_off <= head_off) AS BIGINT), 0)"


@query(f"{_F}SELECT queue_id, {_IN_FLIGHT} AS bytes, count(*) FILTER (start_off >= commit_off AND end_off <= head_off) AS records FROM frames JOIN cur USING (queue_id) GROUP BY queue_id")
def q10_inflight(spark, sf):
    f = frames(spark, sf)
    return ledger.in_flight(f, layout.cursors(f))


@query(f"{_F}SELECT queue_id, {_IN_FLIGHT} AS readable_bytes, count(*) FILTER (start_off >= commit_off AND end_off <= head_off) AS readable, max(commit_off) AS head_off FROM frames JOIN cur USING (queue_id) GROUP BY queue_id")
def q11_rewind(spark, sf):
    f = frames(spark, sf)
    c = layout.cursors(f)
    back = ledger.in_flight(f, c).join(c.select("queue_id", "commit_off"), "queue_id")
    return back.select("queue_id", F.col("bytes").alias("readable_bytes"), F.col("records").alias("readable"), F.col("commit_off").alias("head_off"))


@query(f"""{_H}SELECT queue_id, segment, base + size <= commit_off AND segment < max(segment) OVER (PARTITION BY queue_id) AS dropped
FROM hdr JOIN cur USING (queue_id)""")
def q12_reclaim(spark, sf):
    return stats.reclaim(_headers(spark, sf), layout.cursors(frames(spark, sf))).select("queue_id", "segment", "dropped")


@query(f"""{_F}SELECT queue_id, coalesce(min(seq) FILTER (end_off > {MAX_BYTES}), count(*)) AS n_placed,
  CASE WHEN count(*) FILTER (end_off > {MAX_BYTES}) = 0 THEN 'NONE'
       WHEN arg_min(framed_len, seq) FILTER (end_off > {MAX_BYTES}) > {MAX_BYTES} THEN 'TOO_LARGE' ELSE 'FULL' END AS reason
FROM frames GROUP BY queue_id""")
def q13_addbatch_prefix(spark, sf):
    return admission.batch_prefix(frames(spark, sf), MAX_BYTES)


@query(_with(_DOCS, f"""
go AS (
  SELECT queue_id, doc_id, seq, framed_len, CASE WHEN framed_len > {MAX_BYTES} THEN 'TOO_LARGE' ELSE 'OK' END AS admit,
         CASE WHEN framed_len > {MAX_BYTES} THEN 0 ELSE framed_len END AS used
  FROM frames WHERE seq = 0
  UNION ALL
  SELECT f.queue_id, f.doc_id, f.seq, f.framed_len,
         CASE WHEN f.framed_len > {MAX_BYTES} THEN 'TOO_LARGE' WHEN g.used + f.framed_len > {MAX_BYTES} THEN 'FULL' ELSE 'OK' END,
         CASE WHEN f.framed_len > {MAX_BYTES} OR g.used + f.framed_len > {MAX_BYTES} THEN g.used ELSE g.used + f.framed_len END
  FROM go g JOIN frames f ON f.queue_id = g.queue_id AND f.seq = g.seq + 1)""", recursive=True)
    + "SELECT queue_id, doc_id, seq, framed_len, admit FROM go")
def q14_add_greedy(spark, sf):
    return admission.greedy(documents(spark, sf), MAX_BYTES, id_column="doc_id")


@query(f"{_S}SELECT queue_id, coalesce(min(seq) FILTER (segment > {MAX_SEGMENTS}), -1) AS first_refused FROM seg GROUP BY queue_id")
def q15_max_segments(spark, sf):
    return admission.first_refused_by_segments(segmented(spark, sf), MAX_SEGMENTS)


@query(f"""{_H}SELECT queue_id, count(*) AS segments, CAST(sum(capacity + 64) AS BIGINT) AS disk_bytes,
  sum(capacity + 64) <= {1 << 20} + 2 * {SEGMENT} + 64 * count(*) AS within_bound FROM hdr GROUP BY queue_id""")
def q16_disk_bytes(spark, sf):
    return stats.disk(_headers(spark, sf), SEGMENT, max_bytes=1 << 20)


@query(f"""{_F}SELECT queue_id, seq, CASE WHEN seq % {SYNC_EVERY} = {SYNC_EVERY - 1} THEN 0 ELSE
  CAST(sum(framed_len) OVER (PARTITION BY queue_id, seq // {SYNC_EVERY} ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS unsynced_bytes FROM frames""")
def q17_unsynced(spark, sf):
    return durability.unsynced(frames(spark, sf), SYNC_EVERY).select("queue_id", "seq", "unsynced_bytes")


@query(f"{_S}SELECT queue_id, count(DISTINCT segment) AS spans, 2 * (count(DISTINCT segment) - 1) + 1 AS header_writes FROM seg GROUP BY queue_id")
def q18_header_writes(spark, sf):
    return durability.header_writes(segmented(spark, sf))


@query(f"{_F}SELECT queue_id, event_id, CASE WHEN seq < 3 THEN seq + n ELSE seq END AS new_seq FROM frames")
def q19_requeue(spark, sf):
    return ledger.requeue(frames(spark, sf), 3).select("queue_id", "event_id", "new_seq")


@query(f"{_F}SELECT queue_id, event_id, seq FROM frames WHERE seq % 10 <> 9")
def q20_skip(spark, sf):
    return ledger.skip(frames(spark, sf), F.col("seq") % 10 == 9).select("queue_id", "event_id", "seq")


@query(f"{_F}SELECT queue_id, event_id, seq FROM frames WHERE seq < 5")
def q21_take_order(spark, sf):
    return ledger.take(frames(spark, sf), 5).select("queue_id", "event_id", "seq")


@query(f"{_F}SELECT queue_id, count(*) AS drained, CAST(sum(framed_len) AS BIGINT) AS bytes FROM frames JOIN cur USING (queue_id) WHERE end_off <= head_off GROUP BY queue_id")
def q22_drain_snapshot(spark, sf):
    f = frames(spark, sf)
    met = ledger.with_cursors(f, layout.cursors(f))
    return ledger.drain(met, F.col("head_off")).groupBy("queue_id").agg(F.count("*").alias("drained"), F.sum("framed_len").cast("long").alias("bytes"))


@query(f"{_F}SELECT queue_id, seq % 3 AS reader, count(*) AS n, CAST(sum(framed_len) AS BIGINT) AS bytes FROM frames GROUP BY 1, 2")
def q23_cooperating(spark, sf):
    return ledger.cooperate(frames(spark, sf), 3).groupBy("queue_id", "reader").agg(F.count("*").alias("n"), F.sum("framed_len").cast("long").alias("bytes"))


_AGE = "greatest(epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts), 0)"


def _aged(spark, sf):
    f = frames(spark, sf)
    now = spark.read.parquet(f"{sf}/events.parquet").agg(F.max("ts").alias("now"))
    return f.crossJoin(F.broadcast(now)).withColumn("age_us", codec.age_us(F.col("now"), F.col("ts")))  # one row


@query(f"{_F}SELECT queue_id, min({_AGE}) AS min_age_us, max({_AGE}) AS max_age_us, CAST(sum({_AGE}) AS BIGINT) // count(*) AS mean_age_us FROM frames GROUP BY queue_id")
def q24_age(spark, sf):
    return _aged(spark, sf).groupBy("queue_id").agg(F.min("age_us").alias("min_age_us"), F.max("age_us").alias("max_age_us"), F.expr("sum(age_us) div count(*)").alias("mean_age_us"))


@query(f"{_F}SELECT queue_id, event_id, CASE WHEN seq < 3 THEN seq + n ELSE seq END AS new_seq, {_AGE} AS age_us FROM frames")
def q25_requeue_age(spark, sf):
    return ledger.requeue(_aged(spark, sf), 3).select("queue_id", "event_id", "new_seq", "age_us")


@query(f"""{_F}SELECT queue_id, count(*) FILTER (event_id % 50 <> 0) AS delivered, count(*) FILTER (event_id % 50 = 0) AS lost_records,
  coalesce(CAST(sum(framed_len) FILTER (event_id % 50 = 0) AS BIGINT), 0) AS lost_bytes, count(*) FILTER (event_id % 50 = 0) AS corruptions FROM frames GROUP BY queue_id""")
def q26_bad_payload(spark, sf):
    return recovery.bad_payloads(frames(spark, sf), F.expr("event_id % 50 = 0"))


@query(f"""{_S}, cut AS (SELECT queue_id, segment, min(start_off) FILTER (segment % 7 = 0 AND event_id % 11 = 0) AS cut, max(end_off) AS fin FROM seg GROUP BY 1, 2)
SELECT queue_id, segment, count(*) FILTER (cut IS NULL OR start_off < cut) AS delivered,
       coalesce(max(fin - cut), 0) AS lost_bytes, CAST(max(CASE WHEN cut IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS lost_segments
FROM seg JOIN cut USING (queue_id, segment) GROUP BY 1, 2""")
def q27_bad_framing(spark, sf):
    return recovery.bad_framing(segmented(spark, sf), F.expr("segment % 7 = 0 and event_id % 11 = 0"))


@query(f"""{_S}, bad AS (SELECT queue_id, segment, min(seq) FILTER (event_id % 101 = 0) AS bad FROM seg GROUP BY 1, 2)
SELECT queue_id, segment, min(base) AS commit_off, count(*) FILTER (bad IS NULL OR seq < bad) AS replayed,
       coalesce(CAST(sum(framed_len) FILTER (bad IS NULL OR seq < bad) AS BIGINT), 0) AS replayed_bytes
FROM seg JOIN bad USING (queue_id, segment) GROUP BY 1, 2""")
def q28_torn_header(spark, sf):
    return recovery.verified_prefix(segmented(spark, sf), F.expr("event_id % 101 = 0"))


@query(f"""{_H}, cuts AS (SELECT queue_id, segment, base + size * 2 // 3 AS cut FROM hdr)
SELECT queue_id, segment, cut, count(*) FILTER (end_off <= cut) AS survivors, count(*) FILTER (end_off > cut) AS lost_records,
       coalesce(CAST(sum(framed_len) FILTER (end_off > cut) AS BIGINT), 0) AS discarded_bytes
FROM seg JOIN cuts USING (queue_id, segment) GROUP BY 1, 2, 3""")
def q29_truncated(spark, sf):
    s = segmented(spark, sf)
    h = _headers(spark, sf)
    return recovery.truncated(s, h.select("queue_id", "segment", F.expr("base + size * 2 div 3").alias("cut")))


#: One header per combination of what opening a segment tests, derived from order keys by arithmetic.
_SYNTHETIC = """o_orderkey AS k, o_orderkey % 2 = 0 AS tail,
  CAST(CASE o_orderkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 40 WHEN 2 THEN 4160 WHEN 3 THEN 2000 ELSE 4160 END AS BIGINT) AS file_len,
  CAST(CASE o_orderkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 40 ELSE 64 END AS BIGINT) AS hdr_len,
  o_orderkey % 11 <> 3 AS magic_ok, o_orderkey % 22 = 14 AS all_zero, o_orderkey % 13 <> 5 AS header_ok,
  CAST(CASE WHEN o_orderkey % 17 = 2 THEN 8 ELSE 1 END AS BIGINT) AS version,
  CAST(CASE WHEN o_orderkey % 19 = 4 THEN 8192 ELSE 4096 END AS BIGINT) AS seg_size,
  CAST(4096 AS BIGINT) AS capacity, CAST(64 + o_orderkey % 4000 AS BIGINT) AS write_cursor"""


@query(f"""WITH h AS (SELECT {_SYNTHETIC} FROM orders)
SELECT k, CASE WHEN file_len = 0 AND tail THEN 'REMOVED' WHEN file_len = 0 OR hdr_len < 64 THEN 'DROPPED'
  WHEN NOT magic_ok THEN CASE WHEN tail AND all_zero THEN 'REMOVED' ELSE 'DROPPED' END
  WHEN NOT header_ok THEN CASE WHEN version = 1 THEN 'SALVAGED' ELSE 'DROPPED' END
  WHEN version <> 1 THEN 'FOREIGN' WHEN seg_size <> 4096 THEN 'MISMATCH'
  WHEN file_len < 64 + capacity THEN CASE WHEN write_cursor > file_len THEN 'TRUNCATED' ELSE 'REPAIRED' END
  ELSE 'ACCEPTED' END AS verdict FROM h""")
def q30_recovery_verdicts(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey")
    rows.createOrReplaceTempView("_headers_of_orders")
    return recovery.verdicts(spark.sql(f"SELECT {_SYNTHETIC} FROM _headers_of_orders"), SEGMENT).select("k", "verdict")


_RECOVERED = """rec AS (
  SELECT queue_id, coalesce(arg_min(base + commit_cursor - 64, segment) FILTER (commit_cursor < size + 64), max(base + size)) AS commit_off,
         CAST(sum(size) AS BIGINT) AS write_off FROM hdr GROUP BY queue_id)"""


@query(f"{_H}, {_RECOVERED} SELECT queue_id, commit_off, write_off FROM rec")
def q31_cursor_recovery(spark, sf):
    return recovery.recovered_cursor(_headers(spark, sf))


@query(f"""{_H}, {_RECOVERED} SELECT queue_id, segment, written,
  CASE WHEN base + size <= commit_off THEN written WHEN base >= commit_off THEN 0 ELSE least(committed, written) END AS committed FROM hdr JOIN rec USING (queue_id)""")
def q32_count_reconcile(spark, sf):
    h = _headers(spark, sf)
    return recovery.reconciled_counts(h, recovery.recovered_cursor(h))


@query(f"{_F}SELECT queue_id, event_id, seq FROM frames JOIN cur USING (queue_id) WHERE end_off > commit_off")
def q33_replay(spark, sf):
    f = frames(spark, sf)
    return recovery.replay(f, layout.cursors(f)).select("queue_id", "event_id", "seq")


_OPS = """SELECT event_type AS queue_id, CASE WHEN event_id % 10 < 4 THEN 'add' WHEN event_id % 10 = 4 THEN 'refused' WHEN event_id % 10 < 7 THEN 'take'
  WHEN event_id % 10 = 7 THEN 'skip' WHEN event_id % 10 = 8 THEN 'requeue' ELSE 'reserve' END AS op, CAST(1 AS BIGINT) AS n FROM {0}"""


@query(f"""WITH ops AS ({_OPS.format("events")})
SELECT queue_id, CAST(sum(n) FILTER (op IN ('add', 'requeue')) AS BIGINT) AS added, CAST(sum(n) FILTER (op IN ('take', 'reserve', 'skip', 'requeue')) AS BIGINT) AS delivered,
  CAST(sum(n) FILTER (op IN ('take', 'skip', 'requeue')) AS BIGINT) AS committed, CAST(sum(n) FILTER (op = 'refused') AS BIGINT) AS "full" FROM ops GROUP BY queue_id""")
def q34_counters(spark, sf):
    spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type").createOrReplaceTempView("_operations")
    return stats.counters(spark.sql(_OPS.format("_operations")))


@query(f"""{_S}, asked AS (SELECT queue_id, start_off + event_id % 20 AS off FROM frames)
SELECT a.queue_id, a.off, s.segment, s.seq FROM asked a ASOF JOIN seg s ON a.queue_id = s.queue_id AND a.off >= s.start_off""")
def q35_offset_lookup(spark, sf):
    s = segmented(spark, sf)
    asked = s.select("queue_id", F.expr("start_off + event_id % 20").alias("off"))
    return layout.lookup(s, asked).select("queue_id", "off", "segment", "seq")


@query(f"{_F}SELECT queue_id, event_id, seq, framed_len FROM frames JOIN cur USING (queue_id) WHERE start_off = head_off")
def q36_peek(spark, sf):
    f = frames(spark, sf)
    return ledger.peek(f, layout.cursors(f)).select("queue_id", "event_id", "seq", "framed_len")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backlog, bytes and oldest waiting age of each queue after a commit."""
    aged = _aged(spark, sf_dir)
    met = ledger.with_cursors(aged, layout.cursors(aged)).filter("end_off > commit_off")
    return met.groupBy("queue_id").agg(F.count("*").alias("backlog"), F.sum("framed_len").cast("long").alias("backlog_bytes"), F.max("age_us").alias("oldest_age_us"))


@query(f"""{_F}SELECT queue_id, count(*) AS backlog, CAST(sum(framed_len) AS BIGINT) AS backlog_bytes, max({_AGE}) AS oldest_age_us
FROM frames JOIN cur USING (queue_id) WHERE end_off > commit_off GROUP BY queue_id""")
def q00_backlog(spark, sf):
    return flagship(spark, sf)
