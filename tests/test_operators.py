"""Hand-made cases of the pure operators."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import codec
from tidelog.operators import admission, layout, ledger, recovery


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(0, 10, True), (20, 30, True)], 10),
        ([(0, 10, True), (10, 20, True), (20, 30, True)], 30),
        ([(0, 10, True), (10, 20, False), (20, 30, True)], 10),
        ([(0, 10, False), (10, 20, True)], 0),
    ],
)
def test_frontier(spark, rows, want):
    df = spark.createDataFrame([("q", *r) for r in rows], "queue_id string, start_off long, end_off long, acked boolean")
    assert ledger.frontier(df).first()["frontier"] == want


@pytest.mark.parametrize("length, want", [(0, 9), (8, 17), (100, 109), (127, 136), (128, 138), (256, 266), (20000, 20011)])
def test_framed_len(spark, length, want):
    assert spark.range(1).select(codec.framed_len(F.lit(length).cast("long")).alias("x")).first()["x"] == want


@pytest.mark.parametrize("size, want", [(0, 8 << 20), (-1, 8 << 20), (1, 4096), (4095, 4096), (4096, 4096), (4097, 8192), (5000, 8192), (1 << 20, 1 << 20)])
def test_segment_capacity(size, want):
    assert codec.segment_capacity(size) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(5, 30))
def test_next_fit_matches_fold(sizes, cap):
    end = np.cumsum(sizes, dtype=np.int64)
    start = end - np.array(sizes, dtype=np.int64)
    found = layout.segment_starts(start, end, cap)
    number, used, room, want = 1, 0, cap, []
    for k, x in enumerate(sizes):
        if used + x > room:
            number, used, room = number + 1, 0, max(cap, x)
        if not used:
            want.append((k, number, room))
        used += x
    assert found == want


def test_greedy_goes_on_after_a_refusal(spark):
    df = spark.createDataFrame([("q", i, i, n) for i, n in enumerate([50, 60, 40, 200, 10])], "queue_id string, id long, seq long, framed_len long")
    got = {r["id"]: r["admit"] for r in admission.greedy(df, 100).collect()}
    assert got == {0: "OK", 1: "FULL", 2: "OK", 3: "TOO_LARGE", 4: "OK" if 50 + 40 + 10 <= 100 else "FULL"}


def test_offsets_are_the_same_in_any_chunk(spark):
    df = spark.createDataFrame([("ab"[i % 2], i, 9 + i % 5) for i in range(40)], "queue_id string, id long, framed_len long")
    one = sorted(layout.with_offsets(df, "id").select("id", "seq", "start_off", "end_off").collect())
    assert one == sorted(layout.with_offsets(df, "id", chunk=7).select("id", "seq", "start_off", "end_off").collect())


def test_truncation_case(spark):
    frames = spark.createDataFrame([("q", 1, i * 310, (i + 1) * 310, 310) for i in range(3)], "queue_id string, segment long, start_off long, end_off long, framed_len long")
    cuts = spark.createDataFrame([("q", 1, 2 * 310 + 150)], "queue_id string, segment long, cut long")
    r = recovery.truncated(frames, cuts).first()
    assert (r["survivors"], r["lost_records"], r["discarded_bytes"]) == (2, 1, 310)


def test_empty_log(spark):
    none = spark.createDataFrame([], "queue_id string, id long, framed_len long")
    f = layout.with_segments(layout.with_offsets(none, "id"), 4096)
    assert f.count() == 0 and ledger.frontier(f.withColumn("acked", F.lit(True))).count() == 0


def test_codec_error(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("nonsense",)], "payload string")
    got = {r["payload"]: (r["_codec_error"], r["value"]) for r in codec.with_codec_error(df, "payload", "a long").collect()}
    assert got["nonsense"][0] and not got['{"a": 1}'][0] and got['{"a": 1}'][1]["a"] == 1


def _log_of(spark, sizes):
    rows, end = [], {}
    for i, (q, n) in enumerate(sizes):
        end[q] = end.get(q, 0) + n
        rows.append((q, sum(1 for x, _ in sizes[:i] if x == q), end[q] - n, end[q], n))
    return spark.createDataFrame(rows, "queue_id string, seq long, start_off long, end_off long, framed_len long").repartition(3)


def test_segments_are_the_same_in_any_chunk(spark):
    rng = np.random.default_rng(7)
    for _ in range(3):
        sizes = [("ab"[int(rng.integers(0, 2))], int(rng.choice([9, 20, 31, 55, 130], p=[0.3, 0.3, 0.2, 0.15, 0.05]))) for _ in range(120)]
        f = _log_of(spark, sizes)
        want = {}
        for q in "ab":
            own = [n for x, n in sizes if x == q]
            end = np.cumsum(own, dtype=np.int64)
            found = layout.segment_starts(end - own, end, 100)
            for k in range(len(own)):
                at, number, room = max(s for s in found if s[0] <= k)
                want[q, k] = (number, int(end[at] - own[at]), room)
        for chunk in (1, 4, 13, 1000):
            got = {(r["queue_id"], r["seq"]): (r["segment"], r["base"], r["capacity"]) for r in layout.with_segments(f, 100, chunk=chunk).collect()}
            assert got == want


def test_lookup_and_frontier_are_the_same_in_any_span(spark):
    rng = np.random.default_rng(8)
    f = _log_of(spark, [("ab"[i % 2], int(rng.integers(9, 90))) for i in range(80)])
    rows = {(r["queue_id"], r["start_off"]): r for r in f.collect()}
    last = {q: max(r["end_off"] for (x, _), r in rows.items() if x == q) for q in "ab"}
    asked = spark.createDataFrame([(q, off) for q in "ab" for off in range(0, last[q] + 5, 3)], "queue_id string, off long")
    want = sorted((q, off, max(s for x, s in rows if x == q and s <= off)) for q, off in asked.collect() if off < last[q])
    held = f.withColumn("acked", F.expr("seq not in (25, 31)")).filter("queue_id = 'a' or seq <> 12")
    stop = {"a": next(r["start_off"] for (q, _), r in rows.items() if q == "a" and r["seq"] == 25), "b": next(r["start_off"] for (q, _), r in rows.items() if q == "b" and r["seq"] == 12)}
    for span in (7, 100, 1 << 26):
        got = layout.lookup(f, asked, columns=("seq", "start_off", "end_off"), span=span).select("queue_id", "off", "start_off").collect()
        assert sorted(tuple(r) for r in got) == want
        assert {r["queue_id"]: r["frontier"] for r in ledger.frontier(held, span=span).collect()} == stop
