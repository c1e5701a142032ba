"""Exact removal of byte strings that documents share, by distributed difference-cover suffix sorting.

Documents are packed into blobs of a few megabytes. Each `length`-byte window of a document is represented
by the smallest hash of its 16-byte strings; neighbouring windows with one representative form a region.
Equal windows have equal representatives, so only regions whose representative occurs in two documents can
share a window, and all of those meet in the bucket of its hash: no match is lost, and text that repeats
nowhere is never sorted. Packs send each distinct region once, so a passage in very many documents counts
once per pack. A bucket sorts the suffixes of its regions by the difference-cover method (sort the triples
at positions 1 and 2 of every 3, recurse on their names, place and merge the rest), compares neighbours'
prefixes, and returns the smallest document of each window; packs then remove what a smaller one holds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import Staged, release_memory

GRAM = 16
#: A region has at most this many windows, however repetitive the text.
REGION_WINDOWS = 512
LAST = np.iinfo(np.int64).max
_codec: dict = {}  # one compressor and one decompressor per worker


def _dense(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def _join(high: np.ndarray, low: np.ndarray, low_size: int) -> np.ndarray:
    """One integer per pair, ordered as the pairs."""
    if (int(high.max(initial=0)) + 1) * low_size >= 1 << 62:
        high = _dense(high)
    return high * low_size + low


def _names(a: np.ndarray, b: np.ndarray, c: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the triples (a, b, c), ordered as the triples; equal ones share a number."""
    if size**3 <= 1 << 25:  # a table of all triples takes the place of sorting them
        key = (a * size + b) * size + c
        there = np.zeros(size**3, dtype=np.int32)
        there[key] = 1
        return (np.cumsum(there, dtype=np.int32) - 1)[key].astype(np.int64)
    return _dense(_join(_join(a, b, size), c, size))


def suffix_ranks(t: np.ndarray, need: int | None = None) -> np.ndarray:
    """Rank of every suffix of t (integers from 1 on) by the difference cover {1, 2} modulo 3.

    With `need`, only the first `need` integers must be in order: the recursion ends once its names cover
    them, and suffixes that agree that far stand together in any order.
    """
    n = len(t)
    if n < 3:
        order = sorted(range(n), key=lambda i: t[i:].tolist())
        out = np.empty(n, dtype=np.int64)
        out[order] = np.arange(n)
        return out
    end = n + (n % 3 == 1)  # one empty suffix more keeps the first list's last triple apart from the second's first
    text = np.r_[t.astype(np.int64), 0, 0, 0, 0]
    size = int(text.max()) + 1
    sample = np.r_[np.arange(1, end, 3), np.arange(2, end, 3)]
    thirds = [np.concatenate([text[1 + k : end + k : 3], text[2 + k : end + k : 3]]) for k in range(3)]
    names = _names(*thirds, size)
    if int(names.max()) + 1 < len(names):
        if need is not None and need <= 3:
            turn = np.argsort(names)
            names[turn] = np.arange(len(names))
        else:
            names = suffix_ranks(names + 1, None if need is None else -(-need // 3))
            if need is not None:  # places taken twice by suffixes that agree
                turn = np.argsort(names)
                names[turn] = np.arange(len(names))
    rank = np.zeros(n + 4, dtype=np.int64)
    first = len(range(1, end, 3))
    rank[1:end:3], rank[2:end:3] = names[:first] + 1, names[first:] + 1
    top = len(sample) + 2
    placed = np.empty(len(sample), dtype=np.int64)
    placed[names] = sample
    placed = placed[end - n :]  # without the empty suffix, the smallest
    ones, twos = np.flatnonzero(placed % 3 == 1), np.flatnonzero(placed % 3 == 2)
    one, two = placed[ones], placed[twos]  # in suffix order, so that their keys below are sorted as they are
    zero = one - 1 if n % 3 != 1 else np.r_[n - 1, one - 1]
    # each third in suffix order; small integers are sorted by counting, which keeps the order of the rest
    zero = zero[np.argsort(text[zero].astype(np.uint16), kind="stable") if size <= 1 << 16 else np.argsort(_join(text[zero], rank[zero + 1], top))]
    zero_1, one_1 = _join(text[zero], rank[zero + 1], top), _join(text[one], rank[one + 1], top)
    pair = np.concatenate([zero, two])
    by_two = _join(_join(text[pair], text[pair + 1], size), rank[pair + 2], top)
    zero_2, two_2 = by_two[: len(zero)], by_two[len(zero) :]
    out = np.empty(n, dtype=np.int64)
    after_one, after_two = np.searchsorted(one_1, zero_1), np.searchsorted(two_2, zero_2)
    out[zero] = np.arange(len(zero)) + after_one + after_two
    # how many zeros stand before each of the others follows from where the zeros stand among them
    out[one] = ones + np.bincount(after_one, minlength=len(one) + 1)[: len(one)].cumsum()
    out[two] = twos + np.bincount(after_two, minlength=len(two) + 1)[: len(two)].cumsum()
    return out


def _load8(buf: bytes, n: int, at: int) -> np.ndarray:
    return np.ndarray((n,), dtype="<u8", buffer=buf, offset=at, strides=(1,))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def _gram_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of every GRAM-byte string."""
    grams = len(text) - GRAM + 1
    buf = text + b"\0" * 8
    h = _load8(buf, grams, 0) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += _load8(buf, grams, 8)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h


def regions(text: bytes, lens: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and representative of each region of documents laid end to end."""
    n = len(text) - length + 1
    none = np.zeros(0, dtype=np.int64)
    if n <= 0:
        return none, none, none.astype(np.uint64)
    step = 1 << 15  # pieces that stay in the cache
    low = np.concatenate([_sliding_min(_gram_hashes(text[at : at + step + length - 1]), length - GRAM + 1) for at in range(0, n, step)])
    ends = np.cumsum(lens)
    starts = ends - lens
    usable = np.zeros(n + 1, dtype=np.int8)
    long = lens >= length
    np.add.at(usable, starts[long], 1)
    np.add.at(usable, ends[long] - length + 1, -1)
    on = np.cumsum(usable[:-1], dtype=np.int8) > 0
    edge = np.zeros(n, dtype=bool)
    edge[starts[long]] = True
    fresh = np.flatnonzero(on & np.r_[True, (low[1:] != low[:-1]) | edge[1:] | ~on[:-1]])
    stop = np.flatnonzero(np.r_[on[1:] & ((low[1:] != low[:-1]) | edge[1:]) | ~on[1:], True] & on) + 1
    count = stop - fresh
    if (count > REGION_WINDOWS).any():
        parts = -(-count // REGION_WINDOWS)
        k = np.arange(parts.sum()) - np.repeat(parts.cumsum() - parts, parts)
        fresh = np.repeat(fresh, parts) + k * REGION_WINDOWS
        count = np.minimum(np.repeat(stop, parts) - fresh, REGION_WINDOWS)
    return fresh, count, low[fresh]


class Pack:
    """Rows of some documents as one compressed blob; bytes of their texts and comparable ids."""

    def __init__(self, blob: bytes):
        self.batch = pa.ipc.open_stream(_loosen(blob, np.uint8).tobytes()).read_all().combine_chunks()
        ids = self.batch.column("doc_id")
        self.ids = np.where(np.asarray(ids.is_null()), LAST, ids.fill_null(0).to_numpy())
        texts = [t or b"" for t in self.batch.column("text").cast(pa.binary()).to_pylist()]
        self.lens = np.array([len(t) for t in texts], dtype=np.int64)
        self.text = b"".join(texts)


def _squeeze(data: bytes) -> bytes:
    if "z" not in _codec:
        import zstandard

        _codec["z"] = zstandard.ZstdCompressor(level=3)
    return _codec["z"].compress(data)


def _loosen(data: bytes, kind) -> np.ndarray:
    if "u" not in _codec:
        import zstandard

        _codec["u"] = zstandard.ZstdDecompressor()
    return np.frombuffer(_codec["u"].decompress(data), dtype=kind)


def _packs(docs: DataFrame, pack_bytes: int) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        pack = TaskContext.get().partitionId() << 32
        for batch in batches:
            size = np.array([len(t) if t else 0 for t in batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()]) + 64
            cut = np.flatnonzero(np.diff(np.cumsum(size) // pack_bytes)) + 1
            for a, b in zip([0, *cut], [*cut, len(size)]):
                if a == b:
                    continue
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as w:
                    w.write_batch(batch.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array([pack], pa.int64()), pa.array([_squeeze(sink.getvalue().to_pybytes())], pa.binary())], names=["pack", "blob"])
                pack += 1

    return docs.mapInArrow(run, "pack long, blob binary")


def _split(bucket: np.ndarray):
    """Positions of each bucket's members."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(bucket[part[0]]), part


def _representatives(packs: DataFrame, length: int, buckets: int) -> DataFrame:
    """pack, bucket, hashes (distinct in the pack), many (one byte each: occurs in two documents of the pack)."""

    def run(batches):
        for batch in batches:
            for pack, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p = Pack(blob)
                first, _, rep = regions(p.text, p.lens, length)
                doc = np.searchsorted(np.cumsum(p.lens), first, side="right")
                turn = np.argsort(rep, kind="stable")
                rep, who = rep[turn], p.ids[doc[turn]]
                at = np.flatnonzero(np.r_[True, rep[1:] != rep[:-1]]) if len(rep) else np.zeros(0, dtype=np.int64)
                many = np.minimum.reduceat(who, at) != np.maximum.reduceat(who, at) if len(at) else np.zeros(0, dtype=bool)
                rep = rep[at]
                cols: list[list] = [[], [], []]
                for bucket, part in _split((rep % np.uint64(buckets)).astype(np.int64)):
                    for col, x in zip(cols, (bucket, rep[part].tobytes(), many[part].astype(np.uint8).tobytes())):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array([pack] * len(cols[0]), pa.int64()), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["pack", "bucket", "hashes", "many"])

    return packs.mapInArrow(run, "pack long, bucket int, hashes binary, many binary")


def _shared(representatives: DataFrame) -> DataFrame:
    """pack, hashes: the pack's representatives that occur in two documents."""

    def run(t):
        t = t.combine_chunks()
        parts = [np.frombuffer(h, dtype=np.uint64) for h in t.column("hashes").to_pylist()]
        many = np.concatenate([np.frombuffer(m, dtype=np.uint8) for m in t.column("many").to_pylist()])
        rep, at, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        yes = ((n > 1) | (np.bincount(at, many, len(rep)) > 0))[at]
        stop = np.cumsum([len(p) for p in parts])
        got = [p[yes[b - len(p) : b]] for p, b in zip(parts, stop)]
        rows = [(k, g.tobytes()) for k, g in zip(t.column("pack").to_pylist(), got) if len(g)]
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["pack", "hashes"])

    return representatives.groupBy("bucket").applyInArrow(run, "pack long, hashes binary")


def _sent(packs: DataFrame, shared: DataFrame, length: int, buckets: int) -> DataFrame:
    """Per pack and bucket, distinct candidate regions (bucket >= 0); per pack, where each occurs (bucket -1)."""

    def run(left, right):
        row = left.slice(0, 1).to_pylist()[0] if left.num_rows else None
        out: list[tuple] = []
        if row and right.num_rows:
            p = Pack(row["blob"])
            first, count, rep = regions(p.text, p.lens, length)
            known = np.sort(np.concatenate([np.frombuffer(h, dtype=np.uint64) for h in right.column("hashes").to_pylist()]))
            on = known[np.minimum(np.searchsorted(known, rep), len(known) - 1)] == rep
            first, count, rep = first[on], count[on], rep[on]
            doc = np.searchsorted(np.cumsum(p.lens), first, side="right")
            seen: dict[bytes, int] = {}
            text = p.text
            which = np.fromiter((seen.setdefault(text[a:b], len(seen)) for a, b in zip(first.tolist(), (first + count + length - 1).tolist())), dtype=np.int64, count=len(first))
            low = np.full(len(seen), LAST, dtype=np.int64)
            np.minimum.at(low, which, p.ids[doc])
            bucket = np.zeros(len(seen), dtype=np.int64)
            bucket[which] = (rep % np.uint64(buckets)).astype(np.int64)
            texts = list(seen)
            for k, part in _split(bucket):
                some = [texts[i] for i in part.tolist()]
                lens = np.array([len(s) for s in some], dtype=np.uint32)
                out.append((row["pack"], k, _squeeze(b"".join(some)), _squeeze(lens.tobytes()), _squeeze(low[part].tobytes()), part.astype(np.uint32).tobytes()))
            release_memory()
            out.append((row["pack"], -1, _squeeze(np.diff(first, prepend=0).astype(np.uint32).tobytes()), _squeeze(doc.astype(np.uint32).tobytes()), _squeeze(which.astype(np.uint32).tobytes()), _squeeze(count.astype(np.uint16).tobytes())))
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        names = ["pack", "bucket", "a", "b", "c", "d"]
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    both = packs.groupBy("pack").cogroup(shared.groupBy("pack"))
    return both.applyInArrow(run, "pack long, bucket int, a binary, b binary, c binary, d binary")


def smallest_holders(texts: list[bytes], low: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Per window start, region after region: the smallest of low[] among regions that hold the same window,
    from neighbours in the order of all suffixes; and the number of windows of each region."""
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    joined = b"\0".join(texts)
    starts = np.cumsum(lens + 1) - lens - 1
    codes = np.frombuffer(joined, dtype=np.uint8).astype(np.int64) + 2
    codes[(starts + lens)[:-1]] = 1  # between texts: below every byte
    rank = suffix_ranks(codes, length)
    windows = lens - length + 1
    at = np.repeat(starts - np.r_[0, windows.cumsum()[:-1]], windows) + np.arange(windows.sum())
    owner = np.repeat(np.arange(len(texts)), windows)
    turn = np.argsort(rank[at])  # suffixes that are whole windows, in suffix order
    at, owner = at[turn], owner[turn]
    same = np.ones(max(0, len(at) - 1), dtype=bool)
    buf = joined + b"\0" * 8
    for shift in [*range(0, length - 8, 8), length - 8]:
        v = _load8(buf, len(joined) - shift, shift)[at]
        same &= v[1:] == v[:-1]
    group = np.r_[0, np.cumsum(~same)]
    heads = np.flatnonzero(np.r_[True, ~same])
    best = np.minimum.reduceat(low[owner], heads)[group]
    out = np.empty(len(at), dtype=np.int64)
    out[turn] = best
    return out, windows


def _holders(sent: DataFrame, length: int) -> DataFrame:
    """pack, regions, runs per region, run starts, run ids: who holds each window of a pack's regions first."""

    def run(t):
        t = t.combine_chunks()
        seen: dict[bytes, int] = {}
        rows = []
        for pack, a, b, c, d in zip(*(t.column(n).to_pylist() for n in ("pack", "a", "b", "c", "d"))):
            text, lens = _loosen(a, np.uint8).tobytes(), _loosen(b, np.uint32).astype(np.int64)
            stop = lens.cumsum()
            at = np.fromiter((seen.setdefault(text[x:y], len(seen)) for x, y in zip((stop - lens).tolist(), stop.tolist())), dtype=np.int64, count=len(lens))
            rows.append((pack, at, _loosen(c, np.int64), d))
        low = np.full(len(seen), LAST, dtype=np.int64)
        for _, at, ids, _ in rows:
            np.minimum.at(low, at, ids)
        flat, windows = smallest_holders(list(seen), low, length)
        release_memory()
        region = np.repeat(np.arange(len(windows)), windows)
        head = np.flatnonzero(np.r_[True, (flat[1:] != flat[:-1]) | (region[1:] != region[:-1])])
        of = region[head]
        n_runs = np.bincount(of, minlength=len(windows))
        first_run = n_runs.cumsum() - n_runs
        offset = head - (windows.cumsum() - windows)[of]
        out = []
        for pack, at, _, d in rows:
            k = n_runs[at]
            pick = np.repeat(first_run[at] - np.r_[0, k.cumsum()[:-1]], k) + np.arange(k.sum())
            out.append((pack, d, _squeeze(k.astype(np.uint16).tobytes()), _squeeze(offset[pick].astype(np.uint16).tobytes()), _squeeze(flat[head[pick]].tobytes())))
        return pa.table([pa.array([r[i] for r in out], pa.binary() if i else pa.int64()) for i in range(5)], names=["pack", "which", "runs", "offsets", "ids"])

    cut = sent.filter("bucket >= 0").select("pack", "bucket", "a", "b", "c", "d")
    return cut.groupBy("bucket").applyInArrow(run, "pack long, which binary, runs binary, offsets binary, ids binary")


def removed_spans(p: Pack, places: dict | None, held: list[dict], length: int) -> list[np.ndarray]:
    """Per document of the pack: sorted disjoint (start, stop) byte spans to remove."""
    n_docs = len(p.lens)
    if not places or not held:
        return [np.zeros((0, 2), dtype=np.int64)] * n_docs
    first = np.cumsum(_loosen(places["a"], np.uint32).astype(np.int64))
    doc = _loosen(places["b"], np.uint32).astype(np.int64)
    which = _loosen(places["c"], np.uint32).astype(np.int64)
    sent = np.concatenate([np.frombuffer(h["which"], dtype=np.uint32).astype(np.int64) for h in held])
    runs = np.concatenate([_loosen(h["runs"], np.uint16).astype(np.int64) for h in held])
    offsets = np.concatenate([_loosen(h["offsets"], np.uint16).astype(np.int64) for h in held])
    ids = np.concatenate([_loosen(h["ids"], np.int64) for h in held])
    from_run = np.zeros(int(which.max()) + 1, dtype=np.int64)
    n_runs = np.zeros(int(which.max()) + 1, dtype=np.int64)
    from_run[sent], n_runs[sent] = runs.cumsum() - runs, runs
    count = _loosen(places["d"], np.uint16).astype(np.int64)
    k = n_runs[which]
    pick = np.repeat(from_run[which] - np.r_[0, k.cumsum()[:-1]], k) + np.arange(k.sum())
    place = np.repeat(np.arange(len(which)), k)
    begin = first[place] + offsets[pick]
    last_of_place = np.r_[place[1:] != place[:-1], True]
    finish = np.where(last_of_place, (first + count)[place], np.r_[begin[1:], 0])
    gone = ids[pick] < p.ids[doc[place]]
    begin, finish, owner = begin[gone], finish[gone] + length - 1, doc[place[gone]]
    base = np.cumsum(p.lens) - p.lens
    out = []
    cuts = np.searchsorted(owner, np.arange(n_docs + 1))
    for d in range(n_docs):
        a, b = begin[cuts[d] : cuts[d + 1]], finish[cuts[d] : cuts[d + 1]]
        if len(a):
            far = np.maximum.accumulate(b)
            head = np.r_[True, a[1:] > far[:-1]]
            out.append(np.c_[a[head], far[np.r_[head[1:], True]]] - base[d])
        else:
            out.append(np.zeros((0, 2), dtype=np.int64))
    return out


def whole_characters(text: bytes, spans: np.ndarray) -> np.ndarray:
    """Spans shrunk to whole UTF-8 characters, so that what stays can be decoded."""
    out = []
    for a, b in spans.tolist():
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def _keep(text: bytes, spans: np.ndarray) -> bytes:
    edge = [0, *spans.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edge[::2], edge[1::2]))


FOUND = [
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
    T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("kept_text", T.StringType()),
]


def _results(packs: DataFrame, sent: DataFrame, holders: DataFrame, schema: T.StructType, length: int, with_text: bool) -> DataFrame:
    fields = [*schema.fields, *(FOUND if with_text else FOUND[:4])]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string()]

    def run(left, right):
        parts = right.to_pylist()
        row = left.to_pylist()[0]
        p = Pack(row["blob"])
        release_memory()
        places = next((r for r in parts if r["kind"] == 0), None)
        spans = removed_spans(p, places, [{"which": r["a"], "runs": r["b"], "offsets": r["c"], "ids": r["d"]} for r in parts if r["kind"] == 1], length)
        cols: list[list] = [[] for _ in kinds]
        stop = np.cumsum(p.lens)
        for d, cut in enumerate(spans):
            text = p.text[stop[d] - p.lens[d] : stop[d]]
            got: tuple = (len(text), int((cut[:, 1] - cut[:, 0]).sum()), len(cut), hashlib.sha256(_keep(text, cut)).hexdigest())
            if with_text:
                got += (cut.ravel().tolist(), _keep(text, whole_characters(text, cut)).decode("utf-8", "replace"))
            for col, x in zip(cols, got):
                col.append(x)
        data = [p.batch.column(f.name) for f in schema.fields] + [pa.array(c, k) for c, k in list(zip(cols, kinds))[: len(fields) - len(schema.fields)]]
        return pa.table(data, names=[f.name for f in fields])

    places = sent.filter("bucket = -1").select("pack", F.lit(0).alias("kind"), "a", "b", "c", "d")
    held = holders.select("pack", F.lit(1).alias("kind"), F.col("which").alias("a"), F.col("runs").alias("b"), F.col("offsets").alias("c"), F.col("ids").alias("d"))
    return packs.groupBy("pack").cogroup(places.unionByName(held).groupBy("pack")).applyInArrow(run, T.StructType(fields))


def remove_repeats(docs: DataFrame, length: int = 50, pack_bytes: int = 4 << 20, regions_per_bucket: int = 200_000, with_text: bool = True) -> DataFrame:
    """`docs` with n_bytes, n_removed, n_spans, kept_sha256 and, with_text, spans and kept_text.

    Every byte goes that is covered by a `length`-byte string which also starts in a document of smaller
    doc_id, judged on the input. Null texts count as empty; texts shorter than `length` lose nothing; a null
    doc_id comes after all others; rows of one id do not take from one another, so repeated rows fare alike;
    an empty table gives no rows. kept_text leaves characters whole where a span ends inside one.
    Columns of `docs` named like a result are replaced.
    """
    if length < 24:
        raise ValueError("length must be 24 bytes or more")
    names = {f.name for f in FOUND}
    docs = docs.select(*[c for c in docs.columns if c not in names])
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // (17 * regions_per_bucket)))
    packs = Staged(_packs(docs, pack_bytes), "packs")
    shared = Staged(_shared(_representatives(packs.read(), length, buckets)), "shared")
    sent = Staged(_sent(packs.read(), shared.read(), length, buckets), "regions")
    shared.drop()
    holders = Staged(_holders(sent.read(), length), "holders")
    return _results(packs.read(), sent.read(), holders.read(), docs.schema, length, with_text)


def cut_repeats(docs: DataFrame, **options) -> DataFrame:
    """`docs` with the repeats cut out of text (characters whole) and n_chars, if there, counted anew.

    Nulls stay null; every row and column of `docs` comes back, whatever the columns' names.
    """
    # columns named like a result step aside meanwhile
    aside = {f.name: f"own {f.name} {len(docs.columns)}" for f in FOUND if f.name in docs.columns}
    out = remove_repeats(docs.withColumnsRenamed(aside), with_text=True, **options)
    out = out.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_text"))).drop(*[f.name for f in FOUND])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)
