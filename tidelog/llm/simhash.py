"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints at most d bits apart agree on at least one of d + 1 blocks of bits, so each distinct
fingerprint is dealt out once per block. Within a block value the fingerprints are sorted by Gray rank,
with the shared block's bits first; runs that agree on longer and longer prefixes become the nodes of a
tree, each holding the bits all its members share. A search adds up the differences on the bits that a
node shares beyond its parent and drops the whole group once they exceed d. Block values with more than
`max_block` fingerprints are dealt out again by blocks of their remaining bits before they meet in a task.
Only a spanning forest leaves a task, never all pairs.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Staged, release_memory, staged
from .components import components

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_LANE = (np.arange(8) * 256)[None, :]
_ALL = (1 << 64) - 1


def _digests(text: bytes | None, words_per_shingle: int, seed: int) -> bytes:
    """The 8-byte hashes of a text's shingles, one after the other; nothing for a text without words."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return b""
    k = min(words_per_shingle, len(words))
    joined = b" ".join(words)
    ends = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = ends.cumsum() - 1
    starts = np.r_[0, ends[:-1] + 1][: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist())])


def _majority(raw: bytes) -> int:
    lanes = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8)
    ones = np.zeros((8, 8), dtype=np.int64)
    for at in range(0, len(lanes), 1 << 17):
        seen = np.bincount((lanes[at : at + (1 << 17)] + _LANE).ravel(), minlength=2048).reshape(8, 256)
        ones += seen @ _BITS
    return int.from_bytes(np.packbits(2 * ones.ravel() > len(lanes)).tobytes(), "big")


def fingerprint(text: bytes | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of a whole text; 0 for one without words."""
    return _majority(_digests(text, words_per_shingle, seed))


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (signed long of the 64 bits) for every row."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, words_per_shingle, seed) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Tree over codes in Gray order within groups; links() joins codes of one group within d bits."""

    STEP = 6

    def __init__(self, code: np.ndarray, group: np.ndarray):
        self.order = np.lexsort((gray_rank(code), group))
        self.code, self.group = code[self.order], group[self.order]
        n = len(code)
        fresh = np.r_[True, self.group[1:] != self.group[:-1]] if n else np.zeros(0, bool)
        differ = np.r_[np.uint64(_ALL), self.code[1:] ^ self.code[:-1]] if n else self.code
        self.levels = []  # first leaf, last leaf + 1, shared bits, their pattern
        for bits in [0, *range(self.STEP, 64, self.STEP), 64]:
            top = np.uint64(_ALL ^ ((1 << (64 - bits)) - 1))
            start = np.flatnonzero(fresh | ((differ & top) != 0)) if bits else np.flatnonzero(fresh)
            if not n or self.levels and len(start) == len(self.levels[-1][0]) and bits < 64:
                continue
            both, any_ = np.bitwise_and.reduceat(self.code, start), np.bitwise_or.reduceat(self.code, start)
            self.levels.append((start, np.r_[start[1:], n], ~(both ^ any_), both))

    def links(self, d: int, chunk: int = 1024) -> np.ndarray:
        """Root position (in input order, smallest in index order) of each code's chain of links."""
        n = len(self.code)
        parent = np.arange(n)
        if n:
            sizes = np.diff(np.r_[self.levels[0][0], n])
            busy = np.flatnonzero(np.repeat(sizes > 1, sizes))
            root_of = np.searchsorted(self.levels[0][0], busy, side="right") - 1
            for at in range(0, len(busy), chunk):
                union(parent, *self._search(busy[at : at + chunk], root_of[at : at + chunk], d))
        out = np.empty(n, dtype=np.int64)
        out[self.order] = self.order[parent]
        return out

    def near(self, d: int, most: int = 1 << 18):
        """Every pair of codes of one group within d bits, as arrays of input positions; one search at a time
        looks at about `most` pairs."""
        if not len(self.code):
            return
        starts = self.levels[0][0]
        sizes = np.diff(np.r_[starts, len(self.code)])
        cost = np.repeat(np.where(sizes > 1, sizes, 0), sizes).cumsum()
        at = 0
        while at < len(cost):
            stop = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + most, side="right")))
            query = np.arange(at, stop)
            node = np.searchsorted(starts, query, side="right") - 1
            query, node = query[sizes[node] > 1], node[sizes[node] > 1]
            if len(query):
                i, j = self._search(query, node, d)
                yield self.order[i], self.order[j]
            at = stop

    def _search(self, query: np.ndarray, node: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (earlier, later), in index order, of each query and the codes of its node within d bits."""
        code = self.code
        start, end, shared, pattern = self.levels[0]
        away = np.bitwise_count((code[query] ^ pattern[node]) & shared[node]).astype(np.int64)
        for level in range(1, len(self.levels)):
            below = self.levels[level]
            first = np.searchsorted(below[0], np.maximum(start[node], 0))
            n_kids = np.searchsorted(below[0], end[node]) - first
            kid = np.repeat(first - np.r_[0, n_kids.cumsum()[:-1]], n_kids) + np.arange(n_kids.sum())
            query, node, away = np.repeat(query, n_kids), np.repeat(node, n_kids), np.repeat(away, n_kids)
            on = below[1][kid] - 1 > query  # each pair once, from its earlier code
            query, node, away, kid = query[on], node[on], away[on], kid[on]
            away = away + np.bitwise_count((code[query] ^ below[3][kid]) & below[2][kid] & ~shared[node])
            on = away <= d
            query, node, away = query[on], kid[on], away[on]
            start, end, shared, pattern = below
        many = end[node] - start[node]  # equal codes share a leaf
        leaf = np.repeat(start[node] - (many.cumsum() - many), many) + np.arange(many.sum())
        query = np.repeat(query, many)
        on = leaf > query
        return query[on], leaf[on]


def union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the trees of a[i] and b[i]; parent stays flat, each root the smallest of its tree."""
    while len(a):
        a, b = parent[a], parent[b]
        on = a != b
        a, b = np.minimum(a[on], b[on]), np.maximum(a[on], b[on])
        np.minimum.at(parent, b, a)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def block_masks(width: int, blocks: int) -> list[int]:
    """Masks of `blocks` nearly equal runs of the low `width` bits."""
    edges = [round(i * width / blocks) for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _deal(fps: DataFrame, d: int, max_block: int, depth: int) -> DataFrame:
    """Rows (mask, value, fp): each fingerprint once per block, again by further blocks where one is hot."""
    masks = block_masks(64, d + 1)

    def dealt(df: DataFrame, options: Column) -> DataFrame:
        return df.select("fp", F.explode(options).alias("mask")).select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp")

    rows = dealt(fps, F.array(*[F.lit(_signed(m)) for m in masks]))
    for level in range(1, depth):
        counts = Staged(rows.groupBy("mask", "value").agg(F.count("*").alias("n")).filter(F.col("n") > max_block), "hot").read()
        if counts.isEmpty():
            break
        wider = {}
        for m in {r["mask"] for r in counts.select("mask").distinct().collect()}:  # at most (d + 1) ** level masks
            free = [b for b in range(64) if not (m & _ALL) >> b & 1]
            wider[m] = [_signed((m & _ALL) | sum(1 << free[i] for i in range(len(free)) if x >> i & 1)) for x in block_masks(len(free), d + 1)]
        table = F.create_map(*[x for m, w in wider.items() for x in (F.lit(m), F.array(*map(F.lit, w)))])
        hot = counts.select(F.col("mask").alias("_m"), F.col("value").alias("_v"))
        met = rows.join(hot, (F.col("mask") == F.col("_m")) & (F.col("value") == F.col("_v")), "left")
        rows = met.select("fp", F.explode(F.when(F.col("_m").isNull(), F.array("mask")).otherwise(table[F.col("mask")])).alias("mask"))
        rows = rows.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp")
    return rows


def link_edges(fps: DataFrame, d: int = 2, max_block: int = 2000, depth: int = 3, rows_per_task: int = 2_000_000) -> DataFrame:
    """Edges (a, b) of a spanning forest, per block value, of distinct fingerprints (column fp) within d bits."""

    def run(batches):
        parts = [pa.Table.from_batches([b]) for b in batches]
        if not parts:
            return
        t = pa.concat_tables(parts)
        mask = t.column("mask").to_numpy().view(np.uint64)
        value, fp = t.column("value").to_numpy().view(np.uint64), t.column("fp").to_numpy().view(np.uint64)
        for m in np.unique(mask):
            at = np.flatnonzero(mask == m)
            codes = fp[at]
            _, group = np.unique(value[at], return_inverse=True)
            root = GrayIndex(codes, group).links(d)
            on = root != np.arange(len(root))
            a, b = codes[on].view(np.int64), codes[root[on]].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = _deal(fps, d, max_block, depth)
    # partitions enough for about rows_per_task rows each, whatever the cluster's default
    tasks = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-fps.count() * (d + 1) // rows_per_task))
    return dealt.repartition(tasks, "mask", "value").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, d: int = 2, words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """Per row: doc_id, fp, root (smallest linked fingerprint), component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint 0 and link like any other. Null ids are no candidates for
    component_id (null where a group has no other); repeated rows and ids link through their fingerprint;
    an empty table gives no rows; only doc_id and text are read, so other columns cannot clash.
    """
    marks = staged(fingerprints(docs, words_per_shingle, seed), "fingerprints")
    distinct = staged(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(link_edges(distinct.select("fp"), d))
    placed = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = placed.select(F.col("fp").alias("_fp"), "root").join(least, "root")
    return marks.join(known, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "root", "component_id")


def _shingle_set(raw: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes; a text without words has the one shingle 0."""
    return np.unique(np.frombuffer(raw, dtype=">u8").astype(np.uint64)) if raw else np.zeros(1, np.uint64)


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, key (hash of the text), text, whole (hash of all columns) and `more`."""
    text = F.col("text").cast("string")
    # maps cannot be hashed as they are
    whole = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"), F.xxhash64(*whole).alias("whole"), *more)


#: The prefix of a set holds this share of it beyond what one common shingle needs.
EXTRA = Fraction(1, 5)
MARKS = ["doc_id", "key", "whole", "fp", "n", "prefix"]


def _marks(docs: DataFrame, words_per_shingle: int, similarity: Fraction, seed: int) -> DataFrame:
    """doc_id, key, whole, fp, n (distinct shingles) and prefix (the smallest hashes of the set).

    With o >= similarity * n common shingles, the l-th smallest of them is among the n - o + l smallest of
    either set; the prefix takes l = EXTRA * n. A task sends a text that it meets again without its prefix.
    """

    def run(batches):
        seen: set = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                fps, sizes, prefixes = [], [], []
                for key, text in zip(b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                    raw = _digests(text, words_per_shingle, seed)
                    own = _shingle_set(raw)
                    n = len(own)
                    fps.append(_majority(raw))
                    sizes.append(n)
                    prefixes.append(own[:0] if key in seen else own[: n - math.ceil(similarity * n) + math.ceil(EXTRA * n)])
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(key)
                ends = np.cumsum([0, *map(len, prefixes)], dtype=np.int32)
                flat = np.concatenate(prefixes).view(np.int64)
                data = [b.column(0), b.column(1), b.column(3), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                yield pa.RecordBatch.from_arrays(data, names=MARKS)
            release_memory()

    return _keyed(docs).mapInArrow(run, "doc_id long, key long, whole long, fp long, n int, prefix array<long>")


def _candidates(marks: DataFrame, texts: DataFrame, similarity: Fraction, rounds: int = 4) -> DataFrame:
    """(shingle, key): texts that can have a near copy, by shingles of which similar ones have one in common.

    A text with a near copy shares EXTRA * n' shingles of its prefix with it, where n' >= similarity * n is
    the smaller of the two sets' sizes. Texts that share fewer with all others together are dropped, and as
    that may leave others alone, again; stopping early keeps more texts, never fewer. Of the c shingles that a
    text still shares, the c - need + 1 rarest are kept: of two texts with `need` in common, one is among these
    for either. So a passage in very many texts brings only those together that hold little else.
    """
    shared = Window.partitionBy("shingle")
    rows = marks.select("key", F.explode("prefix").alias("shingle"))
    both = rows.withColumn("_a", F.min("key").over(shared)).withColumn("_b", F.max("key").over(shared)).filter("_a < _b")
    now = Staged(both.select("shingle", "key").distinct(), "shared").read()
    # a double is exact enough: rounded down, it asks for less
    need = texts.select(F.col("key").alias("_k"), F.ceil(F.ceil(F.col("n") * float(similarity) - 1e-6) * float(EXTRA) - 1e-6).alias("_need"))
    able = lambda df: df.groupBy("key").agg(F.count("*").alias("_n")).join(need, F.col("key") == F.col("_k")).filter("_n >= _need")
    left = now.count()
    for _ in range(rounds):
        rest = now.join(able(now).select("key"), "key", "left_semi")
        met = rest.groupBy("shingle").agg(F.count("*").alias("_f")).filter("_f > 1").select("shingle")
        now = Staged(rest.join(met, "shingle", "left_semi"), "shared").read()
        before, left = left, now.count()
        if left > 0.95 * before:
            break
    rare = F.row_number().over(Window.partitionBy("key").orderBy("_f", "shingle"))
    often = now.groupBy("shingle").agg(F.count("*").alias("_f"))
    most = able(now).select("key", (F.col("_n") - F.col("_need") + 1).alias("_most"))
    return now.join(often, "shingle").withColumn("_at", rare).join(most, "key").filter("_at <= _most").select("shingle", "key")


def _sets(docs: DataFrame, keys: DataFrame, words_per_shingle: int, seed: int) -> DataFrame:
    """key and the shingle set, as bytes, of the texts of `keys`; a task sends a text once."""

    def run(batches):
        seen: set = set()
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                if key not in seen:
                    seen.add(key)
                    own = _shingle_set(_digests(text, words_per_shingle, seed))
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([own.tobytes()], pa.binary())], names=["key", "shingles"])

    return _keyed(docs).select("key", "text").join(keys, "key", "left_semi").mapInArrow(run, "key long, shingles binary")


def similar_links(code: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, d: int, similarity: Fraction) -> list[tuple[int, int]]:
    """A spanning forest of the texts within d bits whose sets have the similarity, which is computed for every
    such pair the index finds unless it is linked already. With `side`, only pairs of different sides count."""
    up, down = similarity.numerator, similarity.denominator
    n = np.array([len(x) for x in sets], dtype=np.int64)
    number = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.zeros(0, np.int64)
    first = n.cumsum() - n
    held = np.zeros(int(number.max(initial=-1)) + 1, dtype=bool)
    root = np.arange(len(sets))
    links: list[tuple[int, int]] = []
    for left, right in GrayIndex(code, np.zeros(len(code), dtype=np.int64)).near(d):
        on = (root[left] != root[right]) & (down * np.minimum(n[left], n[right]) >= up * np.maximum(n[left], n[right]))
        if side is not None:
            on &= side[left] != side[right]
        left, right = left[on], right[on]
        order = np.argsort(left, kind="stable")
        left, right = left[order], right[order]
        edge = np.flatnonzero(np.r_[True, left[1:] != left[:-1], True]) if len(left) else [0]
        for a, b in zip(edge[:-1], edge[1:]):
            i = int(left[a])
            own = number[first[i] : first[i] + n[i]]
            held[own] = True
            for at in range(a, b, 128):
                j = right[at : min(b, at + 128)]
                j = j[root[j] != root[i]]
                if not len(j):
                    continue
                size = n[j]
                start = size.cumsum() - size
                both = np.add.reduceat(held[number[np.repeat(first[j] - start, size) + np.arange(size.sum())]].astype(np.int64), start)
                for k in j[both * down >= up * (n[i] + size - both)].tolist():
                    if root[k] != root[i]:
                        links.append((i, k))
                        root[root == root[k]] = root[i]
            held[own] = False
    return links


def near_copies(docs: DataFrame, marks: DataFrame, d: int, words_per_shingle: int, similarity: Fraction, seed: int, block: int = 2048, block_shingles: int = 2_000_000) -> DataFrame:
    """(node, root) of the texts (keys) that have near copies: root is one key of each group.

    Texts that share rare shingles, directly or through others, form clusters, and only texts of one cluster
    can be similar. A cluster is cut into blocks of bounded size, and each two of its blocks, and each block
    alone, meet in a task of their own: there the index finds the pairs within d bits, and their similarity is
    computed on the whole sets. Only a spanning forest leaves a task.
    """
    texts = Staged(marks.groupBy("key").agg(F.first("fp").alias("fp"), F.first("n").alias("n")), "texts").read()
    groups = Staged(_candidates(marks, texts, similarity), "groups").read()
    least = groups.groupBy("shingle").agg(F.min("key").alias("b"))
    clusters = components(groups.select("shingle", F.col("key").alias("a")).join(least, "shingle").select("a", "b"))
    every = clusters.select(F.col("node").alias("own"), "root").unionByName(clusters.select(F.col("root").alias("own"), "root").distinct())
    members = Staged(texts.join(every, F.col("key") == F.col("own")).drop("own"), "members").read()
    size = members.groupBy("root").agg(F.count("*").alias("_k"), F.sum("n").alias("_n")).select(F.col("root").alias("_r"), F.ceil(F.greatest(F.col("_k") / block, F.col("_n") / block_shingles)).cast("int").alias("blocks"))
    placed = members.join(size, F.col("root") == F.col("_r")).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).drop("_r")
    sets = Staged(_sets(docs, members.select("key"), words_per_shingle, seed), "sets").read()
    whole = placed.join(sets, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = whole.select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "key", "fp", "block", "shingles")

    def run(t):
        t = t.combine_chunks()
        key, one = np.unique(t.column("key").to_numpy(), return_index=True)
        block_of = t.column("block").to_numpy()[one]
        sets = [np.frombuffer(x, dtype=np.uint64) for x in t.column("shingles").take(pa.array(one)).to_pylist()]
        side = None if t.column("low")[0].as_py() == t.column("high")[0].as_py() else block_of
        found = similar_links(t.column("fp").to_numpy()[one].view(np.uint64), sets, side, d, similarity)
        del sets
        release_memory()
        return pa.table([pa.array(key[[i for i, _ in found]], pa.int64()), pa.array(key[[j for _, j in found]], pa.int64())], names=["a", "b"])

    return components(cells.groupBy("root", "low", "high").applyInArrow(run, "a long, b long"))


def keep_one(docs: DataFrame, d: int = 20, words_per_shingle: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """`docs` without near-duplicates: of each group the row with the smallest doc_id, columns unchanged.

    Texts are linked whose fingerprints differ in at most d bits and whose sets of shingles have that
    Jaccard similarity, which is computed for every candidate. The Gray-order index runs among the texts
    that share a shingle of their prefixes and enough of them to be similar to any other text; similar
    sets always do, so this loses no link. Texts without words are alike. Null ids come last; of rows alike in id and
    text the one whose columns, as JSON, have the smallest hash stays. Equal texts are told by a 64-bit
    hash. An empty table gives no rows. Columns may have any names.
    """
    share = Fraction(str(similarity))
    marks = staged(_marks(docs, words_per_shingle, share, seed), "marks")
    roots = near_copies(docs, marks, d, words_per_shingle, share, seed)
    own = marks.groupBy("key", "doc_id", "whole").agg(F.count("*").alias("alike"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "whole", "alike")
    firsts = own.groupBy("key").agg(F.min(first).alias("first"))
    known = firsts.join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))
    least = known.groupBy("root").agg(F.min(F.struct("first", "key")).alias("k"))
    one = staged(least.select(F.col("k.first.doc_id").alias("id"), F.col("k.first.whole").alias("hash"), F.col("k.key").alias("own"), F.col("k.first.alike").alias("alike")), "kept")
    # the columns of `docs` travel inside one struct, so that none can clash
    rows = _keyed(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    met = rows.join(one, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("own")) & (F.col("whole") == F.col("hash")))
    if one.filter("alike > 1").isEmpty():
        return met.select("row.*")
    repeated = met.filter("alike > 1").dropDuplicates(["id", "own"])
    return met.filter("alike = 1").unionByName(repeated).select("row.*")
