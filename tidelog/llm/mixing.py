"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Blocks go one by one to the source with the highest quotient weight / (2 * blocks + 1), stopping at
`max_passes` times a source's tokens; a source's blocks are apportioned the same way to its shards. Within
a shard, whole passes come first; what is left is filled with blocks in a seeded order: runs of documents of
about `block_words` words, and pieces of longer documents. Documents stay whole but for those longer than a
block and one at the end of each shard's quota, which is taken in part. Rows alike in id, source and size are
one unit and are taken alike, so a repeated row is no group of its own. Only one row per source reaches the
driver.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import staged

#: Above this many sources the per-source table is joined by shuffle instead of being broadcast.
BROADCAST_SOURCES = 50_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def water_fill(sizes: list[int], weights: list[float], max_passes: float) -> list[float]:
    """Targets that share sum(sizes) by weight; none above max_passes * size, the excess reshared."""
    total, target, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while free:
        unit = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / unit > max_passes * sizes[i]}
        if not over:
            for i in free:
                target[i] = left * weights[i] / unit
            break
        for i in over:
            target[i] = float(max_passes * sizes[i])
        left -= sum(target[i] for i in over)
        free -= over
    return target


def sainte_lague(weights, seats: int, caps) -> np.ndarray:
    """Seats by highest quotients w / (2s + 1), at most caps[i] each; ties to the first.

    The common divisor is bisected first, so the number of seats does not matter for speed; the last
    few seats go by the quotients themselves.
    """
    w, cap = np.asarray(weights, dtype=float), np.asarray(caps, dtype=np.int64)
    cap = np.where(w > 0, cap, 0)
    if cap.sum() <= seats:
        return cap

    def given(divisor: float) -> np.ndarray:
        return np.minimum(cap, np.floor(np.minimum(w / divisor + 0.5, 2.0**62)).astype(np.int64))

    low, high = w.max() / (4.0 * (seats + 1)) / max(1.0, 1.0), 4.0 * w.max() + 1.0
    while given(low).sum() < seats:
        low /= 4
    for _ in range(200):
        mid = (low + high) / 2
        if given(mid).sum() > seats:
            low = mid
        else:
            high = mid
    got = given(high)
    heap = [(-w[i] / (2 * got[i] + 1), i) for i in range(len(w)) if got[i] < cap[i]]
    heapq.heapify(heap)
    for _ in range(int(seats - got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < cap[i]:
            heapq.heappush(heap, (-w[i] / (2 * got[i] + 1), i))
    return got


def count_words(texts: list[bytes | None]) -> list[int]:
    return [0 if t is None else len(t.split()) for t in texts]


def _sizes(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            n = count_words(b.column(2).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "size"])

    cols = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return cols.mapInArrow(run, "doc_id long, source string, size long")


def fill_shard(sizes: np.ndarray, rows: np.ndarray, order: np.ndarray, quota: int, max_passes: int, block_words: int) -> tuple[np.ndarray, list[list[int]]]:
    """For each unit of a shard (`rows` documents of sizes[i] words, in the seeded order `order`): whole
    copies, and the word ranges of one copy more that is taken in part."""
    none: list[list[int]] = [[] for _ in sizes]
    total = int((sizes * rows).sum())
    if not total:
        return np.zeros(len(sizes), dtype=np.int64), none
    base = min(quota // total, max_passes)
    rest = quota - base * total if base < max_passes else 0
    copies = np.full(len(sizes), base, dtype=np.int64)
    if not rest:
        return copies, none
    by = np.argsort(order, kind="stable")
    most = np.maximum(1, block_words // rows[by])  # words of each document in one piece
    n = -(-sizes[by] // most)
    unit = np.repeat(by, n)
    k = np.arange(len(unit)) - np.repeat(n.cumsum() - n, n)
    start = k * np.repeat(most, n)
    stop = np.minimum(start + np.repeat(most, n), sizes[unit])
    weight = (stop - start) * rows[unit]
    # a document of one piece is in the block where it starts; the pieces of a longer one are a block each
    block = np.where(np.repeat(n, n) > 1, np.arange(len(unit)) + total, (weight.cumsum() - weight) // block_words)
    _, block = np.unique(block, return_inverse=True)
    turn = np.random.default_rng(abs(int(order[by[0]]))).permutation(int(block.max()) + 1)[block]
    seq = np.lexsort((np.arange(len(unit)), turn))
    upto = weight[seq].cumsum()
    whole = int(np.searchsorted(upto, rest, side="right"))
    taken = [(int(unit[i]), int(start[i]), int(stop[i])) for i in seq[:whole]]
    if whole < len(seq):
        i = seq[whole]
        words = int((rest - (upto[whole - 1] if whole else 0)) // rows[unit[i]])
        if words:
            taken.append((int(unit[i]), int(start[i]), int(start[i]) + words))
    for u, a, b in sorted(taken):
        if none[u] and none[u][-1] == a:
            none[u][-1] = b
        else:
            none[u] += [a, b]
        if none[u] == [0, sizes[u]]:
            none[u] = []
            copies[u] += 1
    return copies, none


KEYS = ["doc_id", "source", "size"]


def _decided(docs: DataFrame, weights, max_passes: int, block_tokens: int, shard_units: int, block_words: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size) of every row, and per unit source_size, target, copies and part."""
    spark = docs.sparkSession
    sizes = staged(_sizes(docs), "sizes")
    units = staged(sizes.groupBy(*KEYS).agg(F.count("*").alias("rows")).withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "size")), "units")
    per_source = [r.asDict() for r in units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("size"), F.count("*").alias("n")).collect()]
    per_source.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    size = [int(r["size"]) for r in per_source]
    weight = [float(weights[i % len(weights)]) for i in range(len(size))]
    target = water_fill(size, weight, max_passes)
    blocks = sainte_lague(weight, round(sum(size) / block_tokens), [-(-max_passes * s // block_tokens) for s in size]) if size else []
    table = pd.DataFrame({"name": [r["source"] for r in per_source], "source_size": size, "target": target, "blocks": blocks, "shards": [max(1, -(-r["n"] // shard_units)) for r in per_source], "at": range(len(size))})
    known = spark.createDataFrame(table, "name string, source_size long, target double, blocks long, shards int, at int")
    if len(size) <= BROADCAST_SOURCES:
        known = F.broadcast(known)
    placed = units.join(known, F.col("source").eqNullSafe(F.col("name"))).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "order"), F.col("shards")).cast("int"))

    def apportion(t):
        t = t.sort_by("shard").combine_chunks()
        held = t.column("held").to_numpy()
        given = sainte_lague(held, t.column("blocks")[0].as_py(), -(-max_passes * held // block_tokens))
        return pa.table([t.column("at"), t.column("shard"), pa.array(np.minimum(given * block_tokens, max_passes * held))], names=["own", "part_of", "quota"])

    held = placed.groupBy("at", "shard").agg(F.sum(F.col("size") * F.col("rows")).alias("held"), F.max("blocks").alias("blocks"))
    quotas = staged(held.groupBy("at").applyInArrow(apportion, "own int, part_of int, quota long"), "quotas")
    placed = placed.join(quotas, (F.col("at") == F.col("own")) & (F.col("shard") == F.col("part_of")))
    out = [*KEYS, "source_size", "target"]

    def run(t):
        t = t.sort_by([("order", "ascending"), ("doc_id", "ascending"), ("size", "ascending")]).combine_chunks()
        copies, part = fill_shard(t.column("size").to_numpy(), t.column("rows").to_numpy(), t.column("order").to_numpy(), t.column("quota")[0].as_py(), max_passes, block_words)
        return t.select(out).append_column("copies", pa.array(copies, pa.int32())).append_column("part", pa.array(part, pa.list_(pa.int64())))

    schema = "doc_id long, source string, size long, source_size long, target double, copies int, part array<long>"
    return sizes, placed.groupBy("at", "shard").applyInArrow(run, schema)


def _met(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows (doc_id, source, size, ...) with the columns of their unit's decision."""
    names = {c: f"of_{c}" for c in KEYS}
    on = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    return rows.join(decided.withColumnsRenamed(names), on[0] & on[1] & on[2]).drop(*names.values())


def mix(docs: DataFrame, weights=(1, 2, 3), max_passes: int = 3, block_tokens: int = 16, shard_units: int = 4096, block_words: int = 4096, seed: int = 7) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, part, taken.

    `copies` whole copies are taken, and the word ranges `part` (start, stop, start, stop, ...) of one more;
    taken counts their words. Sources in code-point order, null last, weigh `weights` in turn. Null and empty
    texts have size 0 and are taken 0 times; a null or repeated doc_id is allowed, rows alike in id, source
    and size are taken alike; ties of the seeded order go by id and size; an empty table gives no rows. Only
    doc_id, source and text are read, so other columns cannot clash.
    """
    sizes, decided = _decided(docs, weights, max_passes, block_tokens, shard_units, block_words, seed)
    words = F.aggregate(F.sequence(F.lit(1), F.size("part") - 1, F.lit(2)), F.lit(0).cast("long"), lambda a, i: a + F.get("part", i) - F.get("part", i - 1))
    words = F.when(F.size("part") > 0, words).otherwise(0)
    return _met(sizes, decided).withColumn("taken", (F.col("copies") * F.col("size") + words).cast("long"))


def cut_words(text: bytes, part: list[int]) -> bytes:
    """The word ranges of a text, white space inside them kept, one after the other on lines of their own."""
    spans = [m.span() for m in _WORD.finditer(text)]
    return b"\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in zip(part[::2], part[1::2]))


def apply_mix(docs: DataFrame, weights=(1, 2, 3), max_passes: int = 3, block_tokens: int = 16, shard_units: int = 4096, block_words: int = 4096, seed: int = 7) -> DataFrame:
    """The mixed table: every row of `docs` as often as mix() takes it, columns unchanged.

    A copy taken in part has the words taken as its text, and its n_chars, if there, counted anew. Null and
    empty texts are not taken; an empty table gives no rows; columns may have any names.
    """
    _, decided = _decided(docs, weights, max_passes, block_tokens, shard_units, block_words, seed)
    decided = decided.filter("copies > 0 or size(part) > 0").drop("source_size", "target")
    names = docs.columns
    at = names.index("text")
    plain = [f"c{i}" for i in range(len(names))]  # the columns by place, so that none can clash
    kinds = [f.dataType for f in docs.schema.fields]
    schema = T.StructType([T.StructField(c, k) for c, k in zip(plain, kinds)] + [T.StructField("size", T.LongType())])

    def sized(batches):
        for b in batches:
            n = count_words(b.column(at).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=schema.names)

    rows = docs.toDF(*plain).mapInArrow(sized, schema)
    keyed = rows.withColumn("doc_id", F.col(plain[names.index("doc_id")]).cast("long")).withColumn("source", F.col(plain[names.index("source")]).cast("string"))
    whole = F.transform(F.filter(F.sequence(F.lit(0), "copies"), lambda i: i > 0), lambda i: F.lit(None).cast("array<long>"))
    versions = F.concat(whole, F.when(F.size("part") > 0, F.array("part")).otherwise(F.array().cast("array<array<long>>")))
    taken = _met(keyed, decided).withColumn("version", F.explode(versions)).select(*plain, "version")
    chars = names.index("n_chars") if "n_chars" in names else None
    out = T.StructType(schema.fields[:-1])

    def cut(batches):
        for b in batches:
            cols = list(b.columns[:-1])
            some = [i for i, part in enumerate(b.column(len(cols)).to_pylist()) if part]
            if some:
                parts, texts = b.column(len(cols)).to_pylist(), cols[at].to_pylist()
                counts = cols[chars].to_pylist() if chars is not None else []
                for i in some:
                    texts[i] = cut_words(texts[i].encode(), parts[i]).decode()
                    if counts:
                        counts[i] = len(texts[i])
                cols[at] = pa.array(texts, cols[at].type)
                if counts:
                    cols[chars] = pa.array(counts, cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names=out.names)

    return taken.mapInArrow(cut, out).toDF(*names)
