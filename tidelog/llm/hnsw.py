"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Equal vectors are merged first and keep their smallest ids, so copies cannot crowd a graph. Shards are
dealt out by a hash of the vector; each is built in numpy, many insertions and searches at a time, and
stored as flat neighbour arrays. Every query meets every shard, in blocks of many more queries than a shard
has vectors, so that a shard travels seldom and the queries make most of what is moved; the shards' best are
merged by their exact inner product in double precision on the original vectors.

Largest inner product becomes smallest distance by one further coordinate, sqrt(max |x|^2 - |x|^2) for
stored vectors and 0 for queries.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import staged


@dataclass
class Graph:
    """Flat neighbour arrays: per level the nodes on it and, row by row, their neighbours (-1: none)."""

    x: np.ndarray  # float32, with the further coordinate
    m: int
    nodes: list[np.ndarray] = field(default_factory=list)
    links: list[np.ndarray] = field(default_factory=list)
    entry: int = 0

    def _beam(self, q: np.ndarray, start: np.ndarray, level: int, ef: int, wide: int = 4):
        """Best `ef` nodes of a level for each query, from nodes start[b]: ids (-1: none) and distances."""
        n, b = len(self.x), len(q)
        links, row = self.links[level], self._row[level]
        seen = np.zeros((b, n), dtype=np.int32)
        each = np.arange(b)
        ids = np.full((b, ef), -1, dtype=np.int64)
        away = np.full((b, ef), np.inf, dtype=np.float32)
        done = np.ones((b, ef), dtype=bool)
        s = start.shape[1]
        d0 = self._away(q, start)
        seen[each[:, None], start] = 1
        ids[:, :s], away[:, :s], done[:, :s] = start, d0, False
        live = each
        while len(live):
            open_away = np.where(done[live], np.inf, away[live])
            pick = np.argpartition(open_away, min(wide, ef) - 1, axis=1)[:, : min(wide, ef)]
            chosen = np.take_along_axis(open_away, pick, axis=1) < np.inf
            keep = chosen.any(axis=1)
            live, pick, chosen = live[keep], pick[keep], chosen[keep]
            if not len(live):
                break
            at = ids[live[:, None], pick]
            flags = done[live]
            np.put_along_axis(flags, pick, True, axis=1)
            done[live] = flags
            near = np.where(chosen[:, :, None], links[row[np.where(chosen, at, 0)]], -1).reshape(len(live), -1)
            fresh = (near >= 0) & (seen[live[:, None], near] == 0)
            order = np.arange(1, near.shape[1] + 1, dtype=np.int32)
            r, c = np.nonzero(fresh)
            seen[live[r], near[r, c]] = order[c]
            fresh[r, c] = seen[live[r], near[r, c]] == order[c]  # one of each within a step
            r, c = np.nonzero(fresh)
            found = np.full(near.shape, np.inf, dtype=np.float32)
            node = near[r, c]
            diff = self.x[node] - q[live[r]]
            found[r, c] = np.einsum("ij,ij->i", diff, diff)
            all_away = np.concatenate([away[live], found], axis=1)
            best = np.argpartition(all_away, ef - 1, axis=1)[:, :ef]
            away[live] = np.take_along_axis(all_away, best, axis=1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1), best, axis=1)
            done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], axis=1), best, axis=1)
        turn = np.argsort(away, axis=1, kind="stable")
        return np.take_along_axis(ids, turn, axis=1), np.take_along_axis(away, turn, axis=1)

    def _away(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        diff = self.x[np.maximum(nodes, 0)] - q[:, None, :]
        return np.where(nodes < 0, np.inf, np.einsum("bkd,bkd->bk", diff, diff)).astype(np.float32)

    def index_rows(self) -> None:
        self._row = []
        for nodes in self.nodes:
            row = np.zeros(len(self.x), dtype=np.int64)
            row[nodes] = np.arange(len(nodes))
            self._row.append(row)

    def search(self, q: np.ndarray, ef: int, block: int | None = None) -> np.ndarray:
        """Ids of about the `ef` nearest nodes of each query, nearest first, -1 where there are fewer."""
        n = len(self.x)
        block = block or max(16, min(512, (1 << 24) // max(1, n)))
        out = np.full((len(q), ef), -1, dtype=np.int64)
        for at in range(0, len(q), block):
            part = q[at : at + block]
            start = np.full((len(part), 1), self.entry)
            for level in range(len(self.nodes) - 1, 0, -1):
                start = self._beam(part, start, level, 4, wide=1)[0][:, :1]
            out[at : at + block] = self._beam(part, start, 0, ef)[0]
        return out

    def _select(self, base: np.ndarray, cand: np.ndarray, away: np.ndarray, m: int) -> np.ndarray:
        """Of each row's candidates (by distance, -1: none) up to m that are nearer to the base than to one
        another; places left over go to the nearest of the others."""
        b, c = cand.shape
        v = self.x[np.maximum(cand, 0)]
        sq = np.einsum("bcd,bcd->bc", v, v)
        between = sq[:, :, None] + sq[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
        kept = np.zeros((b, c), dtype=bool)
        n = np.zeros(b, dtype=np.int64)
        usable = (cand >= 0) & (cand != base[:, None])
        for k in range(c):
            hidden = (kept & (between[:, k, :] < away[:, k : k + 1])).any(axis=1)
            kept[:, k] = usable[:, k] & ~hidden & (n < m)
            n += kept[:, k]
        rank = np.where(kept, 0, np.where(usable, 1, 2)) * (c + 1) + np.arange(c)
        take = np.argsort(rank, axis=1, kind="stable")[:, :m]
        out = np.take_along_axis(cand, take, axis=1)
        return np.where(np.take_along_axis(usable, take, axis=1), out, -1)

    def _insert(self, new: np.ndarray, start: np.ndarray, level: int, ef: int) -> np.ndarray:
        """Link `new` nodes on a level; returns their nearest nodes there, for the level below."""
        width = self.links[level].shape[1]
        row = self._row[level]
        q = self.x[new]
        ids, away = self._beam(q, start, level, ef)
        own = np.einsum("id,jd->ij", q, q)
        sq = np.diag(own)
        own = (sq[:, None] + sq[None, :] - 2 * own).astype(np.float32)
        np.fill_diagonal(own, np.inf)
        k = min(width, len(new) - 1)
        if k > 0:  # nodes inserted together see each other too
            mates = np.argpartition(own, k - 1, axis=1)[:, :k]
            ids, away = np.concatenate([ids, new[mates]], axis=1), np.concatenate([away, np.take_along_axis(own, mates, axis=1)], axis=1)
        turn = np.argsort(away, axis=1, kind="stable")[:, : 2 * width]
        ids, away = np.take_along_axis(ids, turn, axis=1), np.take_along_axis(away, turn, axis=1)
        chosen = self._select(new, ids, away, self.m)
        self.links[level][row[new], : chosen.shape[1]] = chosen
        u, v = np.repeat(new, chosen.shape[1]), chosen.ravel()
        u, v = u[v >= 0], v[v >= 0]
        turn = np.lexsort((u, v))
        u, v = u[turn], v[turn]
        target, first, n = np.unique(v, return_index=True, return_counts=True)
        most = min(int(n.max(initial=0)), 2 * width)
        slot = np.arange(len(v)) - np.repeat(first, n)
        for at in range(0, len(target), 512):
            some = target[at : at + 512]
            back = np.full((len(some), most), -1, dtype=np.int64)
            lo, hi = first[at], first[at] + n[at : at + 512].sum()
            on = slot[lo:hi] < most
            back[np.repeat(np.arange(len(some)), n[at : at + 512])[on], slot[lo:hi][on]] = u[lo:hi][on]
            old = self.links[level][row[some]]
            back[(back[:, :, None] == old[:, None, :]).any(axis=2)] = -1
            cand = np.concatenate([old, back], axis=1)
            gap = self._away(self.x[some], cand)
            turn = np.argsort(gap, axis=1, kind="stable")
            cand, gap = np.take_along_axis(cand, turn, axis=1), np.take_along_axis(gap, turn, axis=1)
            fits = (cand >= 0).sum(axis=1) <= width
            out = cand[:, :width].copy()
            if (~fits).any():
                part = min(cand.shape[1], 2 * width)
                out[~fits] = self._select(some[~fits], cand[~fits, :part], gap[~fits, :part], width)
            self.links[level][row[some], : out.shape[1]] = out
        return ids[:, :1]


def augmented(v: np.ndarray) -> np.ndarray:
    sq = np.einsum("ij,ij->i", v, v)
    return np.c_[v, np.sqrt(np.maximum(sq.max(initial=0) - sq, 0))].astype(np.float32)


def build_graph(v: np.ndarray, m: int = 16, ef: int = 96, seed: int = 5) -> Graph:
    """Graph over rows of v; level sizes fall by a factor m, insertions go in blocks of up to a sixth of it."""
    g, n = Graph(augmented(v), m), len(v)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    level = np.minimum((-np.log(np.maximum(rng.random(n), 1e-300)) / np.log(m)).astype(int), 8)
    level[order[0]] = top = int(level.max(initial=0))
    g.entry = int(order[0])
    g.nodes = [order[level[order] >= k] for k in range(top + 1)]
    g.links = [np.full((len(x), (2 if k == 0 else 1) * m), -1, dtype=np.int64) for k, x in enumerate(g.nodes)]
    g.index_rows()
    at = 1
    while at < n:
        new = order[at : at + max(1, min(256, at // 6))]
        at += len(new)
        near = np.full((len(new), 1), g.entry)
        for k in range(top, -1, -1):
            on = level[new] >= k
            if (~on).any():
                near[~on] = g._beam(g.x[new[~on]], near[~on], k, 4, wide=1)[0][:, :1]
            if on.any():
                near[on] = g._insert(new[on], near[on], k, ef)
    return g


def _clean(rows: DataFrame) -> DataFrame:
    """vec_id, v (bytes of doubles): rows without a null, zero, empty or non-finite vector, or a null id."""

    def run(batches):
        for b in batches:
            ids, out = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                values = v.values
                if i is None or values is None or values.null_count or not len(values):
                    continue
                x = values.to_numpy().astype(np.float64)
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    out.append((x + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "v"])

    return rows.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, v binary")


INDEX = "dim int, shard int, vectors binary, starts binary, ids binary, nodes array<binary>, links array<binary>"


def build_index(rows: DataFrame, k: int = 20, m: int = 16, ef: int = 96, min_shards: int = 8, shard_rows: int = 8192) -> DataFrame:
    """One row per shard: its distinct vectors, their k + 1 smallest ids, and the graph's flat arrays.

    Within shards of 8192 vectors of 64 dimensions, searched with 256 candidates, recall at 20 is about 0.93
    for Gaussian noise, the hardest case, and above 0.99 for vectors in clusters.
    """
    ranked = _clean(rows).distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    distinct = staged(ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    shards = max(min_shards, -(-distinct.count() // shard_rows))

    def run(key, t):
        t = t.combine_chunks()
        v = np.frombuffer(b"".join(t.column("v").to_pylist()), dtype=np.float64).reshape(t.num_rows, -1)
        ids = t.column("ids").to_pylist()
        turn = sorted(range(len(v)), key=lambda i: ids[i])
        v, ids = v[turn], [ids[i] for i in turn]
        g = build_graph(v, m, ef)
        starts = np.r_[0, np.cumsum([len(i) for i in ids])]
        row = {"dim": v.shape[1], "shard": key[1].as_py(), "vectors": v.tobytes(), "starts": starts.astype(np.int64).tobytes(), "ids": np.concatenate(ids).astype(np.int64).tobytes(), "nodes": [x.astype(np.int32).tobytes() for x in g.nodes], "links": [x.astype(np.int32).tobytes() for x in g.links]}
        return pa.Table.from_pylist([row], schema=pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("vectors", pa.binary()), ("starts", pa.binary()), ("ids", pa.binary()), ("nodes", pa.list_(pa.binary())), ("links", pa.list_(pa.binary()))]))

    dealt = distinct.withColumn("dim", F.expr("cast(octet_length(v) div 8 as int)")).withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    return dealt.groupBy("dim", "shard").applyInArrow(run, INDEX)


def open_shard(row: dict) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    v = np.frombuffer(row["vectors"], dtype=np.float64).reshape(-1, row["dim"])
    nodes = [np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in row["nodes"]]
    links = [np.frombuffer(x, dtype=np.int32).astype(np.int64).reshape(len(a), -1) for x, a in zip(row["links"], nodes)]
    g = Graph(augmented(v), links[-1].shape[1], nodes, links, int(nodes[-1][0]))
    g.index_rows()
    return g, v, np.frombuffer(row["starts"], dtype=np.int64), np.frombuffer(row["ids"], dtype=np.int64)


def search(index: DataFrame, queries: DataFrame, k: int = 20, ef: int = 256, block: int = 65_536) -> DataFrame:
    """query_id, rank, vec_id, score: the k found of largest inner product for each query row (vec_id, embedding).

    A query's own id is no candidate. Null, zero or non-finite vectors and null ids take no part; vectors
    only meet those of their own length; repeated rows count once; ties go to the smaller id; an empty
    table gives no rows; other columns are not read.
    """
    asked = staged(_clean(queries).distinct().select(F.col("vec_id").alias("query_id"), "v", F.expr("cast(octet_length(v) div 8 as int)").alias("dim")), "queries")
    index = staged(index, "index")
    blocks = max(1, -(-asked.count() // block))
    shards = index.select("dim", "shard")  # a row per shard: small beside either side
    n_shards = (shards.agg(F.max("shard")).first()[0] or 0) + 1
    left = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    right = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(key, q, shard):
        if not q.num_rows or not shard.num_rows:
            return schema.empty_table()
        g, v, starts, ids = open_shard(shard.to_pylist()[0])
        asked = np.frombuffer(b"".join(q.column("v").to_pylist()), dtype=np.float64).reshape(q.num_rows, -1)
        names = q.column("query_id").to_numpy()
        found = g.search(np.c_[asked, np.zeros(len(asked))].astype(np.float32), min(max(ef, k + 1), max(len(v), 2)))
        rows = []
        for name, x, near in zip(names, asked, found):
            near = near[near >= 0]
            score = (v[near] * x).sum(axis=1)
            best = near[np.argsort(-score, kind="stable")[: k + 1]]
            n = starts[best + 1] - starts[best]
            who = ids[np.repeat(starts[best] - np.r_[0, n.cumsum()[:-1]], n) + np.arange(n.sum())]
            what = np.repeat((v[best] * x).sum(axis=1), n)
            on = who != name
            turn = np.lexsort((who[on], -what[on]))[:k]
            rows.append((np.full(len(turn), name), who[on][turn], what[on][turn]))
        return pa.table([np.concatenate(c) for c in zip(*rows)], schema=schema)

    keys = ["dim", "shard", "block"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    one = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return one.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
