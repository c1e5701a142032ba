"""Quality classifier: a factorisation machine over hashed words and structure statistics.

score = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j); the pairwise sum is taken in linear
time as half of (sum v_i x_i)^2 - sum (v_i x_i)^2 per factor. It is fitted with AdaGrad in numpy on a
bounded sample of labelled rows; every text is then scored whole, where it lies.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import release_memory

#: Words are hashed to this many features; structure statistics follow them.
HASHED = 1 << 16
#: Statistics of a text; each gives its value and a one-hot bucket of it.
STATS = ["words", "word_length", "upper", "digit", "symbol", "exclaim", "bar", "distinct", "top_word", "lines", "dup_lines", "high_bytes", "n_chars"]
_EDGES = {
    "words": [1, 10, 25, 50, 100, 200, 500, 1000, 5000],
    "word_length": [2, 3, 4, 5, 6, 8, 12],
    "lines": [1, 2, 4, 8, 16, 64],
    "n_chars": [0, 1, 100, 300, 1000, 3000, 10_000, 30_000],  # the metadata; absent counts as -1
}
_SHARE = [0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75]
BUCKETS = 10
N_FEATURES = HASHED + len(STATS) * (1 + BUCKETS)
_slots: dict[bytes, int] = {}


def _slot(word: bytes) -> int:
    at = _slots.get(word)
    if at is None:
        if len(_slots) > 300_000:
            _slots.clear()
        at = _slots[word] = zlib.crc32(word) % HASHED
    return at


def statistics(text: bytes, words: Counter, n_words: int) -> list[float]:
    seen = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    n = max(1, len(text))
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    symbols = int(seen[[35, 42, 36, 37, 38, 60, 62]].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        float(n_words), n / max(1, n_words), upper / max(1, upper + lower), seen[48:58].sum() / n, symbols / max(1, n_words),
        seen[33] / max(1, n_words), seen[124] / max(1, n_words), len(words) / max(1, n_words), max(words.values(), default=0) / max(1, n_words),
        float(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), seen[128:].sum() / n,
    ]


def features(text: bytes | None, n_chars: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's features; a null or empty text has those of no words, and the metadata
    n_chars may be null."""
    text = text or b""
    words = Counter(text.split())
    n_words = sum(words.values())
    at = np.fromiter(map(_slot, words), dtype=np.int64, count=len(words))
    value = np.log1p(np.fromiter(words.values(), dtype=np.float64, count=len(words)))
    value /= max(1e-9, float(np.sqrt((value * value).sum())))
    more_at, more = [], []
    for k, (name, x) in enumerate(zip(STATS, [*statistics(text, words, n_words), -1.0 if n_chars is None else float(n_chars)])):
        base = HASHED + k * (1 + BUCKETS)
        more_at += [base, base + 1 + int(np.searchsorted(_EDGES.get(name, _SHARE), x, side="right"))]
        more += [min(1.0, float(np.log1p(max(x, 0))) / 10) if name in _EDGES else min(1.0, float(x)), 1.0]
    return np.concatenate([at, more_at]).astype(np.int64), np.concatenate([value, more])


@dataclass
class FactorMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, at: np.ndarray, value: np.ndarray) -> float:
        part = self.factors[at] * value[:, None]
        total = part.sum(axis=0)
        return float(self.bias + self.linear[at] @ value + 0.5 * (total @ total - (part * part).sum()))

    def score(self, text: bytes | None, n_chars: int | None = None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(*features(text, n_chars)), -40, 40))))


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray, int]], rank: int = 8, steps: int = 600, batch: int = 128, rate: float = 0.1, l2: float = 1e-5, seed: int = 1) -> FactorMachine:
    rng = np.random.default_rng(seed)
    linear = np.zeros(N_FEATURES)
    factors = rng.normal(0, 0.02, (N_FEATURES, rank))
    share = (sum(y for *_, y in rows) + 1) / (len(rows) + 2)
    bias, bias_sq = float(np.log(share / (1 - share))), 1e-6
    linear_sq, factors_sq = np.full(N_FEATURES, 1e-6), np.full((N_FEATURES, rank), 1e-6)
    done = 0
    while rows and done < steps:  # a few labels are gone through as often as many are once
        turn = rng.permutation(len(rows))
        for first in range(0, len(turn), batch):
            done += 1
            part = [rows[i] for i in turn[first : first + batch]]
            n = np.array([len(r[0]) for r in part])
            start = np.r_[0, n.cumsum()[:-1]]
            at, x, y = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part]), np.array([r[2] for r in part], dtype=float)
            row = np.repeat(np.arange(len(part)), n)
            vx = factors[at] * x[:, None]
            total = np.add.reduceat(vx, start)
            z = bias + np.add.reduceat(linear[at] * x, start) + 0.5 * ((total * total).sum(1) - np.add.reduceat((vx * vx).sum(1), start))
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(part)
            gx = g[row] * x
            used, slot = np.unique(at, return_inverse=True)
            g_lin = np.bincount(slot, gx, len(used)) + l2 * linear[used]
            g_each = gx[:, None] * (total[row] - vx)
            g_fac = np.stack([np.bincount(slot, g_each[:, f], len(used)) for f in range(rank)], axis=1) + l2 * factors[used]
            bias_sq += g.sum() ** 2
            linear_sq[used] += g_lin**2
            factors_sq[used] += g_fac**2
            bias -= rate * g.sum() / np.sqrt(bias_sq)
            linear[used] -= rate * g_lin / np.sqrt(linear_sq[used])
            factors[used] -= 0.3 * rate * g_fac / np.sqrt(factors_sq[used])
    return FactorMachine(bias, linear.astype(np.float32), factors.astype(np.float32))


def held_out(doc_id):
    """Column: crc32 of doc_id as text is divisible by 5; such rows are never learned from (null id: held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, seed: int = 1, **options) -> FactorMachine:
    """Fit on at most `max_rows` labelled rows (the bound of the sample), those of smallest seeded hash.

    Rows with a null id or label and held-out rows are not learned from. Of documents with one id, the one
    whose text has the smallest hash is taken, so the sample's bound holds whatever repeats.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y")).filter("_id is not null and _y is not null")
    chosen = usable.filter(~held_out(F.col("_id"))).orderBy(F.xxhash64(F.lit(seed), "_id"), "_id", "_y").limit(max_rows)

    def run(batches):
        for b in batches:
            got = [features(t, n) for t, n in zip(b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([a.astype(np.int32) for a, _ in got], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in got], pa.list_(pa.float32()))], names=["id", "y", "at", "x"])

    # the sample is bounded by max_rows, so it may be broadcast
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_text_and_length(docs)).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    one = met.groupBy("_id", "_y").agg(F.min_by(F.struct("text", "n_chars"), F.xxhash64("text", "n_chars")).alias("d"))
    got = one.select("_id", "_y", "d.text", "d.n_chars").mapInArrow(run, "id long, y int, at array<int>, x array<float>").toArrow()
    rows = [(a.astype(np.int64), x.astype(np.float64), y) for a, x, y, _ in sorted(zip((np.asarray(v) for v in _lists(got, "at")), (np.asarray(v) for v in _lists(got, "x")), got.column("y").to_pylist(), got.column("id").to_pylist()), key=lambda r: (r[3], r[2], len(r[0]), float(r[1].sum())))]
    return fit_rows(rows, seed=seed, **options)


def _lists(table: pa.Table, name: str):
    for chunk in table.column(name).chunks:
        values, at = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        yield from (values[a:b] for a, b in zip(at, at[1:]))


def _text_and_length(docs: DataFrame) -> list:
    return [F.col("text").cast("string").alias("text"), (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("long").alias("n_chars")]


def _scores(docs: DataFrame, model: FactorMachine):
    """A function from a batch of `docs` to its scores."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def score(b) -> list[float]:
        lengths = b.column(chars).cast(pa.int64()).to_pylist() if chars is not None else [None] * b.num_rows
        return [sent.value.score(t, n) for t, n in zip(b.column(at).cast(pa.binary()).to_pylist(), lengths)]

    return score


def add_score(docs: DataFrame, model: FactorMachine, column: str = "_score") -> DataFrame:
    """`docs` with double column `column` in 0..1, in place of one of that name; null and empty texts have a
    score like any other. Rows are scored each on their own; only text and, if there, n_chars are read."""
    docs = docs.drop(column)
    score = _scores(docs, model)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score(b), pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """Rows of `docs` that score `threshold` or more, columns unchanged and of any names."""
    score = _scores(docs, fit(docs, labels, **options))

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(np.array(score(b), dtype=np.float64) >= threshold))
            release_memory()

    return docs.mapInArrow(run, docs.schema)
