"""Language-model scoring: an add-0.1 word unigram base and a causal self-attention model.

Counts of words and subwords come from all training documents. These are dealt by a hash of their content into
shares of about `share_tokens` tokens each. The attention model is trained on the first share; a copy of it is
trained on every other share, and the copies are averaged by weight, in the order of the shares, so neither
the model nor a score depends on how the rows are spread over partitions.
Each document is then scored whole. Common words' counts travel as a list of bounded length; the counts
of all other words are joined by shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention as A
from ._shared import Staged, no_shuffle_left
from .tokenize import load


def is_held_out(doc_id: int | None) -> bool:
    """crc32 of the id as text is divisible by 10; a null id is held out."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


PASS = "kind int, word string, n long, blob binary, doc_id long, text string"
#: Rows alike in id and text that one task deals into one share.
ALIKE = 256


def _first_pass(docs: DataFrame, tokenizer_path: str, flush: int = 400_000) -> DataFrame:
    """The one pass that splits and encodes. kind 0: (word, n) of training texts; kind 1: subword counts;
    kind 2: training documents; kind 3: each document's lower-cased text, its subword ids and, as n, how often
    the task has met it before, in steps of ALIKE."""
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
    names = ["kind", "word", "n", "blob", "doc_id", "text"]

    def batch(kind, n_rows, **cols):
        data = [pa.array(cols[c], k) if c in cols else pa.nulls(n_rows, k) for c, k in zip(names, kinds)]
        data[0] = pa.array(np.full(n_rows, kind, np.int32))
        return pa.RecordBatch.from_arrays(data, names=names)

    def counted(words):
        texts = b" ".join(words).decode().split(" ") if words else []
        return batch(0, len(words), word=texts, n=list(words.values()))

    def run(batches):
        bpe = load(tokenizer_path)
        words: Counter = Counter()
        met: Counter = Counter()
        subwords = np.zeros(bpe.size + 1, dtype=np.int64)
        n_docs = 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                keys = part.column(0).to_pylist()
                low = [(t or b"").lower() for t in part.column(1).cast(pa.binary()).to_pylist()]
                texts = [t.decode() for t in low]
                ids = [bpe.ids(t) for t in texts]
                learned = [k for k, key in enumerate(keys) if not is_held_out(key)]
                for k in learned:
                    words.update(low[k].split())
                if learned:
                    subwords += np.bincount(np.concatenate([ids[k] for k in learned]), minlength=len(subwords))
                n_docs += len(learned)
                again = []
                for key, text in zip(keys, low):
                    again.append(met[key, zlib.crc32(text)] // ALIKE)
                    met[key, zlib.crc32(text)] += 1
                yield batch(3, len(keys), blob=[x.tobytes() for x in ids], doc_id=keys, text=texts, n=again)
                if len(words) > flush:
                    yield counted(words)
                    words = Counter()
        yield counted(words)
        yield batch(1, 1, blob=[zlib.compress(subwords.tobytes(), 1)])
        yield batch(2, 1, n=[n_docs])

    return docs.mapInArrow(run, PASS)


def _add_blobs(rows: DataFrame, fanout: int = 64) -> np.ndarray | None:
    """Sum of blobs of doubles or longs; at most `fanout` partial sums reach the driver."""
    partial = rows.select("blob", F.pmod(F.xxhash64("blob"), F.lit(fanout)).alias("k"))

    def run(t):
        total = None
        for blob in t.column("blob").to_pylist():
            x = np.frombuffer(zlib.decompress(blob), dtype=np.int64)
            total = x if total is None else total + x
        return pa.table([pa.array([total.tobytes()], pa.binary())], names=["blob"])

    parts = [np.frombuffer(r["blob"], dtype=np.int64) for r in partial.groupBy("k").applyInArrow(run, "blob binary").collect()]
    return sum(parts, np.zeros_like(parts[0])) if parts else None


def fit_local(m: dict, texts: list[np.ndarray], end: int, rate: float, batch: int = 256, least_steps: int = 1, seed: int = 0) -> int:
    """Train m in place on slots of texts; returns the windows seen. A few windows are gone through as often
    as makes `least_steps`."""
    if not texts:
        return 0
    inputs, targets, _ = A.windows(texts, end)
    adam, rng = A.Adam(m, rate), np.random.default_rng(seed)
    each = -(-len(inputs) // batch)
    epochs = -(-least_steps // each)
    for _ in range(epochs):
        turn = rng.permutation(len(inputs))
        for at in range(0, len(turn), batch):
            part = turn[at : at + batch]
            adam.step(m, A.gradients(m, inputs[part], targets[part])[1], scale=1 - 0.9 * adam.n / (epochs * each))
    return len(inputs)


SHARE = "share int, seen long, blob binary"


def _sum_in_order(models: DataFrame, fanout: int = 16) -> np.ndarray | None:
    """Sum of models (doubles) weighed by seen, always in the same order, over seen; a tree of `fanout`."""

    def add(t):
        rows = sorted(zip(t.column("share").to_pylist(), t.column("seen").to_pylist(), t.column("blob").to_pylist()))
        total = np.zeros(len(rows[0][2]) // 8)
        for _, _, blob in rows:
            total = total + np.frombuffer(blob, dtype=np.float64)
        return pa.table([pa.array([rows[0][0] // fanout], pa.int32()), pa.array([sum(r[1] for r in rows)]), pa.array([total.tobytes()], pa.binary())], names=["share", "seen", "blob"])

    while models.count() > fanout:
        models = Staged(models.groupBy(F.expr(f"share div {fanout}")).applyInArrow(add, SHARE), "models").read()
    rows = sorted(models.collect())
    if not rows:
        return None
    return sum((np.frombuffer(r["blob"], dtype=np.float64) for r in rows), 0.0) / sum(r["seen"] for r in rows)


def fit_attention(encoded: DataFrame, counts: np.ndarray, share_tokens: int = 2_000_000, least_steps: int = 400) -> tuple[dict, A.Slots]:
    """The model, from all training documents of `encoded` (doc_id, blob of ids, n) and the ids' `counts`."""
    spark = encoded.sparkSession
    slots = A.Slots(counts)
    shares = max(1, -(-int(counts.sum()) // share_tokens))
    learned = encoded.filter("doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0")
    learned = learned.select("doc_id", "blob", F.pmod(F.xxhash64("doc_id", "blob", "n"), F.lit(shares)).cast("int").alias("share"))
    sent_slots = spark.sparkContext.broadcast(slots)

    def trained(start, rate: float, least: int):
        def run(t):
            slots = sent_slots.value
            own = A.initial(slots) if start is None else {k: v.copy() for k, v in start.value.items()}
            texts = [slots.of[np.frombuffer(x, dtype="<u2")] for _, x in sorted(zip(t.column("doc_id").to_pylist(), t.column("blob").to_pylist()))]
            share = t.column("share")[0].as_py()
            seen = fit_local(own, texts, slots.end, rate, least_steps=least, seed=share)
            return pa.table([pa.array([share], pa.int32()), pa.array([seen], pa.int64()), pa.array([A.pack_model(own) if start is None else (np.frombuffer(A.pack_model(own)) * seen).tobytes()], pa.binary())], names=["share", "seen", "blob"])

        return run

    with no_shuffle_left(spark):
        first = learned.filter("share = 0").groupBy("share").applyInArrow(trained(None, 0.01, least_steps), SHARE).collect()
    m = A.unpack_model(np.frombuffer(first[0]["blob"], dtype=np.float64)) if first else A.initial(slots)
    if shares > 1:
        rest = learned.filter("share > 0").groupBy("share").applyInArrow(trained(spark.sparkContext.broadcast(m), 0.005, 1), SHARE)
        total = _sum_in_order(Staged(rest, "models").read())
        m = m if total is None else A.unpack_model(total)
    return m, slots


def _common(counts: DataFrame, most: int, unit: float) -> tuple[int, dict[bytes, float]]:
    """Terms of the words whose count reaches a threshold that at most `most` words reach, and the threshold."""
    sizes = counts.groupBy(F.least("c", F.lit(1_000_000)).alias("c")).count().collect()
    threshold, n = 1_000_001, 0
    for r in sorted(sizes, reverse=True):
        if n + r["count"] > most:
            break
        threshold, n = r["c"], n + r["count"]
    table = counts.filter(F.col("c") >= threshold).toArrow()
    terms = np.log10((table.column("c").to_numpy() + 0.1) / unit)
    return threshold, dict(zip(table.column("word").cast(pa.binary()).to_pylist(), terms.tolist()))


def score(docs: DataFrame, tokenizer_path: str, common_words: int = 300_000, **options) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts are lower-cased (A-Z) for both models. Null and empty texts are their end alone; a null doc_id is
    held out; repeated rows are scored alike; an empty table gives no rows, and where no row is learned
    from all counts are 0; only doc_id and text are read, so other columns cannot clash. With no training
    token the base's N is 0 and a token's term is log10(0.1 / 0.1).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = Staged(_first_pass(docs, tokenizer_path), "encoded")
    by_word = found.read().filter("kind = 0").groupBy("word").agg(F.sum("n").alias("c"))
    counts = Staged(by_word, "counts").read()
    n_docs = found.read().filter("kind = 2").agg(F.sum("n")).first()[0] or 0
    subwords = _add_blobs(found.read().filter("kind = 1"))
    if subwords is None:
        subwords = np.zeros(load(tokenizer_path).size + 1, dtype=np.int64)
    encoded = found.read().filter("kind = 3")
    kinds, tokens = counts.agg(F.count("*"), F.sum("c")).first()
    n_all, n_kinds = (tokens or 0) + n_docs, kinds + (n_docs > 0)
    subwords[-1] += n_docs
    unit = n_all + 0.1 * (n_kinds + 1)
    threshold, common = _common(counts, common_words, unit)
    model, slots = fit_attention(encoded.select("doc_id", "blob", "n"), subwords, **options)
    sent = spark.sparkContext.broadcast((common, model, slots))

    def run(batches):
        from pyspark import TaskContext

        logs, model, slots = sent.value
        end = float(np.log10((n_docs + 0.1) / unit))
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                parts = [np.frombuffer(x, dtype="<u2") for x in some.column(2).to_pylist()]
                out = []
                for doc_id, low in zip(some.column(0).to_pylist(), some.column(1).cast(pa.binary()).to_pylist()):
                    words = low.split()
                    x = np.array(list(map(logs.get, words)), dtype=np.float64)  # nan: not a common word
                    odd = np.flatnonzero(np.isnan(x))
                    x[odd] = 0
                    base, known = end + float(x.sum()), int(n_docs > 0) + len(words) - len(odd)
                    times = Counter(map(words.__getitem__, odd.tolist()))
                    rare = b" ".join(times).decode().split(" ") if times else []
                    out.append((row, doc_id, is_held_out(doc_id), len(words) + 1, known, base, rare, list(times.values())))
                    row += 1
                inputs, targets, owner = A.windows([slots.of[p] for p in parts], slots.end)
                value = np.bincount(owner, A.log_probs(model, inputs, targets), len(parts))
                value += [float(slots.within[p].sum()) for p in parts] + slots.within[-1]
                cols = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int32())]
                data = [pa.array(c, k) for c, k in zip(cols, kinds)] + [pa.array(value / np.log(10))]
                yield pa.RecordBatch.from_arrays(data, names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "rare", "times", "score"])

    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, rare array<string>, times array<int>, score double"
    scored = Staged(encoded.select("doc_id", "text", "blob").mapInArrow(run, schema), "scored").read()
    pairs = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("p")).select("row", F.col("p.rare").alias("rare"), F.col("p.times").alias("times"))
    met = pairs.join(counts.filter(F.col("c") < threshold), F.col("rare") == F.col("word"), "left").withColumn("c", F.coalesce("c", F.lit(0)))
    terms = met.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.col("c") + F.lit(0.1)) / F.lit(unit))).alias("more"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).cast("long").alias("more_known"),
    )
    whole = scored.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "score").join(terms, "row", "left")
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )
