"""Quality rules as a bitmask ledger, in DataFrame functions alone.

Every rule is evaluated once per document; the ledger keeps the measurements and one failure bit per rule.
A policy is a named, versioned mask of rules; policies and ablations read only the ledger, by bitwise
operations and aggregation, and never touch the texts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import SPACE_CLASS

#: Rule names in bit order, each with its failing condition over the ledger's measurements.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("too_many_words", "n_words > 1000000"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines"),
]
#: Version -> rules that reject under it.
POLICIES: dict[str, list[str]] = {
    "base": ["too_few_words", "repeated_windows"],
    "v1": [name for name, _ in RULES],
}
SYMBOLS = r"[#*$%&|<>]"
_SPACES = " \t\n\x0b\f\r"


def _let(value: Column, body) -> Column:
    """Evaluate `value` once and use it many times inside a higher-order expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(windows: Column, words: str) -> Column:
    """Words in windows found twice or more, each word once; exact.

    A window's position replaces as many low bits of its hash as positions need, so one sort of plain longs
    makes equal windows neighbours. Only windows with such a neighbour are looked at again: they are sorted
    by their three words themselves, so unequal windows with like hashes are told apart. The positions of
    those equal to a neighbour are sorted once more and the cover of [p, p + 2] is summed.
    """

    def beside(s: Column, same) -> Column:
        return F.filter(s, lambda x, i: F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)))

    def exact(places: Column) -> Column:
        word = lambda p, k: F.get(words, (p + k).cast("int"))
        rows = F.sort_array(F.transform(places, lambda p: F.struct(word(p, 0).alias("a"), word(p, 1).alias("b"), word(p, 2).alias("c"), p.alias("p"))))
        same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
        return _let(rows, lambda s: F.sort_array(F.transform(beside(s, same), lambda x: x["p"])))

    def count(h: Column, bits: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: F.call_function("shiftleft", F.call_function("shiftright", x, bits), bits).bitwiseOR(i.cast("long"))))
        alike = lambda x, y: F.call_function("shiftright", x.bitwiseXOR(y), bits) == 0
        low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-3).cast("long").alias("last"))
        maybe = _let(packed, lambda s: F.transform(beside(s, alike), lambda x: x.bitwiseAND(low)))
        places = _let(maybe, exact)
        return F.aggregate(places, start, lambda a, p: F.struct((a["sum"] + F.least(F.lit(3).cast("long"), p - a["last"])).alias("sum"), p.alias("last")), lambda a: a["sum"])

    return _let(windows, lambda h: _let(F.length(F.bin(F.size(h).cast("long"))).cast("int"), lambda bits: count(h, bits)))


def ledger(docs: DataFrame, keep: list[str] | None = None, hash_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, columns `keep`, measurements, fail_bits. `hash_bits` changes no result.

    Null and empty texts have no words. Rows are judged each on their own, so nulls, repeats and ties need
    no rule; only doc_id, text and `keep` are read, so other columns cannot clash.
    """
    kept = [F.col(c) for c in keep or []]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select("doc_id", *kept, text.alias("_text"))
    words = read.select("doc_id", *kept, "_text", F.filter(F.split("_text", SPACE_CLASS), lambda w: w != "").alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.translate(x, _SPACES, "") != "")
    hashes = F.transform(F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    if hash_bits < 64:
        hashes = F.transform(hashes, lambda h: F.call_function("shiftleft", h, F.lit(64 - hash_bits)))
    measured = words.select(
        "doc_id", *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size(F.split("_text", SYMBOLS)) - 1).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("_lines"),
        _repeat_words(hashes, "_words").alias("n_repeat_words"),
    ).select("*", F.col("_lines.n").alias("n_lines"), F.col("_lines.dup").alias("n_dup_lines")).drop("_lines")
    bits = sum((F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, rule) in enumerate(RULES)), F.lit(0))
    return measured.withColumn("fail_bits", bits.cast("long"))


def mask(rules: list[str]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(r) for r in rules)


def apply_policy(led: DataFrame, version: str = "v1", column: str = "kept") -> DataFrame:
    """Column `column`: true where no rule of the policy failed."""
    return led.withColumn(column, F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablations(led: DataFrame, version: str = "v1") -> DataFrame:
    """Per rule of the policy: documents that fail it, and those that only it rejects; one aggregation."""
    whole = mask(POLICIES[version])
    aggs, rows = [], []
    for name in POLICIES[version]:
        bit = mask([name])
        failed = F.col("fail_bits").bitwiseAND(F.lit(whole))
        aggs += [F.count_if(failed.bitwiseAND(F.lit(bit)) != 0).alias(f"f_{name}"), F.count_if(failed == bit).alias(f"o_{name}")]
        rows.append(F.struct(F.lit(name).alias("rule"), F.col(f"f_{name}").alias("n_failed"), F.col(f"o_{name}").alias("n_only")))
    return led.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
