"""SimHash and suffix dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash

from tidelog.llm import simhash, suffix_dedup
from tidelog.llm.components import components

from .conftest import ODD, wide

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(root)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def check_simhash(df, rows):
    got = simhash.near_duplicates(df).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(fps)
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[roots[f]] = min(least.get(roots[f], i), i)
    want = sorted(((i, f, least.get(roots[f])) for (i, _), f in zip(rows, fps)), key=repr)
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=repr) == want


def test_simhash_odd_rows(spark, odd, none):
    check_simhash(odd, [(i, t) for i, t, _ in ODD])
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.schema == odd.schema
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 5, 6]
    assert simhash.keep_one(none).count() == 0


def test_simhash_near_copies(spark):
    rng = random.Random(4)
    base = [[rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(300)] for _ in range(5)]
    rows = []
    for k in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 9])):
            w[rng.randrange(300)] = "new" + str(rng.randint(0, 9))
        rows.append((k, " ".join(w)))
    check_simhash(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def plain_kept(rows, d=20):
    """Ids that stay, from all pairs: at most d bits apart and 5 * shared shingles >= 4 * all shingles."""
    sets, fps, root = [], [], list(range(len(rows)))
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 5]).encode(), 42) for i in range(max(1, len(w) - 4))] if w else []
        sets.append(set(h) or {None})
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if root[i] != root[j] and (fps[i] ^ fps[j]).bit_count() <= d and 5 * both >= 4 * len(sets[i] | sets[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return sorted(min(i for (i, _), r in zip(rows, root) if r == one) for one in set(root))


def test_keep_one_finds_near_copies_of_jaccard_08(spark):
    rng = random.Random(6)
    base = [[rng.choice("abcdefgh") + str(rng.randint(0, 999)) for _ in range(300)] for _ in range(6)]
    rows = []
    for k in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 3, 5, 7, 9, 14, 40])):
            w[rng.randrange(300)] = "new" + str(rng.randint(0, 99999))
        rows.append((k, " ".join(w[: rng.choice([300, 300, 280, 150, 7, 3])])))
    want = plain_kept(rows)
    got = sorted(r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == want and len(want) < 120


def test_keep_one_picks_the_same_row_of_those_alike(spark):
    rows = [(1, "a b c d e f g", f"s{k}") for k in range(6)] + [(1, "a b c d e f g", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [simhash.keep_one(df.repartition(k)).collect() for k in (1, 3, 5)]
    assert len(got[0]) == 1 and got[0] == got[1] == got[2]


def test_large_groups_of_near_copies_are_linked_across_cells(spark, monkeypatch):
    rng = random.Random(9)
    base = [str(rng.randint(0, 10**6)) for _ in range(200)]
    rows = []
    for k in range(300):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 6])):
            w[rng.randrange(200)] = "new" + str(rng.randint(0, 10**6))
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, " ".join(base[:100]) + " " + " ".join(str(rng.randint(0, 10**6)) for _ in range(100))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    linked = simhash.near_copies
    monkeypatch.setattr(simhash, "near_copies", lambda *a: linked(*a, block=20))
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == plain_kept(rows)


def test_hot_blocks_are_dealt_again_without_losing_a_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    x = base[rng.integers(0, 3, 400)]
    for _ in range(3):
        x = x ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64))
    fps = sorted({int(v) for v in x.view(np.int64)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = plain_components([f % (1 << 64) for f in fps])
    for size in (10, 10_000):
        got = {r["node"]: r["root"] for r in components(simhash.link_edges(df, 2, max_block=size)).collect()}
        classes = {}
        for f in fps:
            classes.setdefault(got.get(f, f), set()).add(f % (1 << 64))
        plain = {}
        for f, r in want.items():
            plain.setdefault(r, set()).add(f)
        assert sorted(map(sorted, classes.values())) == sorted(map(sorted, plain.values()))


def test_suffix_ranks():
    rng = np.random.default_rng(2)
    for n in range(40):
        t = rng.integers(1, 4, n)
        order = sorted(range(n), key=lambda i: t[i:].tolist())
        assert [order[r] for r in range(n)] == np.argsort(suffix_dedup.suffix_ranks(t)).tolist()
    for n in (3, 10, 100, 1000, 4000):
        for top in (3, 60, 400):
            piece = rng.integers(1, top, 40)
            t = np.concatenate([rng.integers(1, top, n)] + [piece[rng.integers(0, 9) :] for _ in range(n // 50)])
            for need in (2, 3, 5, 9, 20, 50):
                order = np.argsort(suffix_dedup.suffix_ranks(t, need), kind="stable")
                heads = [t[i : i + need].tolist() for i in order]
                assert heads == sorted(heads)
            whole = np.argsort(suffix_dedup.suffix_ranks(t))
            assert whole.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def plain_removal(rows, length=50):
    first = {}
    key = lambda i: suffix_dedup.LAST if i is None else i
    data = [(key(i), (t or "").encode()) for i, t in rows]
    for k, b in data:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, k), k)
    out = []
    for (i, _), (k, b) in zip(rows, data):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < k:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def found(df, **options):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(df, **options).collect()), key=repr)


def test_suffix_dedup_odd_rows(spark, odd, none):
    assert found(odd) == plain_removal([(i, t) for i, t, _ in ODD])
    assert found(none) == []
    cut = suffix_dedup.cut_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == len(ODD)
    plain = [c for c in odd.columns if c not in ("text", "n_chars")]
    assert sorted(cut.select(plain).collect(), key=repr) == sorted(odd.select(plain).collect(), key=repr)


def test_suffix_dedup_passages(spark):
    rng = random.Random(3)
    passage = ["".join(rng.choice("abcdé fgh\n") for _ in range(rng.randint(30, 160))) for _ in range(10)] + ["Er " * 300]
    rows = []
    for k in range(90):
        parts = [rng.choice([rng.choice(passage), rng.choice(passage)[rng.randint(0, 40) :], "".join(rng.choice("xyzw ") for _ in range(rng.randint(0, 60)))]) for _ in range(rng.randint(0, 5))]
        rows.append((rng.choice([k, k, 7]), "".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = plain_removal(rows)
    assert found(df, pack_bytes=3000, regions_per_bucket=40) == want
    assert found(df) == want
    for r in suffix_dedup.cut_repeats(df).collect():
        assert "�" not in r["text"]
