"""Quality rules, mixing, packing, chats and the pipeline."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidelog.llm import chat, mixing, packing, quality_rules, tokenize
from tidelog.llm.queries import tokenizer_path

from .conftest import ODD, wide

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def plain_measures(text):
    t = text or ""
    w = WORD.findall(t)
    c = collections.Counter(zip(w, w[1:], w[2:]))
    cover = {i + k for i in range(len(w) - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(cover)


def test_rules(spark, odd, none):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["a", "b", "#c", "d\ne", "é*", "a b\na b"]) for _ in range(rng.randint(0, 60))), "s") for k in range(150)]
    for df, given in ((odd, ODD), (wide(spark, rows), rows)):
        got = quality_rules.ledger(df).collect()
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert sorted(((r["doc_id"], *(r[n] for n in names)) for r in got), key=repr) == sorted(((i, *plain_measures(t)) for i, t, _ in given), key=repr)
    for bits in (1, 3, 20):  # unequal windows with like hashes are told apart
        got = quality_rules.ledger(wide(spark, rows), hash_bits=bits).collect()
        assert sorted(((r["doc_id"], r["n_repeat_words"]) for r in got)) == sorted((i, plain_measures(t)[4]) for i, t, _ in rows)
    many = wide(spark, [(1, " ".join(map(str, range(300_000))), "s")])
    assert quality_rules.ledger(many, hash_bits=24).first()["n_repeat_words"] == 0
    led = quality_rules.ledger(wide(spark, rows))
    bits = [r["fail_bits"] for r in led.collect()]
    only = {r["rule"]: (r["n_failed"], r["n_only"]) for r in quality_rules.ablations(led).collect()}
    for k, (name, _) in enumerate(quality_rules.RULES):
        assert only[name] == (sum(b >> k & 1 for b in bits), sum(b == 1 << k for b in bits))
    assert quality_rules.ledger(none).count() == 0


def test_rules_stay_in_the_jvm(odd):
    plan = quality_rules.apply_policy(quality_rules.ledger(odd))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_sainte_lague_by_hand():
    assert mixing.sainte_lague([53, 24, 23], 7, [9, 9, 9]).tolist() == [3, 2, 2]
    rng = random.Random(2)
    for _ in range(200):
        w = [rng.randint(1, 9) for _ in range(rng.randint(1, 6))]
        cap = [rng.randint(0, 12) for _ in w]
        n = rng.randint(0, 30)
        got = [0] * len(w)
        for _ in range(min(n, sum(cap))):
            k = max((i for i in range(len(w)) if got[i] < cap[i]), key=lambda i: (w[i] / (2 * got[i] + 1), -i))
            got[k] += 1
        assert mixing.sainte_lague(w, n, cap).tolist() == got


def test_mix(spark, odd, none):
    got = mixing.mix(odd).collect()
    size = {}
    for i, t, s in ODD:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    assert len(got) == len(ODD)
    for r in got:
        assert r["source_size"] == size[r["source"]] and 0 <= r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"]
    assert sum({r["source"]: r["target"] for r in got}.values()) == pytest.approx(sum(size.values()))
    assert mixing.mix(none).count() == 0
    docs = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(7)).collect())
    taken = collections.Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
    for r in rows:
        assert abs(taken[r["source"]] - r["target"]) <= 16
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns and mixed.schema == docs.schema
    words = collections.Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert words == {r["doc_id"]: r["taken"] for r in rows if r["taken"]}
    assert mixing.apply_mix(odd).columns == odd.columns and mixing.apply_mix(none).count() == 0


def test_mix_takes_large_documents_in_part(spark):
    size = {"a": 100_000, "b": 10, "c": 50_000}
    df = spark.createDataFrame([(k, " ".join(f"{s}{i}" for i in range(n)), s) for k, (s, n) in enumerate(size.items())], "doc_id long, text string, source string")
    for r in mixing.mix(df).collect():
        assert abs(r["taken"] - r["target"]) <= 16 and r["taken"] <= 3 * r["size"]
    for r in mixing.apply_mix(df.filter("source <> 'c'")).filter("source = 'a'").collect():
        w = r["text"].split()
        assert len(set(w)) == len(w) and set(w) <= {f"a{i}" for i in range(100_000)}


def test_mix_repeated_rows_are_one_unit(spark):
    rows = [(None, "one two three four", "a")] * 900 + [(k, f"word{k} " * 30, "ab"[k % 2]) for k in range(60)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    assert len(got) == len(rows) and len({r["taken"] for r in got if r["doc_id"] is None}) == 1
    for s in "ab":
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - next(r["target"] for r in got if r["source"] == s)) <= 900 + 16


def test_fill_shard_takes_the_quota():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        sizes, rows, order = rng.integers(0, 200, n), rng.choice([1, 1, 1, 3], n), rng.integers(-99, 99, n)
        total = int((sizes * rows).sum())
        quota = int(rng.integers(0, 3 * total + 1))
        copies, part = mixing.fill_shard(sizes, rows, order, quota, 3, int(rng.integers(1, 300)))
        taken = copies * sizes + [sum(p[1::2]) - sum(p[::2]) for p in part]
        assert (taken <= 3 * sizes).all() and quota - 3 < (taken * rows).sum() <= quota
        assert all(p == sorted(set(p)) and (not p or p[-1] <= s) for p, s in zip(part, sizes))


def test_ids_are_those_of_tokenizers(spark):
    library = Tokenizer.from_file(tokenizer_path())
    own = tokenize.load(tokenizer_path())
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["", " ", "  a", "a  b ", "a\n b", "a \nb", "x <|endoftext|> y<|endoftext|>", "don't we'll  I'm", "1 2,3 é ü  z", "\ttab\r\n", "日本 語 text", "\x1c a \x1fb", "é" * 300, "x" * 5000, "\u0301\u200b \u3000a", "a\r\n\r\n  b\t", "<|endoftext|", "\ud7ff\U0001f600!"]
    for t in texts:
        assert own.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids, t[:80]


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(150):
        cap = rng.choice([1, 5, 20, 64])
        lens = [rng.randint(1, cap) for _ in range(rng.randint(0, 60))]
        bins, ranks = collections.defaultdict(list), collections.defaultdict(list)
        for length, rank, n, first, offset in packing.plan_bins(collections.Counter(lens), cap):
            for k in range(n):
                bins[first + k].append((offset, length))
                ranks[length].append(rank + k)
        assert all(sorted(ranks[x]) == list(range(c)) for x, c in collections.Counter(lens).items())
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= cap
        room = []
        for x in sorted(lens, reverse=True):
            fits = [i for i, r in enumerate(room) if r >= x]
            if fits:
                room[min(fits, key=lambda i: room[i])] -= x
            else:
                room.append(cap - x)
        assert len(bins) == len(room)


@pytest.mark.parametrize("group", [3, 20_000])
def test_pack_round_trip(spark, odd, none, group):
    own = tokenize.load(tokenizer_path())
    pieces = packing.cut_pieces(odd, tokenizer_path(), with_ids=True)
    got = packing.assign_bins(pieces.cache(), rows_per_group=group).collect()
    by, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"])) == r["ids_crc32"]
        by[r["doc_id"]].append((r["start"], r["piece"], r["ids"]))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t, _ in ODD:
        if i != 1:
            parts = sorted(by[i])
            assert sum((p[2] for p in parts), []) == own.ids(t or "").tolist() + [0]
            assert [p[1] for p in parts] == list(range(len(parts))) and all(len(p[2]) == 2048 for p in parts[1:])
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_chats(spark):
    convs = {1: "abc", 2: "ab", 3: "abc", 4: "abd", 5: "x", 6: "bc", 7: "xy", None: "q"}
    rows = [(i, k, "user" if k % 2 == 0 else None, c) for i, cs in convs.items() for k, c in enumerate(cs)] + [(8, None, "user", None), (8, 300, "a", "<|im_end|> <\\|")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "2 as n", "3 as pos", "4 as ha").repartition(5)
    for part_turns in (1, 2, 256):
        got = chat.format_chats(df, part_turns).collect()
        assert {r["conv_id"] for r in got} == {1, 4, 6, 7, None, 8}
        whole = collections.defaultdict(str)
        for r in sorted(got, key=lambda r: (r["conv_id"] or 0, r["part"])):
            whole[r["conv_id"]] += r["rendered"]
        assert whole[1] == "<|im_start|>user\na<|im_end|>\n<|im_start|>\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
        assert whole[8] == "<|im_start|>a\n<\\|im_end|> <\\\\|<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert chat.format_chats(df.filter("false")).count() == 0


def test_chats_break_ties_by_role_and_text(spark):
    rows = [(1, 0, "user", c) for c in "hgfedcba"] + [(2, 0, "user", c) for c in "abc"] + [(3, None, "b", "x"), (3, None, "a", "y")]
    got = {r["conv_id"]: r["rendered"] for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()}
    assert set(got) == {1, 3} and re.findall("\n(.)<", got[1]) == list("abcdefgh") and re.findall("\n(.)<", got[3]) == ["y", "x"]


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = []
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(docs.count())
    assert sizes[1] <= sizes[0] <= 200 and sizes[2] == sizes[1]
    assert p.ORACLE_SQL is None and p.run(spark, SF).count() == sizes[-1]


def test_pipeline_against_plain_versions(spark, tmp_path):
    import corpus_pipeline as p

    from tidelog.llm import quality_fm

    from .test_dedup import plain_kept, plain_removal

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    base = [[word() for _ in range(220)] for _ in range(8)]
    passage = " ".join(word() for _ in range(70))
    rows, labels = [], []
    for k in range(70):
        w = list(rng.choice(base)) if k % 3 else [word() for _ in range(rng.choice([0, 3, 200, 400]))]
        for _ in range(rng.choice([0, 1, 2, 4, 8, 30])):
            if w:
                w[rng.randrange(len(w))] = word()
        t = " ".join(w) + (" " + passage if k % 5 == 0 else "")
        good = int(rng.random() < 0.8)
        t = t if good else "@@ $$ ## " * 30 + t
        rows.append((k, t, "en", f"s{k % 3}", len(t)))
        labels.append((k, good, 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality_fm.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    want = {r["doc_id"]: r["text"] for r in docs.collect() if model.score(r["text"].encode(), r["n_chars"]) >= 0.3}
    outs = []
    for name, stage in p.STAGES:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        outs.append(got)
        docs = spark.createDataFrame(got, out.schema)
    assert {r["doc_id"]: r["text"] for r in outs[0]} == want and 40 < len(want) < 70
    kept = plain_kept(sorted(want.items()))
    assert sorted(r["doc_id"] for r in outs[1]) == kept and len(kept) < len(want) - 8
    cut = {i: (n - gone, digest) for i, n, gone, _, digest in plain_removal([(i, want[i]) for i in kept])}
    assert {r["doc_id"]: (len(r["text"]), hashlib.sha256(r["text"].encode()).hexdigest()) for r in outs[2]} == cut and any(n < len(want[i]) for i, (n, _) in cut.items())
    size = {r["doc_id"]: (r["source"], len(WORD.findall(r["text"]))) for r in outs[2]}
    total = sum(n for _, n in size.values())
    taken, per_doc = collections.Counter(), collections.Counter()
    for r in outs[3]:
        n = len(WORD.findall(r["text"]))
        taken[r["source"]] += n
        per_doc[r["doc_id"]] += n
        assert r["n_chars"] == len(r["text"]) and r["source"] == size[r["doc_id"]][0]
    held = [sum(n for x, n in size.values() if x == s) for s in sorted({x for x, _ in size.values()})]
    free, share, left = {0, 1, 2}, {}, total  # weights 1, 2, 3; none above 3 times its size, the excess reshared
    while True:
        over = [k for k in free if left * (k + 1) / sum(i + 1 for i in free) > 3 * held[k]]
        if not over:
            break
        share |= {k: 3 * held[k] for k in over}
        free -= set(over)
        left = total - sum(share.values())
    share |= {k: left * (k + 1) / sum(i + 1 for i in free) for k in free}
    assert all(abs(taken[s] - share[k]) <= 16 for k, s in enumerate(sorted(taken)))
    assert all(n <= 3 * size[i][1] for i, n in per_doc.items())
    own = tokenize.load(tokenizer_path())
    lens = []
    for r in outs[3]:
        n = len(own.ids(r["text"])) + 1
        lens += [2048] * (n // 2048) + [n % 2048] * (n % 2048 > 0)
    room = []
    for x in sorted(lens, reverse=True):
        fits = [i for i, free in enumerate(room) if free >= x]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= x
        else:
            room.append(2048 - x)
    assert sorted(r["length"] for r in outs[4]) == sorted(lens) and len({r["sequence_id"] for r in outs[4]}) == len(room)
    pieces = lambda found: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found)
    assert pieces(p.run(spark, str(tmp_path)).collect()) == pieces(outs[4])
