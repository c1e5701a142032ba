import pytest

WIDE = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, fp long, _score double, root long, bucket int, word string, c long"
#: Names that the operators use inside.
MORE = "copies part version c0 c1 key whole row id own hash alike n_bytes n_removed n_spans kept_sha256 spans kept_text _d _fp _k _size _key blob pack of_doc_id own_id doc_size blocks shard order rows kind n shingle".split()


def wide(spark, rows, extra=True):
    """A documents table with nulls and columns whose names clash with the operators' own."""
    full = [(i, t, "en", s, len(t or ""), 7, 0.5, 3, 0.1, 4, 5, "w", 6) for i, t, s in rows]
    return spark.createDataFrame(full, WIDE).selectExpr("*", *[f"{k} as `{c}`" for k, c in enumerate(MORE)])


LONG = "word " * 40_000
ODD = [(1, "alpha beta gamma delta", "a"), (2, None, None), (3, "", "b"), (4, " \t\n ", "b"), (5, LONG, "a"), (1, "alpha beta gamma delta", "a"), (None, "x", None), (6, "Ünï code\x1fé\x00!", "c"), (7, "alpha beta gamma delta", "c")]


@pytest.fixture(scope="session")
def odd(spark):
    return wide(spark, ODD)


@pytest.fixture(scope="session")
def none(spark):
    return wide(spark, [])
