"""Every catalogue query against its SQL on the small tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tidelog.plans import catalogue

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "documents", "orders"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, str(SF))
    cur = duck.execute(catalogue.ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    want = sorted(cur.fetchall(), key=repr)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_the_rest_works_without_the_training_data_folders(tmp_path, also):
    root = Path(__file__).resolve().parents[1]
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *also))
    code = "import __spark_entry__ as e; from tidelog.plans import catalogue as c; assert set(e.queries()) == set(c.QUERIES) and set(e.oracle_sql()) == set(c.ORACLE_SQL); print(e.entry.__name__)"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
