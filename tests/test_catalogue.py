"""Every query with SQL is held against it; the others must give rows."""

import glob
import os
import re
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
BASE = [n for n in entry.queries() if not re.match(r"op\d+_|pipeline", n)]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return str(x)


@pytest.mark.parametrize("name", BASE)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert columns
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted([plain(r[i]) for i in at] for r in want.fetchall())


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(BASE) > 50


def test_entry_without_optional_parts(tmp_path):
    """The entry module imports, and has the other queries, when the optional subpackage is gone."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = "import sys; sys.modules['lodestone.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 50 and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=60)
