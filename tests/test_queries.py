"""Every named query against its SQL in another engine, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from graphmill import queries as core


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_equals_its_sql(spark, sf, con, name):
    df = core.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in core.SQL:
        assert got
        return
    cur = con.execute(core.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
    assert got == want


def test_entry_and_contract(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["part", "calls"] and df.count() > 0
    found = __spark_entry__.queries()
    assert set(core.QUERIES) <= set(found) and set(__spark_entry__.oracle_sql()) <= set(found)


def test_nothing_else_imports_the_optional_part():
    root = os.path.dirname(core.__file__)
    for folder, _, files in os.walk(root):
        if os.sep + "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(folder, f)).read()
                assert "graphmill.llm" not in text and "corpus_pipeline" not in text


@pytest.mark.parametrize("also", [True, False])
def test_the_rest_works_without_the_optional_part(tmp_path, also):
    """A copy without the optional package, with and without what stands beside it."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(core.__file__))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *([] if also else ["corpus_pipeline.py"])))
    (copy / "graphmill" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; import bench; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and not [n for n in q if n.startswith('op') and n[2:3].isdigit() or n == 'pipeline']; print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout) == len(core.QUERIES), out.stderr[-2000:]
