import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() == 4


@needs_data
@pytest.mark.parametrize("name", sorted(k for k in entry.queries() if not k.startswith("op") and k != "pipeline"))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SMALL}/{file}'")
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    got = entry.queries()[name](spark, SMALL)
    assert sorted(got.columns) == columns
    show = lambda rows: sorted(tuple("%.6g" % v if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert show(map(tuple, got.select(*columns).collect())) == show(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_without_the_optional_parts(tmp_path):
    shutil.copytree(os.path.join(ROOT, "loomstat"), tmp_path / "loomstat", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q))"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.stdout.split()[1:] == ["False"], out.stderr
