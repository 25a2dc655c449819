"""Every query of the library against its SQL at sf0.001, and the package without its pipeline operators."""

import os
import subprocess
import sys

import pytest

from quillon import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple("NULL" if r[i] is None else repr(round(r[i], 9)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(rows, df.columns) == plain(want.fetchall(), want.columns)


def test_wrong_bytes_are_refused(spark):
    rows = catalog.queries()["utf8_refused"](spark, SF).collect()
    assert {(r.kind, r.valid) for r in rows} >= {("whole", True), ("cut", True), ("cut", False), ("overlong", False), ("surrogate", False), ("beyond", False)}
    assert all((r.refusal is None) == r.valid for r in rows)


def test_imports_without_the_pipeline(tmp_path):
    """As if the subpackage and the pipeline had been deleted."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    import shutil

    shutil.copytree(f"{root}/quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) == len(__import__('quillon.catalog', fromlist=['x']).queries()); print('fine')"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert "fine" in out.stdout, out.stderr


def test_queries_run_without_the_pipeline(tmp_path):
    """One query of the library, and the pipeline's operators without corpus_pipeline.py."""
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q; print(any(n.startswith('op1_') for n in q)); from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); print(len(e.entry(s).collect()))"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=env)
    had = os.path.isdir(f"{root}/quillon/llm")
    assert out.stdout.split() == [str(had), "11"], out.stderr
    shutil.rmtree(tmp_path / "quillon" / "llm", ignore_errors=True)
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=env)
    assert out.stdout.split() == ["False", "11"], out.stderr
