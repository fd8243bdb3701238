"""Every query with SQL gives the SQL's rows on the smallest tables, if they are there; all queries can be listed without the training-data package."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from meterlark import catalog

FOLDER = os.environ.get("METERLARK_TABLES", "/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    db = duckdb.connect()
    for name in os.listdir(FOLDER):
        db.execute(f"create view {name.split('.')[0]} as select * from '{FOLDER}/{name}'")
    return db


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_runs(spark, duck, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() >= 0


def test_entry_works_without_the_training_package(tmp_path):
    for part in ("__spark_entry__.py", "meterlark"):
        source = ROOT / part
        subprocess.run(["cp", "-r", str(source), str(tmp_path / part)], check=True)
    subprocess.run(["mv", str(tmp_path / "meterlark/llm"), str(tmp_path / "gone")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'deployment_rollup' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)})
