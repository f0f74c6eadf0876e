"""The entry module, with and without the subpackage that can be taken away."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from textquarry import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cells(rows, columns):
    return sorted(tuple(repr(v) for v in (r[c] for c in columns)) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(plans.queries()) == sum(len(m.QUERIES) for m in plans.MODULES)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = plans.queries()[name](spark, SF)
    found = con.execute(plans.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert cells(got.collect(), sorted(names)) == cells([dict(zip(names, r)) for r in found.fetchall()], sorted(names))


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, name):
    assert plans.queries()[name](spark, SF).count() >= 0


def test_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/textquarry", tmp_path / "textquarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 50 and not any(n.startswith('op1_') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
