import os
import pathlib
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as driver

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")
CHECKED = sorted(driver.oracle_sql())


@pytest.fixture(scope="module")
def engine():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF_DIR}/{name}')")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_its_sql(spark, engine, name):
    ours = driver.queries()[name](spark, SF_DIR)
    columns = sorted(ours.columns)
    theirs = engine.execute(driver.oracle_sql()[name])
    assert sorted(d[0] for d in theirs.description) == columns
    position = {d[0]: i for i, d in enumerate(theirs.description)}
    want = sorted(str([row[position[c]] for c in columns]) for row in theirs.fetchall())
    got = sorted(str([row[c] for c in columns]) for row in ours.collect())
    assert got == want


def test_entry(spark):
    assert driver.entry(spark).count() == 1


def test_every_query_has_sql():
    from accesslens.plans.queries import all_queries
    assert set(all_queries()) <= set(CHECKED)


def test_the_rest_stands_without_the_llm_folders(tmp_path):
    root = pathlib.Path(driver.__file__).resolve().parent
    for pipeline in (True, False):
        copy = tmp_path / f"copy{pipeline}"
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json"))
        shutil.copy(root / "accesslens/models/detector.json", copy / "accesslens/models/detector.json")
        (copy / "accesslens" / "llm" / "__pycache__").mkdir(parents=True)
        if not pipeline:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) == set(q), set(o) ^ set(q); print(len(q))"
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(copy)})
        assert done.returncode == 0 and int(done.stdout) > 50, done.stderr
