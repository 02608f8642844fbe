"""Every registered query with SQL equals it on the smallest tables; the others run."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def db():
    made = duckdb.connect()
    for t in TABLES:
        made.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return made


def cell(v):
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v.replace(tzinfo=None)) if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, db, name):
    got = entry.queries()[name](spark, SF)
    want = db.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    ours = sorted(tuple(map(cell, r)) for r in got.select(columns).collect())
    theirs = sorted(tuple(map(cell, r)) for r in want.select(*(f'"{c}"' for c in columns)).fetchall())
    assert ours == theirs and ours


def test_curves_of_one_file_are_many_tasks(spark):
    """Python stages would be one task else, whatever the number of cores."""
    from pyspark.sql import functions as F

    parts = entry.queries()["curve_linearize"](spark, SF).select(F.spark_partition_id().alias("part")).distinct()
    assert parts.count() == spark.sparkContext.defaultParallelism


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("pipeline_left", [False, True])
@pytest.mark.parametrize("path_set", [False, True])
def test_imports_without_the_optional_parts(tmp_path, pipeline_left, path_set):
    """A copy without the training-data folder lists the other queries, whatever else can be found on the path."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root / "geoledger", tmp_path / "geoledger", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if pipeline_left and (root / "corpus_pipeline.py").exists():
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
    others = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != root.resolve()]
    env = os.environ | {"PYTHONPATH": os.pathsep.join(([str(root)] if path_set else []) + others)}
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), any(q.startswith('op') for q in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert said.stdout.split()[1:] == ["False", "False"] and int(said.stdout.split()[0]) >= 18, said.stderr
