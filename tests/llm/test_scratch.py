"""Intermediate folders: where they are, and that they go."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from geoledger.llm import common

ROOT = Path(common.__file__).parents[2]
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
CODE = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry
from geoledger.llm import common
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
import os
for name in sys.argv[3:]:
    entry.queries()[name](spark, sys.argv[2]).collect()
    if name != sys.argv[-1]:
        assert os.listdir(sys.argv[1]), name
        common.release()
        left = [f for _, _, files in os.walk(sys.argv[1]) for f in files]
        assert not left, left
if "stop" in os.environ:
    spark.stop()
"""


@pytest.mark.parametrize("stop", [False, True])
def test_nothing_stays_behind(tmp_path, stop):
    """After release(), and when the driver's Python ends, whether or not it stopped the session, no file is left."""
    names = ["op2_simhash", "op4_nearest_neighbours", "op5_toxicity", "op1_packing", "op10_token_files"][: 2 if stop else 5]
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])} | ({"stop": "1"} if stop else {})
    said = subprocess.run([sys.executable, "-c", CODE, str(tmp_path), SF, *names], env=env, capture_output=True, text=True, timeout=900)
    assert said.returncode == 0, said.stderr[-2_000:]
    assert [f for _, _, files in os.walk(tmp_path) for f in files] == []


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch(Session())


def test_library_calls_leave_the_session_s_settings(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "9000")
    common.checkpointed(common.table(spark, SF, "documents"))
    assert spark.conf.get(name) == "9000"
    spark.conf.set(name, before)


def test_what_a_stage_took_goes_with_it(spark):
    """Folders of others stay, and so do the stage's rows."""
    other = common.written(spark.range(3), "other")
    kept = set(common._KEPT)
    rows = common.settled(spark, lambda: common.checkpointed(common.checkpointed(spark.range(5)).where("id > 1")), "stage")
    assert len(set(common._KEPT) - kept) == 1 and rows.count() == 3 and other.count() == 3
    common.release(rows, other)
    common.release(rows)


def test_narrow_input_is_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    assert common.table(spark, SF, "documents").rdd.getNumPartitions() == cores
