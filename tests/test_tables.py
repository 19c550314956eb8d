"""Stages and the folder they lie in, where no setting names one and where one does."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import os, sys
from pyspark.sql import SparkSession
from textwarrant import tables
builder = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
if sys.argv[1]:
    builder = builder.config("spark.checkpoint.dir", sys.argv[1])
spark = builder.getOrCreate()
one, two = (tables.materialize(spark.range(n), "stage") for n in (3, 5))
assert (one.count(), two.count()) == (3, 5)
place = tables.shared_dir(spark)
assert place == tables.shared_dir(spark) and len([x for x in os.listdir(place) if x.startswith("stage-")]) == 2
if len(sys.argv) > 2:
    from textwarrant.plans import registry
    for name in ("sentence_cascade", "bm25_topk", "rate_limit"):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
print(place)
spark.stop()
"""


def run(tmp_path, folder, *more):
    empty = tmp_path / "conf"
    empty.mkdir()
    done = subprocess.run([sys.executable, "-c", SCRIPT, folder, *more], cwd=ROOT, env=os.environ | {"SPARK_CONF_DIR": str(empty)}, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout.split()[-1]


def test_without_a_setting(tmp_path):
    place = run(tmp_path, "", *(["all"] if os.path.isdir("/root/testdata/sf0.001") else []))
    assert not os.path.exists(place)


def test_stages_go_with_their_application(tmp_path):
    shared = tmp_path / "shared"
    shared.mkdir()
    assert run(tmp_path, str(shared)) == str(shared)
    assert not [x for x in os.listdir(shared) if x.startswith("stage-")]


def test_a_cluster_needs_a_folder(spark, monkeypatch):
    from textwarrant import tables

    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_dir(Cluster)
