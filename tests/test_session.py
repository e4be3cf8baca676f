import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tracewright import session


def test_staged_and_released(spark):
    df = session.staged(spark.range(5), "five")
    path = session._STAGED[df]
    assert df.count() == 5 and os.path.isdir(path.removeprefix("file:"))
    session.release(df, spark.range(1))
    assert not os.path.exists(os.path.dirname(path.removeprefix("file:")))


def test_a_cluster_needs_a_shared_folder():
    none = SimpleNamespace(get=lambda key, default: default)
    unset = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://host:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.scratch_dir(SimpleNamespace(conf=none, sparkContext=SimpleNamespace(master=master, _jsc=unset)))


def test_staged_clears_what_it_shuffled(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffled = lambda: {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}
    before = shuffled()
    found = session.staged(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "counts", clear=True)
    assert not shuffled() - before and spark.conf.get(session._CLEANUP) == "false"
    assert found.count() == 10
