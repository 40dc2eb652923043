"""Intermediate tables: where they lie, and what is made only once."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from weftline.session import cut, once, shared_dir, small


def fake(master, folder=None):
    conf = SimpleNamespace(get=lambda k, d=None: folder if k == "spark.checkpoint.dir" else d)
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf), conf=conf)


def test_shared_folder():
    assert shared_dir(fake("spark://h:7077", "hdfs://x/y")) == "hdfs://x/y" and shared_dir(fake("local[4]", "file:///s")) == "file:///s"
    assert shared_dir(fake("local[4]")).startswith("file://") and shared_dir(fake("local")).startswith("file://")
    for master in ("spark://h:7077", "yarn", "k8s://h", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(fake(master))


def test_cut_and_once(spark):
    rows = spark.range(5).withColumn("r", F.rand())
    kept = cut(rows)
    assert kept.collect() == kept.collect() and kept.schema.simpleString() == rows.schema.simpleString()
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert once(spark, "three", make).count() == once(spark, "three", make).count() == 3 and made == [1]
    assert once(spark, "four", lambda: spark.range(4)).count() == 4


def test_small(spark):
    hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hint(small(spark.range(10), 10)) and not hint(small(spark.range(11), 10))
