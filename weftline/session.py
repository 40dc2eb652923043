"""Session helpers: worker import path, reliable cuts of lineage, scopes of sizes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package.

    The root of the package joins the PYTHONPATH with which Spark starts its Python workers. On a
    cluster whose nodes do not share this path, pass the package with ``--py-files`` as usual.
    """
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    return spark


#: Rows of a table that may be broadcast; a larger one is left to a shuffled join.
SMALL = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a folder of this machine serves a session whose executors run in the driver;
    on a cluster, whose executors would each write to a disk of their own, ValueError is raised.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    own = os.path.join(tempfile.gettempdir(), f"weftline-shared-{os.getuid()}")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a Parquet table into the shared folder and read it back.

    The result survives the loss of executors, has no lineage, and later readers prune its columns.
    The folder is removed when the session's JVM ends.
    """
    spark = df.sparkSession
    target = f"{shared_dir(spark).rstrip('/')}/weftline-{uuid.uuid4().hex}"
    df.write.parquet(target)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(target)


_kept: dict[tuple[str, str], DataFrame] = {}


def once(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table `name` of this application: made and written at its first use, read from then on.

    For what several queries need and is dear to make, such as parsed files.
    """
    key = (spark.sparkContext.applicationId, name)
    if key not in _kept:
        _kept[key] = cut(make())
    return _kept[key]


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a plain scan over all cores, for costly row-local work.

    Files that make fewer partitions than there are cores are small; only those are shuffled. A large
    input stays as it is read.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else scan


def small(side: DataFrame, most: int = SMALL) -> DataFrame:
    """`side`, to be broadcast if it has at most `most` rows; else as it is, for a shuffled join.

    Counts `side` (up to one row beyond `most`), so it should be a written or otherwise cheap table.
    """
    from pyspark.sql import functions as F

    return F.broadcast(side) if side.limit(most + 1).count() <= most else side
