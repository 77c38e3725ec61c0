"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch: rows hold whole texts, and a batch lives in the JVM and in Python at the same time.
ARROW_BYTES = 8 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers on this host import the package from where the driver found it (on a cluster the package is
    installed on the executors or passed with --py-files, and this changes nothing), and bound Arrow batches by bytes,
    unless the session was started with a bound of its own."""
    if not spark.sparkContext.getConf().contains(_BYTES):
        spark.conf.set(_BYTES, str(ARROW_BYTES))
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *[p for p in paths if p]])
    return spark


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as the session has cores.  A file that Spark cannot split leaves cores idle;
    larger inputs have more splits than cores and pass through unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).  Only a session in one process may name none:
    it gets a folder of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="folioscope-"))
    return _own[0]


def held(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: what several branches of a plan read is computed once,
    each branch reads its own columns, and a lost executor costs a re-read."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
