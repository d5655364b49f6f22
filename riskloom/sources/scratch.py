"""A folder that the driver and all executors share, for checkpoints and tables between jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the cluster names it; only where that is unset, a folder of our own, which needs a local master."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="riskloom-"))
    return _own[0]


def checkpoints(spark: SparkSession) -> None:
    """Lets DataFrame.checkpoint() write to that folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder(spark))
