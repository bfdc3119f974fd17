"""The folder that all executors share, and cutting lineage in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is not set, a folder of our own on one machine, and an error on a cluster."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir")
    if path:
        return path
    master = conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    return _OWN[app]


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder (reliable checkpoint)."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
