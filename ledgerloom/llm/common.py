"""Helpers shared by the training-data operators: reading tables, cutting lineage, broadcasting."""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.shared import cut, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_shuffle(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


HOT, LEAST_HOT = 1_024, 1_000


def join_hot(rows: DataFrame, side: DataFrame, key: str, size: str) -> DataFrame:
    """rows left-joined with side, which has one row per key and in `size` how many of rows share it.

    A key is hot if more than one in HOT of all rows (and LEAST_HOT) have it, so there are fewer than HOT: what
    is said of them is broadcast and their rows stay where they are. All other keys have few rows and meet in a join.
    """
    total = side.agg(F.coalesce(F.sum(size), F.lit(0)).alias("_total"))
    judged = side.join(F.broadcast(total))  # one row
    is_hot = F.col(size) > F.greatest(F.lit(LEAST_HOT), F.col("_total") / HOT)
    hot = F.broadcast(judged.where(is_hot).drop("_total").withColumn("_hot", F.lit(True)))
    told = rows.join(hot, key, "left")
    others = told.where("_hot is null").select(*rows.columns).join(judged.where(~is_hot).drop("_total"), key, "left")
    return told.where("_hot").drop("_hot").unionByName(others)


def kept(name: str, make: Callable):
    """An object that a Python worker keeps between tasks, made by the first that asks for it; the functions themselves travel with each task."""
    held = vars(sys.modules.setdefault("ledgerloom_worker", types.ModuleType("ledgerloom_worker")))
    if name not in held:
        held[name] = make()
    return held[name]


def held_out(doc_id: Column) -> Column:
    """One fifth of the documents, by a hash of the id alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def held_out_py(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
