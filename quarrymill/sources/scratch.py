"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows that a join may broadcast; the callers' rows are keys of at most a few dozen bytes.
BROADCAST_ROWS = 1_000_000


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="quarrymill-")


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where none is set and Spark runs on it alone."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return shared or _own_dir()


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """``df``, computed once and written as Parquet: for tables that a plan reads more than once, with pruning at each reading."""
    path = f"{scratch_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame) -> bool:
    """Whether ``df`` has at most BROADCAST_ROWS; the count is a job at planning time, so ``df`` should be cut."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def small(df: DataFrame) -> DataFrame:
    """``df``, broadcast if it ``is_small``."""
    return F.broadcast(df) if is_small(df) else df
