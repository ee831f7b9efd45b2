"""The folder that driver and executors share, for what a job writes on its way; and moves within a store."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A side of a join is broadcast only when it was counted and has at most this many narrow rows.
BROADCAST_ROWS = 200_000
_own: dict[str, str] = {}


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, or in one of our own where it names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="lexframe-"))
    return f"{root}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and a lost executor costs a reread."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrow(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count of its rows allows that, else as it is (a shuffled join)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, store = _store(spark, path)
    return store.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where, store = _store(spark, path)
    store.delete(where, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename a folder; one step of the store, so a reader sees all of it or nothing."""
    where, store = _store(spark, path)
    target, _ = _store(spark, to)
    store.mkdirs(target.getParent())
    if not store.rename(where, target):
        raise OSError(f"{path} could not be moved to {to}")
