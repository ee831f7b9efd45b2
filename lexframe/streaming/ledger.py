"""Streams over the two append-only tables. Their final state equals the batch aggregates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.finance import signed
from ..sources.shared import move, remove


def trust_balances(ledger: DataFrame) -> DataFrame:
    """Running balance of each matter, for output mode update or complete."""
    return ledger.groupBy("matter_id").agg(F.sum(signed(F.col("transaction_type"), F.col("amount"))).alias("trust"))


def audit_counts(log: DataFrame, time: str = "created_at", late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Tumbling counts by action; a window is emitted when no event of it can come any more. The time column is
    made a timestamp, since a timestamp without a zone takes no watermark."""
    rows = log.withColumn("_t", F.col(time).cast("timestamp"))
    return rows.withWatermark("_t", late).groupBy(F.window("_t", width).alias("w"), "action").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "action", "n")


def upsert(stream: DataFrame, path: str, marks: str) -> StreamingQuery:
    """Write a stream in update mode as versions of its rows: batch n is the folder batch=n, whole or not at all. A batch
    that is done again after a loss takes its own folder's place, so nothing is written twice. The stream's state is a
    row for each key; its output is the rows that changed."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", marks).trigger(availableNow=True).start()


def newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest version of each row that `upsert` wrote."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_n")).select(*keys, "_n.*")


def compact(spark: SparkSession, path: str, keys: list[str]) -> None:
    """One folder for all batches so far, between runs of the stream: the newest rows as the last batch's."""
    last = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    aside = f"{path}.compact-{uuid.uuid4().hex}"
    newest(spark, path, keys).write.parquet(f"{aside}/batch={last}")
    old = f"{path}.old-{uuid.uuid4().hex}"
    move(spark, path, old)
    move(spark, aside, path)
    remove(spark, old)
