"""Writes. A table is a folder of batches; a batch is written aside, judged there, and moved in by one rename, so a
reader sees all of it or nothing. Other writes make a new snapshot, which can take the table's place the same way. One
writer at a time: two batches that are judged beside each other do not know of each other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.shared import exists, move, remove, written
from . import integrity
from .finance import latest_version


class Refused(ValueError):
    """Rows break a rule; `violations` holds them."""

    def __init__(self, violations: DataFrame) -> None:
        super().__init__("the rows break a rule")
        self.violations = violations


def insert(table: DataFrame, rows: DataFrame, violations: DataFrame | None = None) -> DataFrame:
    if violations is not None and violations.limit(1).count():
        raise Refused(violations)
    return table.unionByName(rows, allowMissingColumns=True)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table's batches; each is a folder in the table's."""
    return spark.read.option("recursiveFileLookup", "true").parquet(path)


def append(path: str, name: str, rows: DataFrame, key: list[str] | None = None, parents: integrity.Tables | None = None) -> None:
    """Add rows to a domain table's folder, if they break no rule of the table; else nothing is written. `parents` are the
    tables that the rows refer to; `key` are the columns that name a row in the violations."""
    spark = rows.sparkSession
    aside = f"{path}.staged-{uuid.uuid4().hex}"
    rows.write.parquet(aside)
    try:
        batch = spark.read.schema(rows.schema).parquet(aside)
        held = read(spark, path) if exists(spark, path) else None
        broken = written(integrity.violations(name, batch, held, parents or {}, key), "violations")
        if broken.limit(1).count():
            raise Refused(broken)
        move(spark, aside, f"{path}/batch-{uuid.uuid4().hex}")
    finally:
        if exists(spark, aside):
            remove(spark, aside)


def replace(path: str, table: DataFrame) -> None:
    """A new snapshot takes the table's place. It is written aside while the old one is read. If the job is lost between
    the two renames the old one lies beside, named .old; nothing is lost."""
    spark, token = table.sparkSession, uuid.uuid4().hex
    aside, old = f"{path}.staged-{token}", f"{path}.old-{token}"
    table.write.parquet(f"{aside}/batch-{token}")
    if exists(spark, path):
        move(spark, path, old)
    move(spark, aside, path)
    if exists(spark, old):
        remove(spark, old)


def update(table: DataFrame, patch: DataFrame, key: str = "id", touched: str | None = None) -> DataFrame:
    """Values of the patch where they are not null. An empty patch is refused. `touched` (a timestamp's text)
    goes into updated_at of the rows that the patch names."""
    fields = [c for c in patch.columns if c != key]
    if not fields:
        raise ValueError("the patch has no field")
    new = patch.select(key, *(F.col(c).alias(f"_{c}") for c in fields), F.lit(True).alias("_hit"))
    joined = table.join(new, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in fields})
    if touched and "updated_at" in table.columns:
        joined = joined.withColumn("updated_at", F.when(F.col("_hit"), F.lit(touched).cast(table.schema["updated_at"].dataType)).otherwise(F.col("updated_at")))
    return joined.select(table.columns)


def delete(tables: dict[str, DataFrame], name: str, ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows and what hangs on them. Deletes that a row stands against are left out; see
    `integrity.delete` for which, and for what became of each row."""
    return integrity.delete(tables, name, ids).tables


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """Rows replace those of the same key. Of several new ones for a key that with the greatest version stays; without a
    version column, the greatest row."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = ["_new", *([version] if version else [])]
    return latest_version(both, keys, order).select(table.columns)


def audit(action: str, entity_type: str, before: DataFrame, after: DataFrame, uid: str, key: str = "id") -> DataFrame:
    """A row for each entity, with the values before and after as JSON."""
    old = before.select(F.col(key).alias("entity_id"), F.to_json(F.struct(*before.columns)).alias("before_json"))
    new = after.select(F.col(key).alias("entity_id"), F.to_json(F.struct(*after.columns)).alias("after_json"))
    return old.join(new, "entity_id", "full").select(F.lit(action).alias("action"), F.lit(entity_type).alias("entity_type"), "entity_id", F.lit(uid).alias("uid"), "before_json", "after_json")
