"""Joins, projections and counts of the screens and routes that are not money, conflicts or security."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalar
from ..sources.shared import fresh_path, narrow, written


def matter_client(matters: DataFrame, clients: DataFrame) -> DataFrame:
    who = clients.select(F.col("id").alias("client_id"), "email", F.col("status").alias("client_status"))
    return matters.select("id", "client_id", "matter_name").join(who, "client_id")


def entries_matter_staff(entries: DataFrame, matters: DataFrame, staff: DataFrame) -> DataFrame:
    m = matters.select(F.col("id").alias("matter_id"), "matter_name")
    s = staff.select(F.col("id").alias("staff_id"), "role")
    return entries.join(m, "matter_id").join(s, "staff_id").groupBy("role", "entry_type").agg(F.count("*").alias("n"), F.sum("hours").alias("hours"))


def document_items(documents: DataFrame, matters: DataFrame, items: DataFrame) -> DataFrame:
    """Documents with their matter's name (or "Unknown Matter") and their items."""
    m = matters.select(F.col("id").alias("matter_id"), F.coalesce(F.nullif("short_name", F.lit("")), "matter_name").alias("matter"))
    d = documents.select(F.col("id").alias("discovery_request_id"), "matter_id", "request_type").join(m, "matter_id", "left")
    rows = items.select("discovery_request_id", "request_number", "part", "supplier", "status")
    return d.join(rows, "discovery_request_id").withColumn("matter", F.coalesce("matter", F.lit("Unknown Matter")))


def linked_counsel(links: DataFrame, counsel: DataFrame) -> DataFrame:
    """Counsel of a matter; a link repeated is repeated, a missing counsel is skipped."""
    return links.join(counsel.select(F.col("id").alias("counsel_id"), "name", "bar_state", "bar_number"), "counsel_id")


def match_counsel(proposed: DataFrame, counsel: DataFrame) -> DataFrame:
    """Proposed counsel with the id of the one that has this bar state and number; null if new or incomplete."""
    known = counsel.select("bar_state", "bar_number", F.col("id").alias("counsel_id"))
    complete = (F.col("bar_state") != "") & (F.col("bar_number") != "")
    return proposed.join(known, ["bar_state", "bar_number"], "left").withColumn("counsel_id", F.when(complete, F.col("counsel_id")))


def unlinked(links: DataFrame, existing: DataFrame) -> DataFrame:
    return links.join(existing, ["matter_id", "counsel_id"], "left_anti")


def superseded_anti(pleadings: DataFrame) -> DataFrame:
    """Pleadings that no other amends."""
    amended = pleadings.filter("amends_pleading_id is not null").select(F.col("amends_pleading_id").alias("id"))
    return pleadings.join(amended, "id", "left_anti")


def live_pleadings(pleadings: DataFrame) -> DataFrame:
    return superseded_anti(pleadings).filter(~F.col("is_supplement"))


def amend_chains(pleadings: DataFrame) -> DataFrame:
    """id, root, depth: each pleading's first one and the steps from it. Pointers are doubled, so a chain of n
    takes log2(n) joins; a cycle ends after as many rounds as its length could need."""
    rows = pleadings.select("id", F.coalesce("amends_pleading_id", "id").alias("root"), F.when(F.col("amends_pleading_id").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    open_ends = rows.count()
    rounds = max(1, open_ends.bit_length())
    for _ in range(rounds):
        up = rows.select(F.col("id").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        further = rows.join(up, "root", "left").select("id", F.coalesce("_root", "root").alias("next"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), "root")
        path = fresh_path(rows.sparkSession, "chains")
        further.write.parquet(path)  # lineage ends here: rounds do not pile up
        further = rows.sparkSession.read.schema(further.schema).parquet(path)
        if not further.filter("next <> root").limit(1).count():
            return further.select("id", F.col("next").alias("root"), "depth")
        rows = further.select("id", F.col("next").alias("root"), "depth")
    return rows


def staff_display(entries: DataFrame, staff: DataFrame) -> DataFrame:
    s = staff.select(F.col("id").alias("staff_id"), "first_name", "last_name")
    return entries.join(s, "staff_id", "left").select("staff_id", scalar.staff_display(F.col("staff_id"), F.col("first_name"), F.col("last_name")).alias("display"))


def filter_matters(matters: DataFrame, show: str, query: str) -> DataFrame:
    """Open or closed matters whose short or full name has the text in it."""
    closed = scalar.is_closed(F.col("status"))
    named = F.coalesce(F.contains(F.lower("short_name"), F.lit(query.lower())), F.lit(False)) | F.contains(F.lower("matter_name"), F.lit(query.lower()))
    return matters.filter({"open": ~closed, "closed": closed}.get(show, F.lit(True))).filter(named)


def sorted_matters(matters: DataFrame) -> DataFrame:
    """Open before closed, then by name."""
    return matters.orderBy(*matters_order())


def matters_order() -> list[Column]:
    return [F.when(scalar.is_closed(F.col("status")), 1).otherwise(0), F.lower(scalar.display_name(F.col("short_name"), F.col("matter_name"))), F.col("id")]


def placed(rows: DataFrame, order: list[Column], within: str | None = None) -> DataFrame:
    """rows with their place (from 1) in an order, of all or within the rows of one value. Rows are dealt into ranges
    of the order and numbered in each; the sizes of the ranges (or of a value's parts of them) before give the rest, so
    no task sees more than a range. What rows come from is worked out once: the ranges are sampled from a table."""
    spark, by, own = rows.sparkSession, [*([F.col(within)] if within else []), *order], [within] if within else []
    path = fresh_path(spark, "ranges")
    written(rows, "unplaced").repartitionByRange(*by).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    sizes = ranged.groupBy("_range", *own).agg(F.count("*").alias("_n"))
    before = (Window.partitionBy(*own) if within else Window).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = sizes.select(F.col("_range").alias("_of"), *(F.col(c).alias("_value") for c in own), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = (F.col("_range") == F.col("_of")) & (F.col(within).eqNullSafe(F.col("_value")) if within else F.lit(True))
    place = F.row_number().over(Window.partitionBy("_range", *own).orderBy(*order))
    return ranged.withColumn("place", place).join(narrow(offsets), same).select(*rows.columns, (F.col("place") + F.col("_before")).alias("place"))


def exist(keys: DataFrame, rows: DataFrame, on: str) -> DataFrame:
    """keys with `found`: whether rows has the key."""
    return keys.join(rows.select(on).distinct().withColumn("found", F.lit(True)), on, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def recent_matters(matters: DataFrame, n: int = 8) -> DataFrame:
    return matters.orderBy(F.col("created_at").desc_nulls_first(), "id").limit(n)


def dashboard(matters: DataFrame) -> DataFrame:
    return matters.agg(F.count_if(~scalar.is_closed(F.col("status"))).alias("open"), F.count("*").alias("total"), F.count_if("is_pro_bono").alias("pro_bono"))


def staff_linked(staff: DataFrame) -> DataFrame:
    linked = F.coalesce(F.col("uid") != "", F.lit(False))
    return staff.agg(F.count_if(linked).alias("linked"), F.count_if(~linked).alias("unlinked"))


def nav_items(items: DataFrame, role: str) -> DataFrame:
    return items.filter(F.col("roles").isNull() | (F.size("roles") == 0) | F.array_contains("roles", role))


def row_numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
