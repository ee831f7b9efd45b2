"""Figures of the practice by any combination of dimensions, and by any period.

What is exact is a cube: every combination of the dimensions in one aggregation. What cannot be added up day by day
(distinct matters, quantiles of amounts) is kept as a sketch a day, of a fixed size; a period's figure is the merge of its
days, so no entry is read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalar

#: Registers of a distinct count, as a power of two; size of a quantile sketch. Their errors are about 1.6 and 1 %.
DISTINCT, QUANTILES = 12, 200
ALL = "all"


def revenue(entries: DataFrame, matters: DataFrame, staff: DataFrame) -> DataFrame:
    """matter_type, role, entry_type, n, hours, amount of billable entries for all combinations; "all" is any value."""
    m = matters.select(F.col("id").alias("matter_id"), "matter_type")
    s = staff.select(F.col("id").alias("staff_id"), "role")
    amount = scalar.compute_amount(F.col("amount"), F.col("hours"), F.col("rate"))
    rows = entries.filter("billable").groupBy("matter_id", "staff_id", "entry_type").agg(F.count("*").alias("n"), F.sum("hours").alias("hours"), F.sum(amount).alias("amount"))
    cube = rows.join(m, "matter_id").join(s, "staff_id").cube("matter_type", "role", "entry_type")
    found = cube.agg(F.sum("n").alias("n"), F.sum("hours").alias("hours"), F.sum("amount").alias("amount"), *(F.grouping(c).alias(f"_{c}") for c in ("matter_type", "role", "entry_type")))
    return found.select(*(F.when(F.col(f"_{c}") == 1, ALL).otherwise(F.col(c)).alias(c) for c in ("matter_type", "role", "entry_type")), "n", "hours", "amount")


def daily(ledger: DataFrame) -> DataFrame:
    """A row a day and kind of transaction: n, total, and sketches of the matters and of the amounts."""
    return ledger.groupBy("transaction_date", "transaction_type").agg(
        F.count("*").alias("n"), F.sum("amount").alias("total"),
        F.hll_sketch_agg("matter_id", F.lit(DISTINCT)).alias("matters"), F.kll_sketch_agg_double(F.col("amount").cast("double"), F.lit(QUANTILES)).alias("amounts"),
    )


def periods(days: DataFrame, period: str = "month") -> DataFrame:
    """start, transaction_type, n, total, matters (distinct, about), median (about), from the rows of `daily`."""
    merged = days.groupBy(F.trunc("transaction_date", period).alias("start"), "transaction_type").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.hll_union_agg("matters").alias("m"), F.kll_merge_agg_double("amounts").alias("a")
    )
    return merged.select("start", "transaction_type", "n", "total", F.hll_sketch_estimate("m").alias("matters"), F.kll_sketch_get_quantile_double("a", F.lit(0.5)).alias("median"))
