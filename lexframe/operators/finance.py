"""Balances, rates and the billing views: set-based, exact decimals, one pass over each fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalar

MONEY = "decimal(12,2)"


def signed(kind: Column, amount: Column) -> Column:
    return F.when(kind == "deposit", amount).otherwise(-amount)


def trust_balance(ledger: DataFrame) -> DataFrame:
    """matter_id, trust: deposits less everything else."""
    return ledger.groupBy("matter_id").agg(F.sum(signed(F.col("transaction_type"), F.col("amount"))).alias("trust"))


def unbilled_total(entries: DataFrame) -> DataFrame:
    """matter_id, unbilled: amounts, or hours times rate, of billable entries that are not billed."""
    amount = scalar.compute_amount(F.col("amount"), F.col("hours"), F.col("rate"))
    return entries.filter(~F.col("billed") & F.col("billable")).groupBy("matter_id").agg(F.sum(F.coalesce(amount, F.lit(0))).alias("unbilled"))


def ui_unbilled(entries: DataFrame) -> DataFrame:
    """The screen's total: amounts only, entries that are not billable too."""
    return entries.filter(~F.col("billed")).groupBy("matter_id").agg(F.sum(F.coalesce("amount", F.lit(0))).alias("unbilled"))


def pro_bono_zero(entries: DataFrame, matters: DataFrame) -> DataFrame:
    """Time on a pro-bono matter has rate and amount 0; expenses and flat fees stay."""
    free = matters.select(F.col("id").alias("matter_id"), "is_pro_bono")
    zero = F.coalesce("is_pro_bono", F.lit(False)) & (F.col("entry_type") == "time")
    joined = entries.join(free, "matter_id", "left")
    return joined.withColumns({c: F.when(zero, F.lit(0).cast(t)).otherwise(F.col(c)) for c, t in (("rate", "decimal(10,2)"), ("amount", MONEY))}).drop("is_pro_bono")


def unbilled_of_kinds(entries: DataFrame) -> DataFrame:
    """matter_id, unbilled, unbilled_time: the total, and what of it is time."""
    amount = F.coalesce(scalar.compute_amount(F.col("amount"), F.col("hours"), F.col("rate")), F.lit(0))
    time = F.when(F.col("entry_type") == "time", amount).otherwise(F.lit(0))
    return entries.filter(~F.col("billed") & F.col("billable")).groupBy("matter_id").agg(F.sum(amount).alias("unbilled"), F.sum(time).alias("unbilled_time"))


def matter_balance(matters: DataFrame, ledger: DataFrame, entries: DataFrame, *also: Column, zero_pro_bono: bool = False) -> DataFrame:
    """One row a matter: trust, unbilled, balance and its status, and other columns of the matter. Both sides are
    aggregated before they are joined. With zero_pro_bono time on a pro-bono matter counts as nothing, whatever its
    entries say: its part of the total is left out, and no entry is joined to its matter for that."""
    spent = (unbilled_of_kinds if zero_pro_bono else unbilled_total)(entries).withColumnRenamed("matter_id", "id")
    joined = matters.join(trust_balance(ledger).withColumnRenamed("matter_id", "id"), "id", "left").join(spent, "id", "left")
    if zero_pro_bono:
        joined = joined.withColumn("unbilled", F.when(F.col("is_pro_bono"), F.col("unbilled") - F.col("unbilled_time")).otherwise(F.col("unbilled")))
    trust, unbilled = F.coalesce("trust", F.lit(0).cast(MONEY)), F.coalesce("unbilled", F.lit(0).cast(MONEY))
    return joined.select(
        F.col("id").alias("matter_id"),
        scalar.round2(trust).cast("double").alias("trust"),
        scalar.round2(unbilled).cast("double").alias("unbilled"),
        scalar.round2(trust - unbilled).cast("double").alias("balance"),
        scalar.balance_status(trust - unbilled, F.col("retainer_amount"), F.col("refresh_trigger_pct")).alias("status"),
        *also,
    )


def matter_summary(matters: DataFrame, clients: DataFrame, ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """Matters with client and balance; the matters are read and joined once."""
    rows = matter_balance(matters, ledger, entries, F.col("client_id"), F.col("matter_name"), F.col("status").alias("matter_status"))
    rows = rows.withColumnsRenamed({"status": "balance_status", "matter_status": "status", "matter_id": "id"})
    who = clients.select(F.col("id").alias("client_id"), scalar.name_to_text(F.col("first_name"), F.col("last_name")).alias("client_name"), F.col("email").alias("client_email"))
    return rows.join(who, "client_id").select("id", "client_id", "matter_name", "status", "client_name", "client_email", "trust", "unbilled", "balance", "balance_status")


def unbilled_entries(entries: DataFrame, matters: DataFrame, staff: DataFrame) -> DataFrame:
    """Unbilled billable entries with names, role and computed amount."""
    m = matters.select(F.col("id").alias("matter_id"), "matter_name", "client_id")
    s = staff.select(F.col("id").alias("staff_id"), scalar.name_to_text(F.col("first_name"), F.col("last_name")).alias("staff_name"), F.col("role").alias("staff_role"))
    amount = scalar.compute_amount(F.col("amount"), F.col("hours"), F.col("rate"))
    rows = entries.filter(~F.col("billed") & F.col("billable"))
    return rows.join(m, "matter_id").join(s, "staff_id").select(
        "matter_id", "matter_name", "client_id", "staff_id", "staff_name", "staff_role", "entry_type", "part", "line", F.round(amount, 2).cast("double").alias("computed_amount")
    )


def discovery_progress(items: DataFrame, documents: DataFrame, matters: DataFrame) -> DataFrame:
    """Counts of items by status for each matter and request type; the type is the parent document's."""
    d = documents.select(F.col("id").alias("discovery_request_id"), "request_type")
    m = matters.select(F.col("id").alias("matter_id"), "matter_name")
    counts = items.join(d, "discovery_request_id").groupBy("matter_id", "request_type").agg(
        *(F.count_if(F.col("status") == s).alias(s) for s in ("pending_client", "pending_review", "finalized", "objected")), F.count("*").alias("total")
    )
    return counts.join(m, "matter_id")


def resolve_rates(pairs: DataFrame, matters: DataFrame, staff: DataFrame, overrides: DataFrame) -> DataFrame:
    """(matter_id, staff_id) with rate: pro bono, override, rate card, default; null if there is none."""
    m = matters.select(F.col("id").alias("matter_id"), "is_pro_bono", "card_attorney", "card_paralegal")
    s = staff.select(F.col("id").alias("staff_id"), "role", "default_billing_rate")
    o = overrides.select("matter_id", "staff_id", F.col("rate").alias("override"))
    rate = scalar.resolve_rate(*(F.col(c) for c in ("is_pro_bono", "override", "role", "card_attorney", "card_paralegal", "default_billing_rate")))
    return pairs.join(m, "matter_id").join(s, "staff_id").join(o, ["matter_id", "staff_id"], "left").select("matter_id", "staff_id", rate.alias("rate"))


def unknown_pairs(pairs: DataFrame, matters: DataFrame, staff: DataFrame) -> DataFrame:
    """Pairs whose matter or staff does not exist: no rate can be told."""
    known = pairs.join(matters.select(F.col("id").alias("matter_id")), "matter_id", "left_semi").join(staff.select(F.col("id").alias("staff_id")), "staff_id", "left_semi")
    return pairs.join(known, ["matter_id", "staff_id"], "left_anti")


def running_trust(ledger: DataFrame) -> DataFrame:
    """The balance after each transaction of a matter: the sum of the days before, from one row a day, and the
    running sum within the day. A matter with very many transactions is spread over its days."""
    amount = signed(F.col("transaction_type"), F.col("amount"))
    days = ledger.groupBy("matter_id", "transaction_date").agg(F.sum(amount).alias("_day"))
    earlier = Window.partitionBy("matter_id").orderBy("transaction_date").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select(F.col("matter_id").alias("_m"), F.col("transaction_date").alias("_d"), F.coalesce(F.sum("_day").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("matter_id", "transaction_date").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ledger.withColumn("_within", F.sum(amount).over(within)).join(before, F.col("matter_id").eqNullSafe(F.col("_m")) & F.col("transaction_date").eqNullSafe(F.col("_d")))
    return rows.withColumn("running", F.col("_before") + F.col("_within")).select(*ledger.columns, "running")


def latest_version(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The newest row of each key; an aggregate, so no sort and no hot window."""
    newest = F.max(F.struct(*version, *(c for c in rows.columns if c not in version)))
    return rows.groupBy(*keys).agg(newest.alias("_n")).select("_n.*").select(rows.columns)


def close_cycle(entries: DataFrame, cycles: DataFrame, cycle_ids: DataFrame, closed_by: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, cycles, audit) after open cycles in cycle_ids are closed: their entries are billed. Cycles that
    are closed already are left alone. Entries without a cycle, which may be most, meet none: they are not shuffled to
    the one task that nulls hash to."""
    closing = cycles.join(cycle_ids, "id", "left_semi").filter(F.col("status") == "open").select(F.col("id").alias("_cycle"))
    marked = entries.filter("billing_cycle_id is not null").join(closing, F.col("billing_cycle_id") == F.col("_cycle"), "left")
    met = marked.withColumn("billed", F.col("billed") | F.col("_cycle").isNotNull()).select(entries.columns)
    loose = entries.filter("billing_cycle_id is null").withColumn("billed", F.col("billed") | F.lit(False))
    new_entries = met.unionByName(loose)
    new_cycles = cycles.join(closing, F.col("id") == F.col("_cycle"), "left").withColumn("status", F.when(F.col("_cycle").isNotNull(), "closed").otherwise(F.col("status"))).select(cycles.columns)
    audit = closing.select(F.lit("billing_cycle.close").alias("action"), F.lit("billing_cycle").alias("entity_type"), F.col("_cycle").alias("entity_id"), F.lit(closed_by).alias("staff_id"))
    return new_entries, new_cycles, audit


def produce_bill(entries: DataFrame, splits: DataFrame) -> DataFrame:
    """matter_id, client_id, share: each matter's unbilled total by its clients' splits, to the cent. Cents that
    rounding down leaves go to the largest remainders, so shares add up to the split part of the total."""
    total = unbilled_total(entries)
    exact = F.col("unbilled") * F.col("split_pct")  # hundredths of a share
    rows = total.join(splits, "matter_id").withColumns({"_cents": F.floor(exact).cast("long"), "_rest": exact - F.floor(exact)})
    by = Window.partitionBy("matter_id")
    left = F.round(F.sum("_rest").over(by)).cast("long")
    rank = F.row_number().over(by.orderBy(F.col("_rest").desc(), "client_id"))
    return rows.withColumn("share", ((F.col("_cents") + F.when(rank <= left, 1).otherwise(0)) / 100).cast("decimal(14,2)")).select("matter_id", "client_id", "split_pct", "share")
