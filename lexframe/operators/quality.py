"""Integrity rules as data-quality operators: each returns its violations, and writers refuse if there are any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: What enumerated columns may hold.
DOMAINS = {
    ("matters", "status"): ("intake", "conflict_review", "active", "closed", "archived"),
    ("matters", "matter_type"): ("divorce", "child_custody", "modification", "enforcement", "cps", "probate", "estate_planning", "civil", "other"),
    ("clients", "status"): ("prospect", "pending_conflict_check", "conflict_flagged", "active", "inactive"),
    ("staff", "role"): ("attorney", "paralegal", "admin"),
    ("user_roles", "role"): ("client", "attorney", "paralegal", "admin"),
    ("billing_entries", "entry_type"): ("time", "expense", "flat_fee"),
    ("billing_cycles", "status"): ("open", "closed"),
    ("trust_ledger", "transaction_type"): ("deposit", "withdrawal", "refund"),
    ("matter_events", "event_type"): ("hearing", "deposition", "deadline", "mediation", "appointment", "other"),
    ("fee_agreements", "status"): ("draft", "sent_to_client", "executed", "voided"),
    ("discovery_requests", "request_type"): ("interrogatories", "production", "disclosures", "admissions"),
    ("discovery_request_items", "status"): ("pending_client", "pending_review", "finalized", "objected"),
    ("matter_claims", "kind"): ("claim", "defense", "affirmative_defense", "counterclaim"),
    ("matter_staff", "role"): ("originating", "billing_reviewer", "assigned"),
    ("matter_opposing_counsel", "role"): ("lead", "co_counsel", "local_counsel"),
}


def failing(rows: DataFrame, rules: dict[str, Column], key: list[str]) -> DataFrame:
    """A row for each rule that a row breaks: rule and key. A rule whose value is null holds, as in a database."""
    broken = F.filter(F.array(*(F.when(~rule, F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())
    return rows.select(*key, F.explode(broken).alias("rule"))


def entry_type_rules() -> dict[str, Column]:
    kind = F.col("entry_type")
    return {
        "time_requires_hours": (kind != "time") | F.col("hours").isNotNull(),
        "expense_requires_amount": (kind != "expense") | F.col("amount").isNotNull(),
        "flat_fee_requires_amount": (kind != "flat_fee") | F.col("amount").isNotNull(),
        "time_requires_rate_or_amount": (kind != "time") | F.col("rate").isNotNull() | F.col("amount").isNotNull(),
    }


def range_rules() -> dict[str, Column]:
    return {f"{c}_not_negative": F.col(c) >= 0 for c in ("hours", "rate", "amount")}


def period_rules() -> dict[str, Column]:
    return {"period_order": F.col("period_end") >= F.col("period_start")}


def role_rules() -> dict[str, Column]:
    staff = F.col("staff_id").isNotNull() & F.col("client_id").isNull()
    client = F.col("client_id").isNotNull() & F.col("staff_id").isNull()
    return {"role_link": F.when(F.col("role") == "client", client).otherwise(staff)}


def split_totals(splits: DataFrame) -> DataFrame:
    return splits.groupBy("matter_id").agg(F.coalesce(F.sum("split_pct"), F.lit(0)).alias("total"))


def over_split(splits: DataFrame) -> DataFrame:
    """Matters whose splits exceed 100."""
    return split_totals(splits).filter("total > 100")


def incomplete_splits(splits: DataFrame) -> DataFrame:
    """Matters whose splits are below 100: reported, not refused."""
    return split_totals(splits).filter("total < 100")


def originating(matter_staff: DataFrame) -> DataFrame:
    return matter_staff.groupBy("matter_id").agg(
        F.sum(F.when(F.col("role") == "originating", F.coalesce("split_pct", F.lit(0)))).alias("total"), F.count_if(F.col("role") == "originating").alias("n")
    )


def outside_domain(rows: DataFrame, table: str, column: str, key: list[str]) -> DataFrame:
    return failing(rows, {f"{table}.{column}": F.col(column).isin(*DOMAINS[table, column])}, key)


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(rows: DataFrame, column: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows that refer to a parent that does not exist; nulls refer to none."""
    return rows.filter(F.col(column).isNotNull()).join(parent.select(F.col(parent_key).alias(column)), column, "left_anti")


def changed_log(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of an append-only table that are no longer there as they were."""
    return before.join(after, [before[c].eqNullSafe(after[c]) for c in before.columns], "left_anti")


LOCKED = ("description", "hours", "rate", "amount", "entry_type", "entry_date", "billable")


def billed_changes(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """Entries that were billed and stay so but differ in a locked column."""
    locked = [c for c in LOCKED if c in before.columns]
    old = before.filter("billed").select(key, *(F.col(c).alias(f"_{c}") for c in locked))
    differs = [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in locked]
    changed = differs[0]
    for d in differs[1:]:
        changed = changed | d
    return after.filter("billed").join(old, key).filter(changed).select(key)


def already_taken(incoming: DataFrame, existing: DataFrame, column: str) -> DataFrame:
    """Incoming rows whose value another row has."""
    return incoming.join(existing.select(column), column, "left_semi")
