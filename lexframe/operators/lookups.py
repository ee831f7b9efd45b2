"""Named look-ups: every one is a conjunction of conditions on one table, a sort and sometimes a limit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Lookup:
    """conditions: (column, operator, value); sort: (column, descending). one: at most one row, or none."""

    table: str
    columns: tuple[str, ...]
    conditions: tuple[tuple[str, str, object], ...] = ()
    sort: tuple[tuple[str, bool], ...] = ()
    one: bool = False
    exists: bool = False


def condition(name: str, op: str, value: object) -> Column:
    c = F.col(name)
    if op == "=":
        return c == value
    if op == "is null":
        return c.isNull()
    if op == "in":
        return c.isin(*value)
    if op == "contains":
        return F.contains(F.lower(c), F.lower(F.lit(value)))
    if op == "overlaps":
        return F.arrays_overlap(c, F.array(*(F.lit(v) for v in value)))
    raise ValueError(op)


def order(name: str, descending: bool) -> Column:
    """Nulls last going up and first going down."""
    return F.col(name).desc_nulls_first() if descending else F.col(name).asc_nulls_last()


def run(df: DataFrame, lookup: Lookup) -> DataFrame:
    for c in lookup.conditions:
        df = df.filter(condition(*c))
    if lookup.exists:
        return df.limit(1).agg((F.count("*") > 0).alias("found"))
    df = df.select(*lookup.columns)
    if lookup.sort:
        rest = [c for c in lookup.columns if c not in {s for s, _ in lookup.sort}]  # ties: the other columns
        df = df.orderBy(*(order(*s) for s in lookup.sort), *rest)
    return df.limit(1) if lookup.one else df


ENTRY = ("matter_id", "staff_id", "part", "line", "entry_date", "entry_type", "hours", "rate", "amount", "billed", "billable")
MATTER = ("id", "client_id", "matter_name", "short_name", "matter_type", "status", "is_pro_bono", "retainer_amount", "created_at")
CLIENT = ("id", "first_name", "last_name", "email", "status")
STAFF = ("id", "office_id", "first_name", "last_name", "slug", "uid", "role", "default_billing_rate")
CYCLE = ("id", "matter_id", "period_start", "period_end", "status")
ITEM = ("discovery_request_id", "matter_id", "request_number", "part", "supplier", "status", "client_response_needed", "response")
LEDGER = ("id", "matter_id", "transaction_type", "amount", "transaction_date")
EVENT = ("id", "matter_id", "created_by_staff_id", "event_type", "event_date")
AUDIT = ("id", "action", "entity_type", "entity_id", "uid", "created_at", "after_json")
AGREEMENT = ("id", "matter_id", "status", "created_at")
ROLE = ("uid", "role", "staff_id", "client_id", "auth_email")
CLAIM = ("pleading_id", "matter_id", "part", "line", "kind")
DOWN, UP = True, False

LOOKUPS: dict[str, Lookup] = {
    "scan_all": Lookup("matters", MATTER, sort=(("created_at", DOWN),)),
    "scan_by_pk": Lookup("matters", MATTER, (("id", "=", 42),), one=True),
    "audit_by_entity": Lookup("audit_log", AUDIT, (("entity_type", "=", "matter"), ("entity_id", "=", 8)), (("created_at", UP),)),
    "audit_by_uid": Lookup("audit_log", AUDIT, (("uid", "=", "uid-7"),), (("created_at", DOWN),)),
    "audit_by_action": Lookup("audit_log", AUDIT, (("action", "=", "purchase"),), (("created_at", DOWN),)),
    "cycles_by_matter": Lookup("billing_cycles", CYCLE, (("matter_id", "=", 12),), (("period_start", DOWN),)),
    "cycle_open": Lookup("billing_cycles", CYCLE, (("matter_id", "=", 12), ("status", "=", "open")), (("id", UP),), one=True),
    "cycles_closed": Lookup("billing_cycles", CYCLE, (("matter_id", "=", 12), ("status", "=", "closed")), (("period_start", DOWN),)),
    "entries_by_matter": Lookup("billing_entries", ENTRY, (("matter_id", "=", 42),), (("entry_date", DOWN),)),
    "entries_unbilled": Lookup("billing_entries", ENTRY, (("matter_id", "=", 42), ("billed", "=", False)), (("entry_date", UP),)),
    "entries_by_cycle": Lookup("billing_entries", ENTRY, (("billing_cycle_id", "=", 42),), (("entry_date", UP),)),
    "entries_by_staff": Lookup("billing_entries", ENTRY, (("staff_id", "=", 3),), (("entry_date", DOWN),)),
    "client_by_email": Lookup("clients", CLIENT, (("email", "=", "customer.000000017@mail.example"),), one=True),
    "clients_by_status": Lookup("clients", CLIENT, (("status", "=", "active"),), (("id", UP),)),
    "client_email_exists": Lookup("clients", CLIENT, (("email", "=", "customer.000000017@mail.example"),), exists=True),
    "documents_by_matter": Lookup("discovery_requests", ("id", "matter_id", "propounded_date", "request_type"), (("matter_id", "=", 12),), (("propounded_date", DOWN),)),
    "items_by_document": Lookup("discovery_request_items", ITEM, (("discovery_request_id", "=", 42),), (("request_number", UP),)),
    "items_by_matter": Lookup("discovery_request_items", ITEM, (("matter_id", "=", 43),), (("request_number", UP),)),
    "items_pending_client": Lookup("discovery_request_items", ITEM, (("matter_id", "=", 43), ("status", "=", "pending_client"))),
    "response_by_request": Lookup("discovery_responses", ("id", "request_id", "is_final"), (("request_id", "=", 42),), one=True),
    "agreements_by_matter": Lookup("fee_agreements", AGREEMENT, (("matter_id", "=", 12),), (("created_at", DOWN),)),
    "agreement_executed": Lookup("fee_agreements", AGREEMENT, (("matter_id", "=", 12), ("status", "=", "executed")), (("id", UP),), one=True),
    "agreement_pending_signature": Lookup("fee_agreements", AGREEMENT, (("matter_id", "=", 12), ("status", "=", "sent_to_client")), (("id", UP),), one=True),
    "matters_by_client": Lookup("matters", MATTER, (("client_id", "=", 12),), (("created_at", DOWN),)),
    "matters_by_status": Lookup("matters", MATTER, (("status", "=", "intake"),), (("matter_name", UP),)),
    "matters_active_for_client": Lookup("matters", MATTER, (("client_id", "=", 12), ("status", "=", "active"))),
    "matter_staff_by_matter": Lookup("matter_staff", ("matter_id", "staff_id", "role", "split_pct"), (("matter_id", "=", 42),)),
    "matter_staff_by_staff": Lookup("matter_staff", ("matter_id", "staff_id", "role", "split_pct"), (("staff_id", "=", 3),)),
    "matter_billing_reviewer": Lookup("matter_staff", ("matter_id", "staff_id", "role"), (("matter_id", "=", 43), ("role", "=", "billing_reviewer")), one=True),
    "splits_by_matter": Lookup("billing_splits", ("matter_id", "client_id", "split_pct"), (("matter_id", "=", 12),)),
    "overrides_by_matter": Lookup("matter_rate_overrides", ("matter_id", "staff_id", "rate"), (("matter_id", "=", 42),)),
    "override_for_staff": Lookup("matter_rate_overrides", ("matter_id", "staff_id", "rate"), (("matter_id", "=", 42), ("staff_id", "=", 42)), one=True),
    "opposing_by_matter": Lookup("opposing_parties", ("id", "matter_id", "full_name"), (("matter_id", "=", 120),)),
    "events_by_matter": Lookup("matter_events", EVENT, (("matter_id", "=", 12),), (("event_date", UP),)),
    "events_by_staff": Lookup("matter_events", EVENT, (("created_by_staff_id", "=", 3),), (("event_date", UP),)),
    "children_by_matter": Lookup("matter_children", ("id", "matter_id", "name", "sex", "date_of_birth"), (("matter_id", "=", 12),), (("date_of_birth", UP),)),
    "counsel_by_bar": Lookup("opposing_counsel", ("id", "name", "bar_state", "bar_number", "email"), (("bar_state", "=", "TX"), ("bar_number", "=", "24000004")), one=True),
    "matter_counsel_links": Lookup("matter_opposing_counsel", ("matter_id", "counsel_id", "role"), (("matter_id", "=", 42),)),
    "matter_counsel_exists": Lookup("matter_opposing_counsel", ("matter_id",), (("matter_id", "=", 42), ("counsel_id", "=", 5)), exists=True),
    "pleadings_by_matter": Lookup("matter_pleadings", ("id", "matter_id", "filed_date", "is_supplement", "amends_pleading_id"), (("matter_id", "=", 12),), (("filed_date", UP),)),
    "claims_by_matter": Lookup("matter_claims", CLAIM, (("matter_id", "=", 42),)),
    "claims_by_pleading": Lookup("matter_claims", CLAIM, (("pleading_id", "=", 42),)),
    "claims_by_kind": Lookup("matter_claims", CLAIM, (("matter_id", "=", 42), ("kind", "=", "defense"))),
    "staff_by_uid": Lookup("staff", STAFF, (("uid", "=", "uid-5"),), one=True),
    "staff_by_slug": Lookup("staff", STAFF, (("slug", "=", "supplier-000000005"),), one=True),
    "staff_by_office": Lookup("staff", STAFF, (("office_id", "=", 3),)),
    "staff_slug_exists": Lookup("staff", STAFF, (("slug", "=", "supplier-000000005"),), exists=True),
    "ledger_by_matter": Lookup("trust_ledger", LEDGER, (("matter_id", "=", 12),), (("transaction_date", UP),)),
    "ledger_deposits": Lookup("trust_ledger", LEDGER, (("matter_id", "=", 12), ("transaction_type", "=", "deposit")), (("transaction_date", UP),)),
    "role_by_uid": Lookup("user_roles", ROLE, (("uid", "=", "uid-5"),), one=True),
    "role_by_auth_email": Lookup("user_roles", ROLE, (("auth_email", "=", "customer.000000015@mail.example"), ("uid", "is null", None)), one=True),
    "role_uid_exists": Lookup("user_roles", ROLE, (("uid", "=", "uid-5"),), exists=True),
    "role_by_staff": Lookup("user_roles", ROLE, (("staff_id", "=", 5),), (("role", UP),), one=True),
    "role_by_client": Lookup("user_roles", ROLE, (("client_id", "=", 8),), one=True),
    "role_by_role": Lookup("user_roles", ROLE, (("role", "=", "admin"),)),
    "role_staff_exists": Lookup("user_roles", ROLE, (("staff_id", "=", 5),), exists=True),
    "ui_clients_search": Lookup("clients", CLIENT, (("email", "contains", "R.00000001"),)),
    "ui_active_matters": Lookup("matters", MATTER, (("status", "=", "active"),)),
    "ui_unbilled_entries": Lookup("billing_entries", ENTRY, (("billed", "=", False),)),
    "ui_billable_staff": Lookup("staff", STAFF, (("role", "in", ("attorney", "paralegal")),)),
    "proj_response": Lookup("matters", ("id", "client_id", "matter_name", "status", "is_pro_bono", "retainer_amount")),
    "limit_one": Lookup("matters", MATTER, (("client_id", "=", 12),), (("created_at", DOWN),), one=True),
    "sort_single": Lookup("billing_cycles", CYCLE, sort=(("period_start", DOWN),)),
    "sort_null_rule": Lookup("matter_pleadings", ("id", "filed_date"), sort=(("filed_date", UP),)),
}
