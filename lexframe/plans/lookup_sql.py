"""What each look-up is in SQL, written from the screens and routes that ask for it: the rows, their order, a limit."""

from __future__ import annotations

#: Rows: what stands after FROM. Nulls come last going up and first going down.
ROWS = {
    "scan_all": "matters ORDER BY created_at DESC NULLS FIRST",
    "scan_by_pk": "matters WHERE id = 42",
    "audit_by_entity": "audit_log WHERE entity_type = 'matter' AND entity_id = 8 ORDER BY created_at ASC NULLS LAST",
    "audit_by_uid": "audit_log WHERE uid = 'uid-7' ORDER BY created_at DESC NULLS FIRST",
    "audit_by_action": "audit_log WHERE action = 'purchase' ORDER BY created_at DESC NULLS FIRST",
    "cycles_by_matter": "billing_cycles WHERE matter_id = 12 ORDER BY period_start DESC NULLS FIRST",
    "cycle_open": "billing_cycles WHERE matter_id = 12 AND status = 'open' ORDER BY id LIMIT 1",
    "cycles_closed": "billing_cycles WHERE matter_id = 12 AND status = 'closed' ORDER BY period_start DESC NULLS FIRST",
    "entries_by_matter": "billing_entries WHERE matter_id = 42 ORDER BY entry_date DESC NULLS FIRST",
    "entries_unbilled": "billing_entries WHERE matter_id = 42 AND NOT billed ORDER BY entry_date ASC NULLS LAST",
    "entries_by_cycle": "billing_entries WHERE billing_cycle_id = 42 ORDER BY entry_date ASC NULLS LAST",
    "entries_by_staff": "billing_entries WHERE staff_id = 3 ORDER BY entry_date DESC NULLS FIRST",
    "client_by_email": "clients WHERE email = 'customer.000000017@mail.example' LIMIT 1",
    "clients_by_status": "clients WHERE status = 'active' ORDER BY id",
    "documents_by_matter": "discovery_requests WHERE matter_id = 12 ORDER BY propounded_date DESC NULLS FIRST",
    "items_by_document": "discovery_request_items WHERE discovery_request_id = 42 ORDER BY request_number",
    "items_by_matter": "discovery_request_items WHERE matter_id = 43 ORDER BY request_number",
    "items_pending_client": "discovery_request_items WHERE matter_id = 43 AND status = 'pending_client'",
    "response_by_request": "discovery_responses WHERE request_id = 42 LIMIT 1",
    "agreements_by_matter": "fee_agreements WHERE matter_id = 12 ORDER BY created_at DESC NULLS FIRST",
    "agreement_executed": "fee_agreements WHERE matter_id = 12 AND status = 'executed' ORDER BY id LIMIT 1",
    "agreement_pending_signature": "fee_agreements WHERE matter_id = 12 AND status = 'sent_to_client' ORDER BY id LIMIT 1",
    "matters_by_client": "matters WHERE client_id = 12 ORDER BY created_at DESC NULLS FIRST",
    "matters_by_status": "matters WHERE status = 'intake' ORDER BY matter_name ASC NULLS LAST",
    "matters_active_for_client": "matters WHERE client_id = 12 AND status = 'active'",
    "matter_staff_by_matter": "matter_staff WHERE matter_id = 42",
    "matter_staff_by_staff": "matter_staff WHERE staff_id = 3",
    "matter_billing_reviewer": "matter_staff WHERE matter_id = 43 AND role = 'billing_reviewer' LIMIT 1",
    "splits_by_matter": "billing_splits WHERE matter_id = 12",
    "overrides_by_matter": "matter_rate_overrides WHERE matter_id = 42",
    "override_for_staff": "matter_rate_overrides WHERE matter_id = 42 AND staff_id = 42 LIMIT 1",
    "opposing_by_matter": "opposing_parties WHERE matter_id = 120",
    "events_by_matter": "matter_events WHERE matter_id = 12 ORDER BY event_date ASC NULLS LAST",
    "events_by_staff": "matter_events WHERE created_by_staff_id = 3 ORDER BY event_date ASC NULLS LAST",
    "children_by_matter": "matter_children WHERE matter_id = 12 ORDER BY date_of_birth ASC NULLS LAST",
    "counsel_by_bar": "opposing_counsel WHERE bar_number = '24000004' AND bar_state = 'TX' LIMIT 1",
    "matter_counsel_links": "matter_opposing_counsel WHERE matter_id = 42",
    "pleadings_by_matter": "matter_pleadings WHERE matter_id = 12 ORDER BY filed_date ASC NULLS LAST",
    "claims_by_matter": "matter_claims WHERE matter_id = 42",
    "claims_by_pleading": "matter_claims WHERE pleading_id = 42",
    "claims_by_kind": "matter_claims WHERE matter_id = 42 AND kind = 'defense'",
    "staff_by_uid": "staff WHERE uid = 'uid-5' LIMIT 1",
    "staff_by_slug": "staff WHERE slug = 'supplier-000000005' LIMIT 1",
    "staff_by_office": "staff WHERE office_id = 3",
    "ledger_by_matter": "trust_ledger WHERE matter_id = 12 ORDER BY transaction_date ASC NULLS LAST",
    "ledger_deposits": "trust_ledger WHERE matter_id = 12 AND transaction_type = 'deposit' ORDER BY transaction_date ASC NULLS LAST",
    "role_by_uid": "user_roles WHERE uid = 'uid-5' LIMIT 1",
    "role_by_auth_email": "user_roles WHERE auth_email = 'customer.000000015@mail.example' AND uid IS NULL LIMIT 1",
    "role_by_staff": "user_roles WHERE staff_id = 5 ORDER BY role LIMIT 1",
    "role_by_client": "user_roles WHERE client_id = 8 LIMIT 1",
    "role_by_role": "user_roles WHERE role = 'admin'",
    "ui_clients_search": "clients WHERE lower(email) LIKE '%r.00000001%'",
    "ui_active_matters": "matters WHERE status = 'active'",
    "ui_unbilled_entries": "billing_entries WHERE billed = false",
    "ui_billable_staff": "staff WHERE role = 'attorney' OR role = 'paralegal'",
    "proj_response": "matters",
    "limit_one": "matters WHERE client_id = 12 ORDER BY created_at DESC NULLS FIRST, id LIMIT 1",
    "sort_single": "billing_cycles ORDER BY period_start DESC NULLS FIRST",
    "sort_null_rule": "matter_pleadings ORDER BY filed_date ASC NULLS LAST",
}
#: Look-ups that say only whether there is a row.
EXISTS = {
    "client_email_exists": "clients WHERE email = 'customer.000000017@mail.example'",
    "matter_counsel_exists": "matter_opposing_counsel WHERE matter_id = 42 AND counsel_id = 5",
    "staff_slug_exists": "staff WHERE slug = 'supplier-000000005'",
    "role_uid_exists": "user_roles WHERE uid = 'uid-5'",
    "role_staff_exists": "user_roles WHERE staff_id = 5",
}


def text(name: str, columns: tuple[str, ...], doubles: set[str], dates: set[str]) -> str:
    """The SQL of a look-up, its columns shown as they are compared."""
    if name in EXISTS:
        return f"SELECT EXISTS (SELECT 1 FROM {EXISTS[name]}) AS found"
    shown = ", ".join(f"CAST({c} AS {'DOUBLE' if c in doubles else 'VARCHAR'}) AS {c}" if c in doubles | dates else c for c in columns)
    return f"SELECT {shown} FROM (SELECT * FROM {ROWS[name]}) AS q"
