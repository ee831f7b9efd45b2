"""Domain tables over star-schema Parquet tables (orders, lineitem, ...).

Each table is one SELECT that Spark and DuckDB both run, so a query and its SQL start from the same rows. Spark
reads lazily: filters and column selection of whatever stands above reach the Parquet scan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Domain table: its SELECT; {x} is a source table.
TABLES = {
    "offices": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM {nation}",
    "staff": """SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS office_id, split_part(s_name, '#', 1) AS first_name, split_part(s_name, '#', 2) AS last_name,
        lower(replace(s_name, '#', '-')) AS slug, CASE WHEN s_suppkey % 7 <> 0 THEN 'uid-' || CAST(s_suppkey AS VARCHAR(20)) END AS uid,
        CASE WHEN s_suppkey % 3 = 0 THEN 'attorney' WHEN s_suppkey % 3 = 1 THEN 'paralegal' ELSE 'admin' END AS role,
        CASE WHEN s_suppkey % 3 <> 2 THEN CAST(100 + (s_suppkey % 10) * 25 AS DECIMAL(10, 2)) END AS default_billing_rate FROM {supplier}""",
    "clients": """SELECT c_custkey AS id, split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name,
        lower(replace(c_name, '#', '.')) || '@mail.example' AS email,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'prospect' WHEN 'AUTOMOBILE' THEN 'pending_conflict_check' WHEN 'MACHINERY' THEN 'conflict_flagged'
          WHEN 'HOUSEHOLD' THEN 'active' ELSE 'inactive' END AS status FROM {customer}""",
    "matters": """SELECT o_orderkey AS id, o_custkey AS client_id, 'Matter ' || CAST(o_orderkey AS VARCHAR(20)) AS matter_name,
        CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN '' ELSE 'M-' || CAST(o_orderkey AS VARCHAR(20)) END AS short_name,
        CASE WHEN o_orderkey % 3 = 0 THEN 'divorce' WHEN o_orderkey % 3 = 1 THEN 'child_custody' ELSE 'estate_planning' END AS matter_type,
        CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'intake' ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'archived' ELSE 'closed' END END AS status,
        o_orderpriority = '5-LOW' AS is_pro_bono, CAST(o_totalprice AS DECIMAL(12, 2)) AS retainer_amount, CAST(0.4 AS DECIMAL(5, 4)) AS refresh_trigger_pct,
        CASE WHEN o_orderkey % 4 = 0 THEN CAST(90 AS DECIMAL(10, 2)) END AS card_attorney, CASE WHEN o_orderkey % 4 = 0 THEN CAST(60 AS DECIMAL(10, 2)) END AS card_paralegal,
        CAST(o_orderdate AS DATE) AS created_at FROM {orders}""",
    "matter_staff": """SELECT o_orderkey AS matter_id, o_orderkey % 50 AS staff_id, CASE WHEN o_orderkey % 3 = 0 THEN 'originating' WHEN o_orderkey % 3 = 1 THEN 'billing_reviewer' ELSE 'assigned' END AS role,
        CASE WHEN o_orderkey % 3 = 0 THEN CAST(20 + o_custkey % 100 AS DECIMAL(5, 2)) END AS split_pct FROM {orders}""",
    "billing_splits": """SELECT o_custkey AS matter_id, o_orderkey AS client_id, CAST(5 + o_orderkey % 20 AS DECIMAL(5, 2)) AS split_pct FROM {orders}""",
    "opposing_parties": """SELECT s_suppkey AS id, s_suppkey * 10 AS matter_id, CASE WHEN s_suppkey % 40 = 39 THEN 'Customer' || CAST(s_suppkey AS VARCHAR(20)) ELSE s_name END AS full_name FROM {supplier}""",
    "matter_rate_overrides": """SELECT o_orderkey AS matter_id, o_orderkey % 100 AS staff_id, CAST(o_custkey % 3 * 55 AS DECIMAL(10, 2)) AS rate FROM {orders} WHERE o_orderkey % 6 = 0""",
    "billing_cycles": """SELECT o_orderkey AS id, o_custkey AS matter_id, CAST(o_orderdate AS DATE) AS period_start, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 - 1 AS INT) AS period_end,
        CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS status FROM {orders}""",
    "billing_entries": """SELECT l_orderkey AS matter_id, l_suppkey AS staff_id, l_partkey AS part, CAST(l_linenumber AS BIGINT) AS line, CAST(l_shipdate AS DATE) AS entry_date,
        CASE WHEN l_partkey % 2 = 0 THEN l_orderkey END AS billing_cycle_id,
        CASE l_linenumber % 3 WHEN 1 THEN 'time' WHEN 2 THEN 'expense' ELSE 'flat_fee' END AS entry_type,
        CASE WHEN l_linenumber % 3 = 1 THEN CAST(l_quantity AS DECIMAL(6, 2)) END AS hours,
        CASE WHEN l_linenumber % 3 = 1 THEN CAST(100 + (l_suppkey % 10) * 25 AS DECIMAL(10, 2)) END AS rate,
        CASE WHEN l_linenumber % 3 <> 1 THEN CAST(l_extendedprice AS DECIMAL(12, 2)) END AS amount,
        l_linestatus = 'F' AS billed, l_returnflag <> 'R' AS billable FROM {lineitem}""",
    "retainers": """SELECT o_orderkey AS id, o_orderkey AS matter_id, 'deposit' AS transaction_type, CAST(o_totalprice AS DECIMAL(12, 2)) AS amount, CAST(o_orderdate AS DATE) AS transaction_date FROM {orders}""",
    "trust_ledger": """SELECT event_id AS id, user_id AS matter_id, CASE event_type WHEN 'click' THEN 'withdrawal' WHEN 'error' THEN 'refund' ELSE 'deposit' END AS transaction_type,
        CAST(value AS DECIMAL(12, 2)) AS amount, CAST(ts AS DATE) AS transaction_date FROM {events} WHERE event_type <> 'view'""",
    "fee_agreements": """SELECT o_orderkey AS id, o_custkey AS matter_id, CASE o_orderkey % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'sent_to_client' WHEN 2 THEN 'executed' ELSE 'voided' END AS status, CAST(o_orderdate AS DATE) AS created_at FROM {orders}""",
    "matter_events": """SELECT event_id AS id, user_id AS matter_id, event_id % 20 AS created_by_staff_id, CASE event_type WHEN 'click' THEN 'hearing' WHEN 'view' THEN 'deadline' WHEN 'purchase' THEN 'mediation' WHEN 'signup' THEN 'appointment' ELSE 'other' END AS event_type,
        CAST(ts AS DATE) AS event_date FROM {events}""",
    "discovery_requests": """SELECT o_orderkey AS id, o_custkey AS matter_id, CAST(o_orderdate AS DATE) AS propounded_date,
        CASE o_orderkey % 4 WHEN 0 THEN 'interrogatories' WHEN 1 THEN 'production' WHEN 2 THEN 'disclosures' ELSE 'admissions' END AS request_type FROM {orders}""",
    "discovery_request_items": """SELECT l_orderkey AS discovery_request_id, l_orderkey AS matter_id, CAST(l_linenumber AS BIGINT) AS request_number, l_partkey AS part, l_suppkey AS supplier,
        CASE WHEN l_returnflag = 'R' THEN 'objected' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'finalized' WHEN l_returnflag = 'A' THEN 'pending_review' ELSE 'pending_client' END AS status,
        l_linestatus = 'O' AS client_response_needed, CASE WHEN l_partkey % 3 = 0 THEN '  ' WHEN l_partkey % 3 = 1 THEN 'answer' END AS response FROM {lineitem}""",
    "discovery_responses": """SELECT o_orderkey AS id, o_orderkey AS request_id, o_orderstatus = 'F' AS is_final FROM {orders}""",
    "matter_children": """SELECT p_partkey AS id, p_partkey % 100 AS matter_id, p_name AS name, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 'Female' ELSE 'MALE' END AS sex, CAST(CAST('2000-01-01' AS DATE) + p_size * 100 AS DATE) AS date_of_birth FROM {part}""",
    "opposing_counsel": """SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'TX' ELSE 'OK' END AS bar_state, CAST(24000000 + s_suppkey AS VARCHAR(20)) AS bar_number, lower(replace(s_name, '#', '.')) || '@firm.example' AS email FROM {supplier}""",
    "matter_opposing_counsel": """SELECT l_orderkey AS matter_id, l_suppkey AS counsel_id, CASE l_linenumber % 3 WHEN 0 THEN 'lead' WHEN 1 THEN 'co_counsel' ELSE 'local_counsel' END AS role FROM {lineitem}""",
    "matter_pleadings": """SELECT o_orderkey AS id, o_custkey AS matter_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS filed_date, o_orderpriority = '1-URGENT' AS is_supplement,
        CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey - 1 END AS amends_pleading_id FROM {orders}""",
    "matter_claims": """SELECT l_orderkey AS pleading_id, l_orderkey % 1000 AS matter_id, l_partkey AS part, CASE l_linenumber % 4 WHEN 0 THEN 'claim' WHEN 1 THEN 'defense' WHEN 2 THEN 'affirmative_defense' ELSE 'counterclaim' END AS kind, CAST(l_linenumber AS BIGINT) AS line FROM {lineitem}""",
    "user_roles": """SELECT 'uid-' || CAST(s_suppkey AS VARCHAR(20)) AS uid, CASE WHEN s_suppkey % 3 = 0 THEN 'attorney' WHEN s_suppkey % 3 = 1 THEN 'paralegal' ELSE 'admin' END AS role, s_suppkey AS staff_id, CAST(NULL AS BIGINT) AS client_id,
        lower(replace(s_name, '#', '-')) || '@firm.example' AS auth_email FROM {supplier}
        UNION ALL SELECT CASE WHEN c_custkey % 5 <> 0 THEN 'cid-' || CAST(c_custkey AS VARCHAR(20)) END, 'client', CASE WHEN c_custkey % 50 = 7 THEN c_custkey END, CASE WHEN c_custkey % 50 <> 9 THEN c_custkey END,
        lower(replace(c_name, '#', '.')) || '@mail.example' FROM {customer}""",
    "audit_log": """SELECT event_id AS id, event_type AS action, CASE WHEN user_id % 2 = 0 THEN 'matter' ELSE 'billing_entry' END AS entity_type, user_id AS entity_id, 'uid-' || CAST(user_id % 30 AS VARCHAR(20)) AS uid, CAST(ts AS DATE) AS created_at, props AS after_json FROM {events}""",
    "raw_text": "SELECT doc_id, text FROM {documents}",
}
#: What is written to compare engines: money as double, dates as text.
MONEY = {"default_billing_rate", "retainer_amount", "refresh_trigger_pct", "card_attorney", "card_paralegal", "split_pct", "rate", "amount", "hours"}
#: Integers that may be null are written as doubles too: data frames differ in how they hold them.
NULLABLE = {"amends_pleading_id", "counsel_match", "response_days", "k"}
DATES = {"created_at", "period_start", "period_end", "entry_date", "transaction_date", "event_date", "propounded_date", "date_of_birth", "filed_date"}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = TABLES[name]
    return spark.sql(text, **{t: source(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))})


def sql(body: str) -> str:
    """body with the domain tables that it names put before it as CTEs, for DuckDB."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", body)]
    ctes = ",\n".join(f"{t} AS ({re.sub(r'\{(\w+)\}', r'\1', TABLES[t])})" for t in used)
    recursive, rest = ("RECURSIVE ", body[len("WITH RECURSIVE "):]) if body.startswith("WITH RECURSIVE ") else ("", body[len("WITH "):] if body.startswith("WITH ") else None)
    return f"WITH {recursive}{ctes}{',' if rest else ''}\n{rest or body}" if used else body
