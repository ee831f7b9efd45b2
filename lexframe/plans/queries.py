"""The registered queries: each applies an operator to whole tables, beside SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalar
from ..operators import conflicts, finance, lookups, quality, relations, security, surface
from ..sources import adapter
from ..sources.shared import fresh_path
from . import ingest, lookup_sql

Tables = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CLIENT = security.Principal("client", client_id=12)


def shown(df: DataFrame) -> DataFrame:
    """Money and nullable integers as double and dates as text, so that engines can be compared."""
    double = lambda name, kind: kind.startswith("decimal") or name in adapter.NULLABLE and kind != "string"
    cast = {name: df[name].cast("double" if double(name, kind) else "string") for name, kind in df.dtypes if double(name, kind) or kind == "date"}
    return df.withColumns(cast) if cast else df


def query(sql: str | None = None) -> Callable:
    """Register a function of the domain tables under its name, with SQL over the same tables."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: shown(f(lambda name: adapter.load(spark, sf_dir, name)))
        if sql:
            ORACLE_SQL[f.__name__] = adapter.sql(sql.strip())
        return f

    return add


def _tables(sf_dir: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, name: adapter.load(spark, sf_dir, name)


_sessions: dict[tuple[str, str], SparkSession] = {}


def _practice(spark: SparkSession, sf_dir: str) -> SparkSession:
    """The session of these tables: it is set up once, and any number of texts run in it."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _sessions:
        _sessions[at] = surface.opened(spark, _tables(sf_dir), ledger="retainers")
    return _sessions[at]


def text_query(name: str, text: str, sql: str) -> None:
    """Register what a SQL text gives in a session that has the practice's tables, functions and views."""
    QUERIES[name] = lambda spark, sf_dir: shown(_practice(spark, sf_dir).sql(text))
    ORACLE_SQL[name] = adapter.sql(sql)


def _lookup(name: str, lookup: lookups.Lookup) -> None:
    QUERIES[name] = lambda spark, sf_dir: shown(lookups.run(adapter.load(spark, sf_dir, lookup.table), lookup))
    ORACLE_SQL[name] = adapter.sql(lookup_sql.text(name, lookup.columns, adapter.MONEY | adapter.NULLABLE, adapter.DATES))


for _name, _spec in lookups.LOOKUPS.items():
    _lookup(_name, _spec)

BALANCE = """t AS (SELECT matter_id, sum(CASE WHEN transaction_type = 'deposit' THEN amount ELSE -amount END) AS trust FROM retainers GROUP BY matter_id),
e AS (SELECT matter_id, sum(coalesce(amount, hours * rate, 0)) AS unbilled FROM {entries} WHERE NOT billed AND billable GROUP BY matter_id),
balance AS (SELECT m.id AS matter_id, coalesce(trust, 0) AS trust, coalesce(unbilled, 0) AS unbilled, coalesce(trust, 0) - coalesce(unbilled, 0) AS balance,
  CASE WHEN coalesce(trust, 0) - coalesce(unbilled, 0) < 0 THEN 'red' WHEN coalesce(trust, 0) - coalesce(unbilled, 0) < retainer_amount * refresh_trigger_pct THEN 'yellow' ELSE 'green' END AS status
  FROM matters m LEFT JOIN t ON t.matter_id = m.id LEFT JOIN e ON e.matter_id = m.id)"""
PLAIN = BALANCE.replace("{entries}", "billing_entries")
ZEROED = """zeroed AS (SELECT b.* REPLACE (CASE WHEN is_pro_bono AND entry_type = 'time' THEN 0 ELSE rate END AS rate, CASE WHEN is_pro_bono AND entry_type = 'time' THEN 0 ELSE amount END AS amount)
  FROM billing_entries b LEFT JOIN (SELECT id, is_pro_bono FROM matters) m ON m.id = b.matter_id)"""
SHOWN = "round(trust, 2)::DOUBLE AS trust, round(unbilled, 2)::DOUBLE AS unbilled, round(balance, 2)::DOUBLE AS balance"


# money


@query(f"WITH {ZEROED}, {BALANCE.replace('{entries}', 'zeroed')} SELECT matter_id, {SHOWN}, status FROM balance")
def matter_balance(t: Tables) -> DataFrame:
    return finance.matter_balance(t("matters"), t("retainers"), t("billing_entries"), zero_pro_bono=True)


text_query("udtf_get_matter_balance", "SELECT * FROM get_matter_balance(42)", f"WITH {PLAIN} SELECT matter_id, {SHOWN}, status FROM balance WHERE matter_id = 42")


text_query("join_matter_balance_lateral", "SELECT b.* FROM matters m, LATERAL get_matter_balance(m.id) b", f"WITH {PLAIN} SELECT matter_id, {SHOWN}, status FROM balance")


@query("SELECT matter_id, sum(CASE WHEN transaction_type = 'deposit' THEN amount ELSE -amount END)::DOUBLE AS trust FROM trust_ledger GROUP BY matter_id")
def agg_trust_balance(t: Tables) -> DataFrame:
    return finance.trust_balance(t("trust_ledger"))


@query("SELECT matter_id, round(sum(coalesce(amount, hours * rate, 0)), 2)::DOUBLE AS unbilled FROM billing_entries WHERE NOT billed AND billable GROUP BY matter_id")
def agg_unbilled_total(t: Tables) -> DataFrame:
    return finance.unbilled_total(t("billing_entries")).withColumn("unbilled", scalar.round2(F.col("unbilled")))


@query("SELECT matter_id, sum(coalesce(amount, 0))::DOUBLE AS unbilled FROM billing_entries WHERE NOT billed GROUP BY matter_id")
def agg_ui_unbilled(t: Tables) -> DataFrame:
    return finance.ui_unbilled(t("billing_entries"))


@query("SELECT matter_id, part, line, staff_id, round(coalesce(amount, hours * rate), 2)::DOUBLE AS computed FROM billing_entries")
def fn_compute_amount(t: Tables) -> DataFrame:
    amount = scalar.compute_amount(F.col("amount"), F.col("hours"), F.col("rate"))
    return t("billing_entries").select("matter_id", "part", "line", "staff_id", scalar.round2(amount).alias("computed"))


@query("SELECT id, round(retainer_amount * refresh_trigger_pct, 2)::DOUBLE AS floor_amount FROM matters")
def fn_round2(t: Tables) -> DataFrame:
    return t("matters").select("id", scalar.round2(F.col("retainer_amount") * F.col("refresh_trigger_pct")).alias("floor_amount"))


@query(f"WITH {PLAIN} SELECT status, count(*) AS n FROM balance GROUP BY status")
def fn_balance_status(t: Tables) -> DataFrame:
    return finance.matter_balance(t("matters"), t("retainers"), t("billing_entries")).groupBy("status").agg(F.count("*").alias("n"))


text_query("view_matter_summary", "SELECT * FROM v_matter_summary", f"WITH {PLAIN} SELECT m.id, m.client_id, matter_name, m.status, lower(trim(first_name || ' ' || last_name)) AS client_name, email AS client_email, {SHOWN}, b.status AS balance_status FROM matters m JOIN clients c ON c.id = m.client_id JOIN balance b ON b.matter_id = m.id")


text_query("view_unbilled_entries", "SELECT * FROM v_unbilled_entries", """SELECT b.matter_id, matter_name, client_id, b.staff_id, lower(trim(first_name || ' ' || last_name)) AS staff_name, role AS staff_role, entry_type, part, line, round(coalesce(amount, hours * rate), 2)::DOUBLE AS computed_amount
FROM billing_entries b JOIN matters m ON m.id = b.matter_id JOIN staff s ON s.id = b.staff_id WHERE NOT billed AND billable""")


PROGRESS = """SELECT i.matter_id, request_type, count(*) FILTER (i.status = 'pending_client') AS pending_client, count(*) FILTER (i.status = 'pending_review') AS pending_review,
 count(*) FILTER (i.status = 'finalized') AS finalized, count(*) FILTER (i.status = 'objected') AS objected, count(*) AS total, matter_name
FROM discovery_request_items i JOIN discovery_requests d ON d.id = i.discovery_request_id JOIN matters m ON m.id = i.matter_id GROUP BY i.matter_id, request_type, matter_name"""


text_query("view_discovery_progress", "SELECT * FROM v_discovery_progress", PROGRESS)


@query("SELECT request_type, count(*) FILTER (i.status = 'pending_client') AS pending_client, count(*) AS total FROM discovery_request_items i JOIN discovery_requests d ON d.id = i.discovery_request_id GROUP BY request_type")
def agg_filtered_counts(t: Tables) -> DataFrame:
    d = t("discovery_requests").select(F.col("id").alias("discovery_request_id"), "request_type")
    return t("discovery_request_items").join(d, "discovery_request_id").groupBy("request_type").agg(F.count_if(F.col("status") == "pending_client").alias("pending_client"), F.count("*").alias("total"))


RATE = """SELECT p.matter_id, p.staff_id, (CASE WHEN is_pro_bono THEN 0 ELSE coalesce(o.rate, CASE s.role WHEN 'attorney' THEN card_attorney WHEN 'paralegal' THEN card_paralegal END, default_billing_rate) END)::DOUBLE AS rate
FROM (SELECT DISTINCT matter_id, staff_id FROM billing_entries{where}) p JOIN matters m ON m.id = p.matter_id JOIN staff s ON s.id = p.staff_id LEFT JOIN matter_rate_overrides o ON o.matter_id = p.matter_id AND o.staff_id = p.staff_id"""


def _rates(t: Tables, pairs: DataFrame) -> DataFrame:
    return finance.resolve_rates(pairs.select("matter_id", "staff_id").distinct(), t("matters"), t("staff"), t("matter_rate_overrides"))


@query(RATE.replace("{where}", ""))
def join_rate_chain(t: Tables) -> DataFrame:
    return _rates(t, t("billing_entries"))


@query(RATE.replace("{where}", " WHERE entry_type = 'time'"))
def fn_resolve_rate(t: Tables) -> DataFrame:
    return _rates(t, t("billing_entries").filter("entry_type = 'time'"))


text_query("udf_resolve_billing_rate", "SELECT matter_id, staff_id, resolve_billing_rate(matter_id, staff_id) AS rate FROM (SELECT DISTINCT matter_id, staff_id FROM billing_entries WHERE matter_id = 42)", RATE.replace("{where}", " WHERE matter_id = 42"))


@query("SELECT m.id, s.role, (CASE s.role WHEN 'attorney' THEN card_attorney WHEN 'paralegal' THEN card_paralegal END)::DOUBLE AS card FROM matters m JOIN matter_staff a ON a.matter_id = m.id JOIN staff s ON s.id = a.staff_id")
def fn_rate_card_get(t: Tables) -> DataFrame:
    card = F.element_at(F.create_map(F.lit("attorney"), F.col("card_attorney"), F.lit("paralegal"), F.col("card_paralegal")), F.col("role"))
    a = t("matter_staff").select(F.col("matter_id").alias("id"), "staff_id")
    return t("matters").join(a, "id").join(t("staff").select(F.col("id").alias("staff_id"), "role"), "staff_id").select("id", "role", card.alias("card"))


@query("SELECT id, matter_id, CAST(transaction_date AS VARCHAR) AS transaction_date, sum(CASE WHEN transaction_type = 'deposit' THEN amount ELSE -amount END) OVER (PARTITION BY matter_id ORDER BY transaction_date, id ROWS UNBOUNDED PRECEDING)::DOUBLE AS running FROM trust_ledger")
def window_running_trust(t: Tables) -> DataFrame:
    return finance.running_trust(t("trust_ledger")).select("id", "matter_id", "transaction_date", "running")


@query("SELECT entity_id, entity_type, id, action FROM audit_log QUALIFY row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY id DESC) = 1")
def window_latest_version(t: Tables) -> DataFrame:
    return finance.latest_version(t("audit_log").select("id", "entity_type", "entity_id", "action"), ["entity_type", "entity_id"], ["id"])


@query("""WITH u AS (SELECT matter_id, sum(coalesce(amount, hours * rate, 0)) AS unbilled FROM billing_entries WHERE NOT billed AND billable GROUP BY matter_id),
r AS (SELECT u.matter_id, s.client_id, split_pct, floor(unbilled * split_pct)::BIGINT AS cents, unbilled * split_pct - floor(unbilled * split_pct) AS rest FROM u JOIN billing_splits s ON s.matter_id = u.matter_id),
w AS (SELECT *, round(sum(rest) OVER (PARTITION BY matter_id)) AS spare, row_number() OVER (PARTITION BY matter_id ORDER BY rest DESC, client_id) AS k FROM r)
SELECT matter_id, client_id, split_pct::DOUBLE AS split_pct, ((cents + CASE WHEN k <= spare THEN 1 ELSE 0 END) / 100)::DECIMAL(14, 2)::DOUBLE AS share FROM w""")
def ext_bill_production(t: Tables) -> DataFrame:
    return finance.produce_bill(t("billing_entries"), t("billing_splits"))


@query("""SELECT b.matter_id, part, line, staff_id, entry_type, CAST(entry_date AS VARCHAR) AS entry_date, (CASE WHEN is_pro_bono AND entry_type = 'time' THEN 0 ELSE rate END)::DOUBLE AS rate, (CASE WHEN is_pro_bono AND entry_type = 'time' THEN 0 ELSE amount END)::DOUBLE AS amount
FROM billing_entries b LEFT JOIN matters m ON m.id = b.matter_id""")
def dq_pro_bono_zero(t: Tables) -> DataFrame:
    return finance.pro_bono_zero(t("billing_entries"), t("matters")).select("matter_id", "part", "line", "staff_id", "entry_type", "entry_date", "rate", "amount")


@query("""SELECT matter_id, part, line, staff_id, coalesce(b.billed OR c.id IS NOT NULL, b.billed) AS billed FROM billing_entries b LEFT JOIN (SELECT id FROM billing_cycles WHERE status = 'open') c ON c.id = b.billing_cycle_id""")
def pipe_close_cycle(t: Tables) -> DataFrame:
    cycles = t("billing_cycles")
    entries, _, _ = finance.close_cycle(t("billing_entries"), cycles, cycles.select("id"), 3)
    return entries.select("matter_id", "part", "line", "staff_id", "billed")


# joins and screens


@query("SELECT m.id, client_id, matter_name, email, c.status AS client_status FROM matters m JOIN clients c ON c.id = m.client_id")
def join_matter_client(t: Tables) -> DataFrame:
    return relations.matter_client(t("matters"), t("clients"))


@query("SELECT m.id, client_id, matter_name, email, c.status AS client_status FROM matters m JOIN clients c ON c.id = m.client_id WHERE m.status = 'intake'")
def join_ingest_matter_client(t: Tables) -> DataFrame:
    return relations.matter_client(t("matters").filter("status = 'intake'"), t("clients"))


@query("SELECT role, entry_type, count(*) AS n, sum(hours)::DOUBLE AS hours FROM billing_entries b JOIN matters m ON m.id = b.matter_id JOIN staff s ON s.id = b.staff_id GROUP BY role, entry_type")
def join_entries_matter_staff(t: Tables) -> DataFrame:
    return relations.entries_matter_staff(t("billing_entries"), t("matters"), t("staff"))


@query("SELECT i.matter_id, matter_name, count(*) AS n FROM discovery_request_items i JOIN matters m ON m.id = i.matter_id GROUP BY i.matter_id, matter_name")
def join_items_matter(t: Tables) -> DataFrame:
    m = t("matters").select(F.col("id").alias("matter_id"), "matter_name")
    return t("discovery_request_items").groupBy("matter_id").agg(F.count("*").alias("n")).join(m, "matter_id")


@query("SELECT discovery_request_id, d.matter_id, request_type, coalesce(nullif(short_name, ''), matter_name, 'Unknown Matter') AS matter, request_number, part, supplier, i.status FROM discovery_requests d LEFT JOIN matters m ON m.id = d.matter_id JOIN discovery_request_items i ON i.discovery_request_id = d.id")
def join_doc_matter_items(t: Tables) -> DataFrame:
    return relations.document_items(t("discovery_requests"), t("matters"), t("discovery_request_items"))


@query("SELECT matter_id, counsel_id, role, name, bar_state, bar_number FROM matter_opposing_counsel l JOIN opposing_counsel c ON c.id = l.counsel_id")
def join_links_counsel(t: Tables) -> DataFrame:
    return relations.linked_counsel(t("matter_opposing_counsel"), t("opposing_counsel"))


PROPOSED = "SELECT s_suppkey AS n, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'TX' END AS bar_state, CAST(24000000 + s_suppkey AS VARCHAR) AS bar_number FROM supplier"


@query(f"SELECT p.n, p.bar_state, p.bar_number, CASE WHEN p.bar_state <> '' THEN c.id END::DOUBLE AS counsel_match FROM ({PROPOSED}) p LEFT JOIN opposing_counsel c ON c.bar_state = p.bar_state AND c.bar_number = p.bar_number")
def join_counsel_match(t: Tables) -> DataFrame:
    n = F.col("id")
    proposed = t("opposing_counsel").select(n.alias("n"), F.when(n % 5 == 0, "").otherwise("TX").alias("bar_state"), (n + 24000000).cast("string").alias("bar_number"))
    return relations.match_counsel(proposed, t("opposing_counsel")).withColumnRenamed("counsel_id", "counsel_match")


@query("SELECT DISTINCT matter_id, counsel_id FROM matter_opposing_counsel a WHERE NOT EXISTS (SELECT 1 FROM matter_opposing_counsel b WHERE b.role = 'lead' AND b.matter_id = a.matter_id AND b.counsel_id = a.counsel_id)")
def join_anti_unlinked(t: Tables) -> DataFrame:
    links = t("matter_opposing_counsel")
    return relations.unlinked(links.select("matter_id", "counsel_id").distinct(), links.filter("role = 'lead'").select("matter_id", "counsel_id"))


@query("SELECT id, matter_id, is_supplement FROM matter_pleadings p WHERE NOT EXISTS (SELECT 1 FROM matter_pleadings q WHERE q.amends_pleading_id = p.id)")
def join_anti_superseded(t: Tables) -> DataFrame:
    return relations.superseded_anti(t("matter_pleadings")).select("id", "matter_id", "is_supplement")


@query("SELECT id, matter_id, is_supplement FROM matter_pleadings p WHERE NOT is_supplement AND NOT EXISTS (SELECT 1 FROM matter_pleadings q WHERE q.amends_pleading_id = p.id)")
def pipe_live_pleadings(t: Tables) -> DataFrame:
    return relations.live_pleadings(t("matter_pleadings")).select("id", "matter_id", "is_supplement")


@query("WITH RECURSIVE chain AS (SELECT id, id AS root, 0 AS depth FROM matter_pleadings WHERE amends_pleading_id IS NULL UNION ALL SELECT p.id, c.root, c.depth + 1 FROM matter_pleadings p JOIN chain c ON p.amends_pleading_id = c.id) SELECT id, root, depth::BIGINT AS depth FROM chain")
def pipe_amend_chain(t: Tables) -> DataFrame:
    return relations.amend_chains(t("matter_pleadings"))


@query("SELECT b.staff_id, coalesce(first_name || ' ' || last_name, 'Staff #' || b.staff_id) AS display, count(*) AS n FROM billing_entries b LEFT JOIN (SELECT * FROM staff WHERE role <> 'admin') s ON s.id = b.staff_id GROUP BY b.staff_id, 2")
def proj_staff_display(t: Tables) -> DataFrame:
    return relations.staff_display(t("billing_entries").select("staff_id"), t("staff").filter("role <> 'admin'")).groupBy("staff_id", "display").agg(F.count("*").alias("n"))


@query("SELECT m.id, email FROM matters m LEFT JOIN clients c ON c.id = m.client_id")
def join_name_lookup_ui(t: Tables) -> DataFrame:
    return t("matters").select("id", "client_id").join(t("clients").select(F.col("id").alias("client_id"), "email"), "client_id", "left").select("id", "email")


@query("SELECT id, status, matter_name FROM matters WHERE status IN ('closed', 'archived') AND (contains(lower(coalesce(short_name, '')), 'm-1') OR contains(lower(matter_name), 'm-1'))")
def ui_matters_filter(t: Tables) -> DataFrame:
    return relations.filter_matters(t("matters"), "closed", "M-1").select("id", "status", "matter_name")


@query("SELECT id, coalesce(short_name, matter_name) AS display, coalesce(nullif(short_name, ''), matter_name) AS display_or FROM matters")
def proj_display_name(t: Tables) -> DataFrame:
    names = F.col("short_name"), F.col("matter_name")
    return t("matters").select("id", scalar.display_name(*names).alias("display"), scalar.display_name_or(*names).alias("display_or"))


@query("SELECT doc_id, CASE WHEN length(text) > 120 THEN left(text, 120) || '...' ELSE text END AS preview FROM raw_text")
def proj_source_preview(t: Tables) -> DataFrame:
    return t("raw_text").select("doc_id", scalar.preview(F.col("text")).alias("preview"))


@query("SELECT doc_id, sha256(CASE WHEN length(text) > 10000 THEN left(text, 10000) || chr(10) || '[...]' || chr(10) || right(text, 4000) ELSE text END) AS digest FROM raw_text")
def proj_raw_head_tail(t: Tables) -> DataFrame:
    return t("raw_text").select("doc_id", F.sha2(scalar.head_tail(F.col("text")), 256).alias("digest"))


@query("SELECT id, EXISTS (SELECT 1 FROM audit_log a WHERE a.entity_type = 'matter' AND a.entity_id = m.id) AS found FROM matters m")
def agg_exists(t: Tables) -> DataFrame:
    logged = t("audit_log").filter("entity_type = 'matter'").select(F.col("entity_id").alias("id"))
    return relations.exist(t("matters").select("id"), logged, "id")


@query("SELECT count(*) FILTER (status NOT IN ('closed', 'archived')) AS open, count(*) AS total, count(*) FILTER (is_pro_bono) AS pro_bono FROM matters")
def agg_dashboard(t: Tables) -> DataFrame:
    return relations.dashboard(t("matters"))


@query("SELECT count(*) FILTER (uid IS NOT NULL AND uid <> '') AS linked, count(*) FILTER (uid IS NULL OR uid = '') AS unlinked FROM staff")
def agg_staff_linked(t: Tables) -> DataFrame:
    return relations.staff_linked(t("staff"))


@query("SELECT id, row_number() OVER (ORDER BY CASE WHEN status IN ('closed', 'archived') THEN 1 ELSE 0 END, lower(coalesce(short_name, matter_name)), id) AS place FROM matters")
def sort_matters_ui(t: Tables) -> DataFrame:
    rows = t("matters").select("id", "status", "short_name", "matter_name")
    return relations.placed(rows, relations.matters_order()).select("id", "place")


@query("SELECT id, matter_name, CAST(created_at AS VARCHAR) AS created_at FROM matters ORDER BY matters.created_at DESC, id LIMIT 8")
def topk_recent_matters(t: Tables) -> DataFrame:
    return relations.recent_matters(t("matters")).select("id", "matter_name", "created_at")


# conflicts

SUBJECTS = "s AS (SELECT 'client' AS source, id AS entity_id, lower(trim(first_name || ' ' || last_name)) AS name FROM clients UNION ALL SELECT 'opposing_party', id, lower(full_name) FROM opposing_parties)"
GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
SEARCHES = [("customer 000000012",), ("Supplier#000000039",), ("customer39",), ("Customer 000000120",), ("###",)]
NAMES = "n AS (SELECT unnest([" + ", ".join(f"'{s[0]}'" for s in SEARCHES) + "]) AS search)"
TRIGRAM = f"""WITH {SUBJECTS}, {NAMES},
a AS (SELECT search, {GRAMS.format(x='search')} AS q FROM n), b AS (SELECT source, entity_id, name, {GRAMS.format(x='name')} AS g FROM s),
p AS (SELECT search, source, entity_id, name AS matched_name, len(list_intersect(q, g)) AS k, len(q) AS nq, len(g) AS ng FROM a, b),
hits AS (SELECT search, source, entity_id, matched_name, CAST(CAST(k::DOUBLE / (nq + ng - k) AS FLOAT) AS DOUBLE) AS sim FROM p WHERE nq + ng - k > 0 AND CAST(CAST(k::DOUBLE / (nq + ng - k) AS FLOAT) AS DOUBLE) > 0.3)"""


def _searches(t: Tables) -> DataFrame:
    return t("clients").sparkSession.createDataFrame(SEARCHES, "search string")


def _subjects(t: Tables) -> DataFrame:
    return conflicts.subjects(t("clients"), t("opposing_parties"))


def _hits(t: Tables) -> DataFrame:
    return conflicts.search_trigram(_searches(t), _subjects(t))


@query(TRIGRAM + " SELECT search, source, entity_id, matched_name, sim FROM hits")
def join_conflict_trigram(t: Tables) -> DataFrame:
    return _hits(t)


text_query("udtf_search_conflicts", "SELECT * FROM search_conflicts('customer 000000012', 0.3)", TRIGRAM + " SELECT source, entity_id, matched_name, sim FROM hits WHERE search = 'customer 000000012'")


text_query("udtf_search_conflicts_multi", f"SELECT source, entity_id, matched_name, max_sim AS sim, matched_input AS search FROM search_conflicts_multi(array({', '.join(repr(x) for x, in SEARCHES)}))", TRIGRAM + " SELECT source, entity_id, matched_name, max(sim) AS sim, max_by(search, {'sim': sim, 'search': search}) AS search FROM hits GROUP BY source, entity_id, matched_name")


@query(TRIGRAM + " SELECT source, entity_id, matched_name, max(sim) AS sim FROM hits GROUP BY source, entity_id, matched_name")
def agg_max_sim(t: Tables) -> DataFrame:
    return conflicts.best_of_many(_hits(t)).drop("search")


@query(TRIGRAM + " SELECT entity_id, source, max_by(search, {'sim': sim, 'search': search}) AS search FROM hits GROUP BY source, entity_id")
def agg_argmax_input(t: Tables) -> DataFrame:
    return _hits(t).groupBy("source", "entity_id").agg(F.max_by("search", F.struct("sim", "search")).alias("search"))


@query(TRIGRAM + " SELECT search, count(*) AS n, count(*) > 0 AS has_conflict FROM hits GROUP BY search")
def agg_hit_count(t: Tables) -> DataFrame:
    return _hits(t).groupBy("search").agg(F.count("*").alias("n"), (F.count("*") > 0).alias("has_conflict"))


@query(TRIGRAM + " SELECT search, entity_id, source, row_number() OVER (PARTITION BY search ORDER BY sim DESC, source, entity_id) AS place FROM hits")
def sort_similarity(t: Tables) -> DataFrame:
    return relations.placed(_hits(t).select("search", "entity_id", "source", "sim"), [F.desc("sim"), F.col("source"), F.col("entity_id")], "search").drop("sim")


@query(f"WITH {SUBJECTS} SELECT source, entity_id, name FROM s")
def union_conflicts(t: Tables) -> DataFrame:
    return _subjects(t)


@query(TRIGRAM + " SELECT search, source, count(*) AS n FROM hits GROUP BY search, source")
def union_multi_names(t: Tables) -> DataFrame:
    return _hits(t).groupBy("search", "source").agg(F.count("*").alias("n"))


SUBSTRING = f"WITH {SUBJECTS}, {NAMES} SELECT search, source, entity_id, name FROM (SELECT lower(search) AS search FROM n WHERE trim(search) <> '') q, s WHERE (contains(name, search) OR contains(search, name))"


@query(SUBSTRING)
def join_conflict_substring(t: Tables) -> DataFrame:
    return conflicts.search_substring(_searches(t), _subjects(t))


@query(SUBSTRING.replace("SELECT search, source, entity_id, name FROM (", "SELECT source, entity_id, 'name' AS matched_field FROM ("))
def pipe_conflict_check(t: Tables) -> DataFrame:
    return conflicts.redacted(conflicts.search_substring(_searches(t), _subjects(t)))


@query(SUBSTRING.replace("SELECT search, source, entity_id, name FROM (", "SELECT source, entity_id, 'name' AS matched_field FROM (") + " AND search = 'customer39'")
def proj_redact_hit(t: Tables) -> DataFrame:
    return conflicts.redacted(conflicts.search_substring(_searches(t).filter("search = 'customer39'"), _subjects(t)))


@query(f"WITH {SUBJECTS} SELECT source, entity_id, contains(name, '000012') OR contains('000012', name) AS hit FROM s")
def fn_substring_match(t: Tables) -> DataFrame:
    return _subjects(t).select("source", "entity_id", scalar.substring_match(F.col("name"), F.lit("000012")).alias("hit"))


@query(f"WITH {SUBJECTS}, b AS (SELECT source, entity_id, {GRAMS.format(x='name')} AS g, {GRAMS.format(x="'customer 000000077'")} AS q FROM s) SELECT source, entity_id, CAST(CAST(len(list_intersect(q, g))::DOUBLE / (len(q) + len(g) - len(list_intersect(q, g))) AS FLOAT) AS DOUBLE) AS sim FROM b")
def fn_similarity(t: Tables) -> DataFrame:
    return _subjects(t).select("source", "entity_id", scalar.similarity(F.col("name"), F.lit("customer 000000077")).alias("sim"))


@query("SELECT id, unnest([lower(trim(first_name || ' ' || last_name)), 'a', email]) AS search FROM clients")
def concat_names(t: Tables) -> DataFrame:
    """What is searched for when a client comes in: the name, and the other names that came with it."""
    others = F.concat(F.lit(" a , ,"), "email", F.lit(" "))
    names = conflicts.names_to_search(scalar.name_to_text(F.col("first_name"), F.col("last_name")), others)
    return t("clients").select("id", F.explode(names).alias("search"))


@query("SELECT id, list_filter(list_transform(string_split(first_name || ', ' || last_name || ',, x ', ','), lambda x: trim(x)), lambda x: x <> '')[2] AS second, len(list_filter(list_transform(string_split(first_name || ', ' || last_name || ',, x ', ','), lambda x: trim(x)), lambda x: x <> ''))::BIGINT AS n FROM clients")
def split_names_csv(t: Tables) -> DataFrame:
    parts = scalar.split_names(F.concat("first_name", F.lit(", "), "last_name", F.lit(",, x ")))
    return t("clients").select("id", F.element_at(parts, 2).alias("second"), F.size(parts).cast("long").alias("n"))


# scalar functions


@query("SELECT id, lower(trim(coalesce(first_name, '') || ' ' || coalesce(last_name, ''))) AS name FROM clients")
def fn_name_to_text(t: Tables) -> DataFrame:
    return t("clients").select("id", scalar.name_to_text(F.col("first_name"), F.col("last_name")).alias("name"))


text_query("udf_name_to_text", "SELECT id, name_to_text(named_struct('first_name', first_name, 'last_name', last_name)) AS name FROM staff", "SELECT id, lower(trim(first_name || ' ' || last_name)) AS name FROM staff")


@query("SELECT id, first_name || ' ' || last_name AS name FROM staff")
def fn_full_name_str(t: Tables) -> DataFrame:
    return t("staff").select("id", scalar.full_name(F.lit(None).cast("string"), F.col("first_name"), F.lit(""), F.col("last_name")).alias("name"))


@query("""WITH d AS (SELECT id, created_at + (CASE WHEN id % 50 > 0 THEN id % 50 ELSE 30 END)::INT AS due FROM matters)
SELECT id, CAST(due + CASE isodow(due) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS VARCHAR) AS due FROM d""")
def fn_due_date(t: Tables) -> DataFrame:
    return t("matters").select("id", scalar.due_date(F.col("created_at"), (F.col("id") % 50).cast("int")).alias("due"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN CAST(created_at AS VARCHAR) END AS parsed FROM matters")
def fn_parse_date(t: Tables) -> DataFrame:
    text = F.when(F.col("id") % 3 == 0, "not a date").when(F.col("id") % 3 == 1, F.col("created_at").cast("string")).otherwise("2024-13-40")
    return t("matters").select("id", scalar.parse_date(text).alias("parsed"))


@query("SELECT id, CASE WHEN lower(sex) IN ('male', 'female', 'other') THEN lower(sex) END AS sex FROM matter_children")
def fn_parse_sex(t: Tables) -> DataFrame:
    return t("matter_children").select("id", scalar.parse_sex(F.col("sex")).alias("sex"))


@query("SELECT id, after_json AS stripped FROM audit_log")
def fn_strip_fences(t: Tables) -> DataFrame:
    fenced = F.when(F.col("id") % 2 == 0, F.concat(F.lit("```json\n"), "after_json", F.lit("\n```"))).otherwise(F.col("after_json"))
    return t("audit_log").select("id", scalar.strip_fences(fenced).alias("stripped"))


@query("SELECT id, CASE WHEN id % 5 <> 0 THEN CAST(json_extract_string(after_json, '$.k') AS DOUBLE) END AS k, id % 5 = 0 AS failed FROM audit_log")
def fn_json_parse(t: Tables) -> DataFrame:
    value = ingest.parse_json(F.when(F.col("id") % 5 == 0, "{oops").otherwise(F.col("after_json")), "k bigint")
    return t("audit_log").select("id", value["k"].alias("k"), value.isNull().alias("failed"))


@query("SELECT id, json_extract_string(after_json, '$.k') AS value FROM audit_log")
def fn_json_get_text(t: Tables) -> DataFrame:
    return t("audit_log").select("id", F.get_json_object("after_json", "$.k").alias("value"))


@query("SELECT id, 'Supplier ' || split_part(slug, '-', 2) AS title FROM staff")
def fn_slug_to_title(t: Tables) -> DataFrame:
    return t("staff").select("id", scalar.slug_to_title(F.col("slug")).alias("title"))


@query("SELECT id, replace(status, '_', ' ') AS every, CASE WHEN instr(status, '_') > 0 THEN left(status, instr(status, '_') - 1) || ' ' || substring(status, instr(status, '_') + 1) ELSE status END AS once FROM clients")
def fn_underscore_to_space(t: Tables) -> DataFrame:
    return t("clients").select("id", scalar.underscores(F.col("status")).alias("every"), scalar.first_underscore(F.col("status")).alias("once"))


@query("SELECT m.id, upper(first_name) || ' - ' || replace(matter_type, '_', ' ') || ' - 2026' AS short FROM matters m JOIN clients c ON c.id = m.client_id")
def fn_short_name(t: Tables) -> DataFrame:
    c = t("clients").select(F.col("id").alias("client_id"), "first_name")
    return t("matters").join(c, "client_id").select("id", scalar.short_name(F.col("first_name"), F.col("matter_type"), 2026).alias("short"))


@query("SELECT d.id, replace(matter_name || ' - ' || request_type || '.docx', ' ', '_') AS filename FROM discovery_requests d JOIN matters m ON m.id = d.matter_id")
def fn_export_filename(t: Tables) -> DataFrame:
    m = t("matters").select(F.col("id").alias("matter_id"), "matter_name")
    return t("discovery_requests").join(m, "matter_id").select("id", scalar.export_filename(F.col("matter_name"), F.col("request_type")).alias("filename"))


@query("SELECT id, 'matters/' || matter_id || '/pleadings/' || id || '.pdf' AS path FROM matter_pleadings")
def fn_stored_path(t: Tables) -> DataFrame:
    return t("matter_pleadings").select("id", scalar.stored_path(F.col("matter_id"), "pleadings", F.col("id")).alias("path"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM raw_text)
SELECT doc_id, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^\\s*\\d+\\.\\s+') THEN 'numbered' WHEN regexp_matches(line, '^\\s*[-*]\\s+') THEN 'bullet' ELSE 'paragraph' END AS block, count(*) AS n FROM l GROUP BY ALL""")
def fn_md_block(t: Tables) -> DataFrame:
    lines = t("raw_text").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id", scalar.md_block(F.col("line")).alias("block")).agg(F.count("*").alias("n"))


@query(r"SELECT id, regexp_replace(regexp_replace(regexp_replace(x, '\*\*\*(.+?)\*\*\*', '\1', 'g'), '\*\*(.+?)\*\*', '\1', 'g'), '\*(.+?)\*', '\1', 'g') AS plain FROM (SELECT id, '***' || first_name || '*** and **' || last_name || '** or *' || status || '*' AS x FROM clients) q")
def fn_md_inline(t: Tables) -> DataFrame:
    text = F.concat(F.lit("***"), "first_name", F.lit("*** and **"), "last_name", F.lit("** or *"), "status", F.lit("*"))
    return t("clients").select("id", scalar.md_plain(text).alias("plain"))


@query("SELECT discovery_request_id, request_number, part, supplier, CASE WHEN NOT client_response_needed AND status = 'pending_client' AND trim(coalesce(response, '')) = '' THEN 'pending_attorney' ELSE status END AS effective FROM discovery_request_items")
def fn_effective_status(t: Tables) -> DataFrame:
    status = scalar.effective_status(F.col("status"), F.col("client_response_needed"), F.col("response"), F.lit(0))
    return t("discovery_request_items").select("discovery_request_id", "request_number", "part", "supplier", status.alias("effective"))


@query("SELECT matter_id, part, line, staff_id, CASE WHEN hours <> 0 THEN 'high' ELSE 'low' END AS confidence FROM billing_entries")
def fn_confidence(t: Tables) -> DataFrame:
    return t("billing_entries").select("matter_id", "part", "line", "staff_id", scalar.confidence(F.col("hours"), F.lit("call")).alias("confidence"))


@query("SELECT id, status IN ('closed', 'archived') AS closed FROM matters")
def fn_is_closed(t: Tables) -> DataFrame:
    return t("matters").select("id", scalar.is_closed(F.col("status")).alias("closed"))


@query("SELECT id, CASE WHEN event_type IN ('interrogatories', 'production', 'disclosures', 'admissions') THEN event_type ELSE 'interrogatories' END AS coerced FROM matter_events")
def fn_enum_coerce(t: Tables) -> DataFrame:
    return t("matter_events").select("id", scalar.coerce_request_type(F.col("event_type")).alias("coerced"))


@query("SELECT matter_id, part, line, staff_id, (hours * 1000)::BIGINT % 250 = 0 AS whole FROM billing_entries WHERE hours IS NOT NULL")
def fn_hours_increment(t: Tables) -> DataFrame:
    return t("billing_entries").filter("hours is not null").select("matter_id", "part", "line", "staff_id", scalar.on_increment(F.col("hours"), 0.25).alias("whole"))


@query("SELECT id, CASE WHEN coalesce(short_name, '') <> '' AND short_name IS DISTINCT FROM matter_name THEN 1 ELSE 0 END::BIGINT AS n, CASE WHEN coalesce(short_name, '') <> '' THEN matter_name END AS proposed FROM matters")
def fn_field_diff(t: Tables) -> DataFrame:
    diff = scalar.field_diff({"name": (F.col("short_name"), F.col("matter_name"))}, needs_current=True)
    return t("matters").select("id", F.size(diff).cast("long").alias("n"), F.try_element_at(diff, F.lit("name"))["proposed"].alias("proposed"))


# integrity rules


@query("""SELECT matter_id, part, line, staff_id, unnest(list_filter([CASE WHEN entry_type = 'time' AND billed AND rate > 300 THEN 'rate_cap' END, CASE WHEN hours < 0 THEN 'hours' END, CASE WHEN entry_type <> 'time' AND amount < 1000 THEN 'amount_floor' END], lambda x: x IS NOT NULL)) AS rule FROM billing_entries""")
def dq_ranges(t: Tables) -> DataFrame:
    rules = {"rate_cap": ~((F.col("entry_type") == "time") & F.col("billed") & (F.col("rate") > 300)), "hours": F.col("hours") >= 0, "amount_floor": ~((F.col("entry_type") != "time") & (F.col("amount") < 1000))}
    return quality.failing(t("billing_entries"), rules, ["matter_id", "part", "line", "staff_id"])


@query("""WITH b AS (SELECT * REPLACE (CASE WHEN part % 9 = 0 THEN NULL ELSE hours END AS hours, CASE WHEN part % 11 = 0 THEN NULL ELSE rate END AS rate, CASE WHEN part % 7 = 0 THEN NULL ELSE amount END AS amount) FROM billing_entries)
SELECT matter_id, part, line, staff_id, unnest(list_filter([CASE WHEN entry_type = 'time' AND hours IS NULL THEN 'time_requires_hours' END, CASE WHEN entry_type = 'expense' AND amount IS NULL THEN 'expense_requires_amount' END,
CASE WHEN entry_type = 'flat_fee' AND amount IS NULL THEN 'flat_fee_requires_amount' END, CASE WHEN entry_type = 'time' AND rate IS NULL AND amount IS NULL THEN 'time_requires_rate_or_amount' END], lambda x: x IS NOT NULL)) AS rule FROM b""")
def dq_entry_type_fields(t: Tables) -> DataFrame:
    holes = {c: F.when(F.col("part") % n != 0, F.col(c)) for c, n in (("hours", 9), ("rate", 11), ("amount", 7))}
    return quality.failing(t("billing_entries").withColumns(holes), quality.entry_type_rules(), ["matter_id", "part", "line", "staff_id"])


@query("SELECT id, 'period_order' AS rule FROM billing_cycles WHERE period_end < period_start")
def dq_period_order(t: Tables) -> DataFrame:
    return quality.failing(t("billing_cycles"), quality.period_rules(), ["id"])


@query("SELECT auth_email, 'role_link' AS rule FROM user_roles WHERE NOT (CASE WHEN role = 'client' THEN client_id IS NOT NULL AND staff_id IS NULL ELSE staff_id IS NOT NULL AND client_id IS NULL END)")
def dq_role_link(t: Tables) -> DataFrame:
    return quality.failing(t("user_roles"), quality.role_rules(), ["auth_email"])


@query("SELECT matter_id, sum(split_pct)::DOUBLE AS total FROM billing_splits GROUP BY matter_id HAVING sum(split_pct) > 100")
def dq_splits_sum(t: Tables) -> DataFrame:
    return quality.over_split(t("billing_splits"))


@query("SELECT matter_id, coalesce(sum(split_pct), 0)::DOUBLE AS total FROM billing_splits GROUP BY matter_id")
def agg_splits_total(t: Tables) -> DataFrame:
    return quality.split_totals(t("billing_splits"))


@query("SELECT matter_id, sum(coalesce(split_pct, 0)) FILTER (role = 'originating')::DOUBLE AS total, count(*) FILTER (role = 'originating') AS n FROM matter_staff GROUP BY matter_id")
def agg_originating_total(t: Tables) -> DataFrame:
    return quality.originating(t("matter_staff"))


@query("SELECT matter_id, sum(coalesce(split_pct, 0))::DOUBLE AS total, count(*) AS n FROM matter_staff WHERE role = 'originating' GROUP BY matter_id HAVING sum(split_pct) > 100")
def dq_originating_sum(t: Tables) -> DataFrame:
    return quality.originating(t("matter_staff")).filter("total > 100")


@query("SELECT id, 'matters.status' AS rule FROM (SELECT id, CASE WHEN id % 100 = 3 THEN 'lost' ELSE status END AS status FROM matters) m WHERE status NOT IN ('intake', 'conflict_review', 'active', 'closed', 'archived')")
def dq_enum_domains(t: Tables) -> DataFrame:
    rows = t("matters").withColumn("status", F.when(F.col("id") % 100 == 3, "lost").otherwise(F.col("status")))
    return quality.outside_domain(rows, "matters", "status", ["id"])


@query("SELECT discovery_request_id, request_number, count(*) AS n FROM discovery_request_items GROUP BY discovery_request_id, request_number HAVING count(*) > 1")
def dq_unique(t: Tables) -> DataFrame:
    return quality.repeated(t("discovery_request_items"), ["discovery_request_id", "request_number"])


@query("SELECT id, client_id FROM matters WHERE client_id NOT IN (SELECT id FROM clients WHERE status <> 'inactive')")
def dq_foreign_keys(t: Tables) -> DataFrame:
    return quality.orphans(t("matters").select("id", "client_id"), "client_id", t("clients").filter("status <> 'inactive'"))


@query("SELECT id, email FROM clients WHERE status = 'prospect' AND email IN (SELECT email FROM clients WHERE id % 3 = 0)")
def dq_email_conflict(t: Tables) -> DataFrame:
    return quality.already_taken(t("clients").filter("status = 'prospect'").select("id", "email"), t("clients").filter("id % 3 = 0"), "email")


@query("SELECT id FROM trust_ledger WHERE id % 97 = 0 OR (id % 89 = 0 AND amount <> 1)")
def dq_immutable_ledger(t: Tables) -> DataFrame:
    before = t("trust_ledger")
    after = before.filter("id % 97 <> 0").withColumn("amount", F.when(F.col("id") % 89 == 0, F.lit(1).cast("decimal(12,2)")).otherwise(F.col("amount")))
    return quality.changed_log(before, after).select("id")


@query("SELECT id FROM audit_log WHERE id % 97 = 0")
def dq_immutable_audit(t: Tables) -> DataFrame:
    return quality.changed_log(t("audit_log"), t("audit_log").filter("id % 97 <> 0")).select("id")


# row-level security

OWN = "matter_id IN (SELECT id FROM matters WHERE client_id = 12)"


def _secured(t: Tables, table: str) -> DataFrame:
    return security.secure(t(table), table, CLIENT, {"matters": t("matters"), "discovery_requests": t("discovery_requests")})


@query(f"SELECT id, matter_id, status FROM billing_cycles WHERE status = 'closed' AND {OWN}")
def rls_client_closed_cycles(t: Tables) -> DataFrame:
    return _secured(t, "billing_cycles").select("id", "matter_id", "status")


@query(f"SELECT matter_id, part, line, staff_id FROM billing_entries WHERE billed AND billable AND {OWN}")
def rls_client_billed_entries(t: Tables) -> DataFrame:
    return _secured(t, "billing_entries").select("matter_id", "part", "line", "staff_id")


@query(f"SELECT matter_id, part, line, staff_id FROM billing_entries WHERE billed AND billable AND {OWN}")
def join_semi_rls(t: Tables) -> DataFrame:
    return _secured(t, "billing_entries").select("matter_id", "part", "line", "staff_id")


@query(f"SELECT id, matter_id, status FROM fee_agreements WHERE {OWN}")
def rls_client_agreements(t: Tables) -> DataFrame:
    return _secured(t, "fee_agreements").select("id", "matter_id", "status")


@query(f"SELECT id, matter_id, event_type FROM matter_events WHERE {OWN}")
def rls_client_events(t: Tables) -> DataFrame:
    return _secured(t, "matter_events").select("id", "matter_id", "event_type")


@query(f"SELECT id, matter_id, request_type FROM discovery_requests WHERE {OWN}")
def rls_client_requests(t: Tables) -> DataFrame:
    return _secured(t, "discovery_requests").select("id", "matter_id", "request_type")


TWO_HOPS = f"SELECT id, request_id, is_final FROM discovery_responses WHERE request_id IN (SELECT id FROM discovery_requests WHERE {OWN})"


@query(TWO_HOPS)
def join_semi_rls_2hop(t: Tables) -> DataFrame:
    return _secured(t, "discovery_responses")


@query(TWO_HOPS + " AND NOT is_final")
def rls_client_responses(t: Tables) -> DataFrame:
    return security.writable_responses(t("discovery_responses"), CLIENT, {"matters": t("matters"), "discovery_requests": t("discovery_requests")})


#: Principals under whom the same SQL is run, and what their role lets them see of clients and matters.
FIVE = {"admin": security.Principal("admin", staff_id=2), "paralegal": security.Principal("paralegal", staff_id=1), "client 12": CLIENT, "client 13": security.Principal("client", client_id=13), "nobody": security.Principal("none")}


def _under_five(name: str, text: str, sql: str) -> None:
    """Register what one SQL text gives under each principal. sql: the same, where {staff} is whether the principal is of
    the staff and {client} its client."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = None
        for who, principal in FIVE.items():
            rows = security.session(spark, _tables(sf_dir), principal).sql(text).withColumn("who", F.lit(who))
            rows = surface.given(rows, spark, fresh_path(spark, "seen"))  # each in a session of its own
            found = rows if found is None else found.unionByName(rows)
        return shown(found)

    of = lambda p: sql.replace("{staff}", str(p.role in security.STAFF)).replace("{client}", str(p.client_id or "NULL"))
    QUERIES[name] = run
    ORACLE_SQL[name] = adapter.sql(" UNION ALL ".join(f"SELECT q.*, '{who}' AS who FROM ({of(p)}) q" for who, p in FIVE.items()))


_under_five("rls_client_self", "SELECT id, email, status FROM clients", "SELECT id, email, status FROM clients WHERE {staff} OR id = {client}")
SEEN = BALANCE.replace("FROM retainers", "FROM trust_ledger WHERE {staff}").replace("FROM {entries} WHERE", "FROM billing_entries WHERE {staff} AND")
_under_five(  # clients see neither the ledger nor what is not billed, so a balance is 0 for them
    "rls_client_matters",
    "SELECT m.id, m.matter_name, b.trust, b.balance, b.status FROM matters m, LATERAL get_matter_balance(m.id) b WHERE m.status = 'active'",
    f"WITH {SEEN} SELECT m.id, m.matter_name, round(b.trust, 2)::DOUBLE AS trust, round(b.balance, 2)::DOUBLE AS balance, b.status FROM matters m JOIN balance b ON b.matter_id = m.id WHERE m.status = 'active' AND ({{staff}} OR client_id = {{client}})",
)


@query("""SELECT 'hidden' AS reason, id FROM discovery_responses WHERE is_final OR request_id NOT IN (SELECT id FROM discovery_requests WHERE matter_id IN (SELECT id FROM matters WHERE client_id = 12))
UNION ALL SELECT 'changed', id FROM discovery_responses WHERE NOT is_final AND id % 2 = 0 AND request_id IN (SELECT id FROM discovery_requests WHERE matter_id IN (SELECT id FROM matters WHERE client_id = 12))
UNION ALL SELECT 'written', id FROM discovery_responses WHERE NOT is_final AND id % 2 <> 0 AND request_id IN (SELECT id FROM discovery_requests WHERE matter_id IN (SELECT id FROM matters WHERE client_id = 12))""")
def rls_write_checks(t: Tables) -> DataFrame:
    """A client changes every response, and makes every second one final: which rows are refused, and why."""
    rows, tables = t("discovery_responses"), {"matters": t("matters"), "discovery_requests": t("discovery_requests")}
    patch = rows.select("id", (F.col("id") % 2 == 0).alias("is_final"))
    return security.judged("discovery_responses", rows, patch, CLIENT, tables)


def _role_gate(name: str, table: str, role: str, sql: str, **who: object) -> None:
    """A query of what a role sees of a table: how many rows, by whether it may write."""

    def run(t: Tables) -> DataFrame:
        principal = security.Principal(role, **who)
        seen = security.secure(t(table), table, principal, {"matters": t("matters")})
        return seen.agg(F.count("*").alias("n")).withColumn("may_write", F.lit(security.may_write(principal, table)))

    run.__name__ = name
    query(sql)(run)


_role_gate("rls_staff_all", "billing_entries", "paralegal", "SELECT count(*) AS n, true AS may_write FROM billing_entries")
_role_gate("rls_offices_staff", "offices", "paralegal", "SELECT count(*) AS n, false AS may_write FROM offices")
_role_gate("rls_matter_staff", "matter_staff", "attorney", "SELECT count(*) AS n, true AS may_write FROM matter_staff")
_role_gate("rls_rate_overrides", "matter_rate_overrides", "paralegal", "SELECT count(*) AS n, false AS may_write FROM matter_rate_overrides")
_role_gate("rls_trust", "trust_ledger", "client", "SELECT 0::BIGINT AS n, false AS may_write FROM trust_ledger LIMIT 1", client_id=12)
_role_gate("rls_user_roles", "user_roles", "attorney", "SELECT count(*) AS n, false AS may_write FROM user_roles WHERE uid = 'uid-3'", uid="uid-3")
_role_gate("rls_audit", "audit_log", "attorney", "SELECT 0::BIGINT AS n, false AS may_write FROM audit_log LIMIT 1")
