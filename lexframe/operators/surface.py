"""The functions and views of the practice as SQL: what `register` puts into a session, any SQL text there can use.

Functions are SQL themselves, so the optimizer sees through them: a balance for one matter filters the scans, one for
every matter (LATERAL) is a join. All of them read the session's own tables, secured or not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conflicts, finance

#: Subjects with the trigrams of their names, dealt to all tasks before they are split: a file may hold very many. A share
#: comes out of a generator below, so that the filter on it does not work it out again.
HELD = "(SELECT source, entity_id, name, trigrams(name) AS grams FROM (SELECT /*+ REPARTITION(source, entity_id) */ source, entity_id, name FROM conflict_subjects)) s"
#: Name and parameters, what it returns, body.
FUNCTIONS = {
    "name_to_text(name STRUCT<first_name: STRING, last_name: STRING>)": ("STRING", "CASE WHEN name IS NOT NULL THEN lower(trim(concat(coalesce(name.first_name, ''), ' ', coalesce(name.last_name, '')))) END"),
    "trigrams(text STRING)": (
        "ARRAY<STRING>",
        r"array_distinct(flatten(transform(filter(split(lower(text), '[^\\p{L}\\p{N}]+'), w -> w <> ''), w -> transform(sequence(1, length(w) + 1), i -> substring(concat('  ', w, ' '), i, 3)))))",
    ),
    "shared_part(a ARRAY<STRING>, b ARRAY<STRING>)": ("DOUBLE", "CASE WHEN size(a) + size(b) = 0 THEN 0D ELSE CAST(CAST(size(array_intersect(a, b)) / (size(a) + size(b) - size(array_intersect(a, b))) AS FLOAT) AS DOUBLE) END"),
    "similarity(a STRING, b STRING)": ("DOUBLE", "shared_part(trigrams(a), trigrams(b))"),
    "search_conflicts(search_name STRING, threshold DOUBLE DEFAULT 0.3)": (
        "TABLE (source STRING, entity_id BIGINT, matched_name STRING, sim DOUBLE)",
        f"""SELECT source, entity_id, name, sim FROM (SELECT s.source, s.entity_id, s.name, shared_part(s.grams, q.grams) AS part FROM {HELD} CROSS JOIN (SELECT trigrams(search_name) AS grams) q) LATERAL VIEW explode(array(part)) AS sim WHERE sim > threshold""",
    ),
    "search_conflicts_multi(names ARRAY<STRING>, threshold DOUBLE DEFAULT 0.3)": (
        "TABLE (source STRING, entity_id BIGINT, matched_name STRING, max_sim DOUBLE, matched_input STRING)",
        f"""SELECT source, entity_id, name, max(sim), max_by(search, struct(sim, search)) FROM (SELECT /*+ BROADCAST(q) */ s.source, s.entity_id, s.name, q.search, shared_part(s.grams, q.grams) AS part
        FROM {HELD} CROSS JOIN (SELECT search, trigrams(search) AS grams FROM (SELECT explode(names) AS search)) q) LATERAL VIEW explode(array(part)) AS sim WHERE sim > threshold GROUP BY source, entity_id, name""",
    ),
    "get_matter_balance(matter BIGINT)": (
        "TABLE (matter_id BIGINT, trust DOUBLE, unbilled DOUBLE, balance DOUBLE, status STRING)",
        "SELECT b.matter_id, b.trust, b.unbilled, b.balance, b.status FROM matter_balances b WHERE b.matter_id = matter",
    ),
    "resolve_billing_rate(matter BIGINT, person BIGINT)": (
        "DECIMAL(10, 2)",
        """CASE WHEN (SELECT max(m.is_pro_bono) FROM matters m WHERE m.id = matter) THEN 0 ELSE coalesce(
          (SELECT max(o.rate) FROM matter_rate_overrides o WHERE o.matter_id = matter AND o.staff_id = person),
          CASE (SELECT max(s.role) FROM staff s WHERE s.id = person) WHEN 'attorney' THEN (SELECT max(m.card_attorney) FROM matters m WHERE m.id = matter) WHEN 'paralegal' THEN (SELECT max(m.card_paralegal) FROM matters m WHERE m.id = matter) END,
          (SELECT max(s.default_billing_rate) FROM staff s WHERE s.id = person)) END""",
    ),
}
#: Tables that the functions and views read; what stands for the ledger of the balances is `ledger`.
TABLES = ("matters", "clients", "staff", "opposing_parties", "matter_rate_overrides", "billing_entries", "discovery_requests", "discovery_request_items")


def own_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of another, and names of its own."""
    new = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            new.conf.set(key, value)
    return new


def register(spark: SparkSession, load: Callable[[str], DataFrame], ledger: str = "trust_ledger", tables: tuple[str, ...] = TABLES) -> None:
    """Put the tables (load gives each by name, from this session), the views over them and the functions into the session."""
    t = {name: load(name) for name in dict.fromkeys((*tables, *TABLES, ledger))}
    for name, df in t.items():
        df.createOrReplaceTempView(name)
    conflicts.subjects(t["clients"], t["opposing_parties"]).createOrReplaceTempView("conflict_subjects")
    finance.matter_balance(t["matters"], t[ledger], t["billing_entries"]).createOrReplaceTempView("matter_balances")
    finance.matter_summary(t["matters"], t["clients"], t[ledger], t["billing_entries"]).createOrReplaceTempView("v_matter_summary")
    finance.unbilled_entries(t["billing_entries"], t["matters"], t["staff"]).createOrReplaceTempView("v_unbilled_entries")
    finance.discovery_progress(t["discovery_request_items"], t["discovery_requests"], t["matters"]).createOrReplaceTempView("v_discovery_progress")
    for head, (returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {returns} RETURN {body}")


def opened(spark: SparkSession, load: Callable[[SparkSession, str], DataFrame], **options: object) -> SparkSession:
    """A session of its own with everything registered; load gives a table by session and name."""
    new = own_session(spark)
    register(new, lambda name: load(new, name), **options)
    return new


def given(df: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """The rows of another session's DataFrame as a table of this one."""
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


