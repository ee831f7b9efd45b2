"""SQL functions and views, and sessions under a principal."""

import os
import re

import pytest
from pyspark.sql import functions as F

from lexframe.operators import security, surface
from lexframe.sources import adapter

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def load(spark, name):
    return adapter.load(spark, SF, name)


@pytest.fixture(scope="module")
def sql(spark):
    return surface.opened(spark, load).sql


def test_functions(sql):
    one = lambda text: sql(f"SELECT {text} AS x").first().x
    name = "CAST(named_struct('first_name', {}, 'last_name', {}) AS STRUCT<first_name: STRING, last_name: STRING>)"
    assert one(f"name_to_text({name.format("' Ann'", 'NULL')})") == "ann" and one("name_to_text(NULL)") is None
    assert one("similarity('Ann Lee', 'lee  ann')") == 1.0 and one("similarity('#', '#')") == 0.0 and one("similarity('a', NULL)") is None
    assert one("resolve_billing_rate(-1, -1)") is None
    assert sql("SELECT * FROM get_matter_balance(-1)").count() == 0
    assert sql("SELECT * FROM search_conflicts('###')").count() == 0 and sql("SELECT * FROM search_conflicts_multi(array())").count() == 0
    many = sql("SELECT * FROM search_conflicts_multi(array('customer 000000012', 'customer 000000013'), 0.9)").collect()
    assert sorted((r.matched_input, r.entity_id) for r in many) == [("customer 000000012", 12), ("customer 000000013", 13)]


def test_a_balance_filters_the_scans(sql):
    """The function is inlined: the matter's id reaches the Parquet scans of all three tables, and no Python runs."""
    plan = sql("SELECT * FROM get_matter_balance(42)")._jdf.queryExecution().executedPlan().toString()
    assert all(re.search(rf"Filter .*\({c}#\d+L = 42\)", plan) for c in ("o_orderkey", "l_orderkey", "user_id")) and plan.count("[IsNotNull(") + plan.count("EqualTo(") >= 3
    assert "Python" not in plan


def test_lateral_equals_one_by_one(sql):
    every = {r.matter_id: tuple(r) for r in sql("SELECT b.* FROM matters m, LATERAL get_matter_balance(m.id) b WHERE m.id < 30").collect()}
    assert every and all(every[k] == tuple(sql(f"SELECT * FROM get_matter_balance({k})").first()) for k in list(every)[:3])


def test_rates_equal_the_chain(spark, sql):
    from lexframe.operators import finance

    pairs = load(spark, "billing_entries").select("matter_id", "staff_id").distinct()
    want = {tuple(r) for r in finance.resolve_rates(pairs, load(spark, "matters"), load(spark, "staff"), load(spark, "matter_rate_overrides")).collect()}
    got = {tuple(r) for r in sql("SELECT matter_id, staff_id, resolve_billing_rate(matter_id, staff_id) FROM (SELECT DISTINCT matter_id, staff_id FROM billing_entries)").collect()}
    assert want <= got


def test_sessions_keep_apart(spark):
    client = security.session(spark, load, security.Principal("client", client_id=12))
    count = lambda session, text: session.sql(f"SELECT count(*) AS n FROM {text}").first().n
    assert count(client, "clients") == 1 and count(client, "trust_ledger") == 0 and count(client, "staff") == 0
    own = {r.id for r in client.sql("SELECT id FROM matters").collect()}
    assert own == {r.id for r in load(spark, "matters").filter("client_id = 12").collect()} and own
    assert count(client, "billing_cycles WHERE matter_id NOT IN (SELECT id FROM matters)") == 0
    assert count(client, "conflict_subjects WHERE source = 'opposing_party'") == 0  # the views are bound too
    staff = security.session(spark, load, security.Principal("paralegal"))
    assert count(staff, "matters") > len(own) and count(staff, "audit_log") == 0 and count(client, "matters") == len(own)
    assert not spark.catalog.tableExists("conflict_subjects")  # nothing leaks into the session that it was made from


def test_write_policies(spark):
    matters = spark.createDataFrame([(1, 5), (2, 6)], "id long, client_id long")
    requests = spark.createDataFrame([(10, 1), (20, 2)], "id long, matter_id long")
    rows = spark.createDataFrame([(100, 10, False, "a"), (101, 10, True, "b"), (200, 20, False, "c")], "id long, request_id long, is_final boolean, text string")
    tables = {"matters": matters, "discovery_requests": requests}
    patch = spark.createDataFrame([(100, None, None, "x"), (101, None, None, "x"), (200, None, None, "x"), (999, None, None, "x")], rows.schema)
    client = security.Principal("client", client_id=5)
    after, refused = security.update("discovery_responses", rows, patch, client, tables)
    assert {tuple(r) for r in refused.collect()} == {(101, "hidden"), (200, "hidden"), (999, "hidden")}
    assert {(r.id, r.text) for r in after.collect()} == {(100, "x"), (101, "b"), (200, "c")}
    away = spark.createDataFrame([(100, 20, None, None)], rows.schema)  # into another client's request
    assert [tuple(r) for r in security.refused_updates("discovery_responses", rows, away, client, tables).collect()] == [(100, "changed")]
    final = patch.withColumn("is_final", F.lit(True))
    assert (100, "changed") in {tuple(r) for r in security.refused_updates("discovery_responses", rows, final, client, tables).collect()}
    assert security.refused_updates("discovery_responses", rows, patch.filter("id < 999"), security.Principal("attorney"), tables).count() == 0
    assert security.refused_updates("staff", rows, patch, security.Principal("attorney"), tables).count() == 4
    with pytest.raises(ValueError, match="matters"):
        security.secure(rows.withColumn("matter_id", F.col("id")), "fee_agreements", client, {})
