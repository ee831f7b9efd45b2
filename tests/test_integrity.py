"""Rules on batches and deletes along references, on small rows of their own."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from lexframe.operators import integrity, writes

SPLITS = "matter_id long, client_id long, split_pct decimal(5,2)"


def broken(found):
    return sorted(map(tuple, found.select("rule", "key").collect()))


def ids(spark, *some):
    return spark.createDataFrame([(i,) for i in some], "id long")


def test_splits(spark):
    known = {"matters": ids(spark, 1, 2), "clients": ids(spark, 1, 2, 3)}
    held = spark.createDataFrame([(1, 1, D("60")), (2, 1, D("60"))], SPLITS)
    judge = lambda rows, table=held: broken(integrity.violations("billing_splits", spark.createDataFrame(rows, SPLITS), table, known))
    assert judge([(1, 2, D("40"))]) == []
    assert judge([(1, 2, D("41"))]) == [("splits_within_100", "1/2")]
    assert judge([(1, 2, D("30")), (1, 3, D("30"))]) == [("splits_within_100", "1/2"), ("splits_within_100", "1/3")]  # only together
    assert judge([(1, 1, D("1"))]) == [("unique_matter_id_client_id", "1/1")]
    assert judge([(1, 2, D("1")), (1, 2, D("1"))]) == [("unique_matter_id_client_id", "1/2")] * 2
    assert judge([(9, 9, D("-1"))]) == [("client_id_refers_to_clients", "9/9"), ("matter_id_refers_to_matters", "9/9"), ("split_is_a_percentage", "9/9")]
    assert judge([(None, 1, None)]) == [("matter_id_required", "-/1"), ("split_pct_required", "-/1")]
    assert judge([(1, 1, D("100"))], None) == []
    assert judge([]) == []
    with pytest.raises(ValueError, match="clients"):
        integrity.violations("billing_splits", held, held, {"matters": known["matters"]})


def test_value_rules(spark):
    known = {t: ids(spark, 1) for t in ("matters", "staff", "billing_cycles", "clients", "offices")}
    entries = spark.createDataFrame(
        [(1, 1, "time", None, D("1"), None), (2, 1, "expense", None, None, None), (3, 1, "flat_fee", None, None, D("-1")), (4, 7, "gift", None, None, None), (5, 1, "time", D("1"), None, D("1"))],
        "id long, matter_id long, entry_type string, hours decimal(6,2), rate decimal(10,2), amount decimal(12,2)",
    )
    assert broken(integrity.violations("billing_entries", entries, None, known)) == [
        ("amount_not_negative", "3"), ("billing_entries.entry_type", "4"), ("expense_requires_amount", "2"), ("matter_id_refers_to_matters", "4"), ("time_requires_hours", "1"),
    ]
    roles = spark.createDataFrame([("a", "client", 1, 1, "x"), ("a", "admin", 1, None, "y"), (None, "admin", 1, None, "z"), (None, "admin", 1, None, "w")], "uid string, role string, staff_id long, client_id long, auth_email string")
    assert broken(integrity.violations("user_roles", roles, None, known)) == [("role_link", "x"), ("unique_uid", "x"), ("unique_uid", "y")]  # nulls are no double
    pleadings = spark.createDataFrame([(2, 1, 1), (3, 1, 2), (4, 1, 9)], "id long, matter_id long, amends_pleading_id long")
    held = spark.createDataFrame([(1, 1, None)], pleadings.schema)
    assert broken(integrity.violations("matter_pleadings", pleadings, held, known)) == [("amends_pleading_id_refers_to_matter_pleadings", "4")]  # the batch's own rows count
    assert broken(integrity.violations("audit_log", spark.createDataFrame([(1, 1)], "entity_id long, id long"), None, {})) == []


def test_refused_batches_leave_nothing(spark, tmp_path):
    path, known = str(tmp_path / "splits"), {"matters": ids(spark, 1), "clients": ids(spark, 1, 2)}
    one = lambda client, pct: spark.createDataFrame([(1, client, D(pct))], SPLITS)
    writes.append(path, "billing_splits", one(1, "80"), parents=known)
    before = sorted(str(x) for x in tmp_path.rglob("*.parquet"))
    for bad in (one(1, "1"), one(2, "30"), one(9, "1"), one(2, "-1")):
        with pytest.raises(writes.Refused):
            writes.append(path, "billing_splits", bad, parents=known)
    assert sorted(str(x) for x in tmp_path.rglob("*.parquet")) == before
    writes.append(path, "billing_splits", one(2, "20"), parents=known)
    assert writes.read(spark, path).count() == 2


def graph(spark):
    row = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    return {
        "clients": ids(spark, 1, 2),
        "matters": row("id long, client_id long", (1, 1), (2, 1), (3, 1), (4, 2)),
        "matter_events": row("id long, matter_id long", (10, 1), (11, 2), (12, None)),
        "discovery_requests": row("id long, matter_id long", (20, 1), (21, 2)),
        "discovery_request_items": row("discovery_request_id long, request_number long, matter_id long", (20, 1, 1), (21, 1, 2), (21, 2, 1)),
        "discovery_responses": row("id long, request_id long", (30, 20), (31, 21)),
        "billing_entries": row("id long, matter_id long, billing_cycle_id long", (40, 2, None), (41, None, None)),
        "opposing_parties": row("id long, matter_id long", (70, 1), (71, 3)),
        "matter_pleadings": row("id long, matter_id long, amends_pleading_id long, opposing_party_id long", (8, 1, None, 70), (9, 3, 8, 70), (10, 3, 9, 71)),
        "matter_claims": row("pleading_id long, matter_id long, opposing_party_id long", (8, 1, None), (9, 1, None), (9, 3, 70), (10, 3, 71)),
    }


def test_delete_follows_references(spark):
    tables = graph(spark)
    done = integrity.delete(tables, "matters", ids(spark, 1, 2, 99))
    assert [r.id for r in done.refused.collect()] == [2]  # an entry stands against it
    assert {tuple(r) for r in done.effects.collect()} == {
        ("matters", "2", "refused"), ("matters", "1", "deleted"), ("matter_events", "10", "deleted"), ("discovery_requests", "20", "deleted"), ("discovery_request_items", "20/1", "deleted"),
        ("discovery_request_items", "21/2", "deleted"), ("discovery_responses", "30", "deleted"), ("opposing_parties", "70", "deleted"), ("matter_pleadings", "8", "deleted"), ("matter_pleadings", "9", "set null"),
        ("matter_claims", "8", "deleted"), ("matter_claims", "9", "deleted"), ("matter_claims", "9", "set null"),
    }
    left = {n: {tuple(r) for r in df.collect()} for n, df in done.tables.items()}
    assert left["matters"] == {(2, 1), (3, 1), (4, 2)} and left["matter_events"] == {(11, 2), (12, None)} and left["billing_entries"] == {(40, 2, None), (41, None, None)}
    assert left["matter_pleadings"] == {(9, 3, None, None), (10, 3, 9, 71)} and left["matter_claims"] == {(9, 3, None), (10, 3, 71)}
    assert left["discovery_request_items"] == {(21, 1, 2)} and left["discovery_responses"] == {(31, 21)}
    for r in integrity.REFERENCES:  # nothing refers to what is gone
        if r.child in left and r.parent in left and r.column in tables[r.child].columns:
            assert done.tables[r.child].filter(F.col(r.column).isNotNull()).join(done.tables[r.parent].select(F.col("id").alias(r.column)), r.column, "left_anti").count() == 0
    assert {n: df.columns for n, df in done.tables.items()} == {n: df.columns for n, df in tables.items()}
    assert writes.delete(tables, "matters", ids(spark, 1))["matters"].count() == 3


def test_delete_refused(spark):
    tables = graph(spark)
    assert [r.id for r in integrity.delete(tables, "clients", ids(spark, 1, 2)).refused.orderBy("id").collect()] == [1, 2]  # matters refer to them
    nothing = integrity.delete(tables, "matters", ids(spark, 99))
    assert nothing.effects.count() == 0 and nothing.tables["matters"].count() == 4
    assert integrity.delete({n: df.limit(0) for n, df in tables.items()}, "matters", ids(spark, 1)).effects.count() == 0


def test_a_row_that_goes_too_does_not_stand_against(spark, monkeypatch):
    """A child that refuses by one reference and goes along by another; and a table whose rows hang on each other."""
    row = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    monkeypatch.setattr(integrity, "REFERENCES", integrity._references("b.a a cascade\nc.b b restrict\nc.a a cascade\nd.d d cascade"))
    tables = {"a": ids(spark, 1, 2, 3), "b": row("id long, a long", (10, 1), (11, 2), (12, 3)), "c": row("id long, b long, a long", (20, 10, 1), (21, 11, 3))}
    done = integrity.delete(tables, "a", ids(spark, 1, 2, 3))
    assert [r.id for r in done.refused.collect()] == [2]  # row 21 goes with 3, not with 2
    assert {tuple(r) for r in done.tables["c"].collect()} == set() and {tuple(r) for r in done.tables["b"].collect()} == {(11, 2)}
    chain = {"d": row("id long, d long", *((k, k - 1 if k % 10 else None) for k in range(30)))}
    left = integrity.delete(chain, "d", ids(spark, 3, 10, 29)).tables["d"]
    assert sorted(r.id for r in left.collect()) == [0, 1, 2, *range(20, 29)]
