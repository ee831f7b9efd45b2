"""Operators on small rows of their own: the cases that the driver tables do not have."""

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from lexframe.functions import scalar
from lexframe.operators import conflicts, finance, quality, relations, security, writes
from lexframe.plans import ingest
from lexframe.sources import adapter, seeds
from lexframe.streaming import ledger as streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


MATTERS = "id long, client_id long, matter_name string, is_pro_bono boolean, retainer_amount decimal(12,2), refresh_trigger_pct decimal(5,4), card_attorney decimal(10,2), card_paralegal decimal(10,2)"


def matters(spark):
    return spark.createDataFrame(
        [
            (1, 1, "a", False, D("1000.00"), D("0.4000"), None, None),
            (2, 1, "b", True, D("1000.00"), D("0.4000"), D("80.00"), D("50.00")),
            (3, 2, "c", False, D("1000.00"), D("0.4000"), D("80.00"), D("50.00")),
        ],
        MATTERS,
    )


def test_balance_statuses(spark):
    ledger = spark.createDataFrame([(1, "deposit", D("400.00")), (3, "deposit", D("500.00")), (3, "withdrawal", D("50.00")), (3, "refund", D("51.00"))], "matter_id long, transaction_type string, amount decimal(12,2)")
    entries = spark.createDataFrame(
        [
            (2, D("1.00"), D("0.01"), None, False, True),
            (1, D("2.00"), D("50.00"), D("0.00"), False, True),  # an explicit zero stays zero
            (1, D("2.00"), D("50.00"), None, True, True),
            (1, D("2.00"), D("50.00"), None, False, False),
        ],
        "matter_id long, hours decimal(6,2), rate decimal(10,2), amount decimal(12,2), billed boolean, billable boolean",
    )
    got = {r.matter_id: (r.balance, r.status) for r in finance.matter_balance(matters(spark), ledger, entries).collect()}
    assert got == {1: (400.0, "green"), 2: (-0.01, "red"), 3: (399.0, "yellow")}
    assert finance.ui_unbilled(entries).filter("matter_id = 1").first().unbilled == D("0.00")
    empty = finance.matter_balance(matters(spark).limit(0), ledger, entries)
    assert empty.count() == 0


def test_running_balance(spark):
    rows = [(1, 1, "deposit", D("5.00"), date(2026, 1, 2)), (2, 1, "refund", D("1.00"), date(2026, 1, 2)), (3, 1, "deposit", D("2.00"), date(2026, 1, 1)), (4, None, "deposit", D("9.00"), None)]
    ledger = spark.createDataFrame(rows, "id long, matter_id long, transaction_type string, amount decimal(12,2), transaction_date date")
    assert {r.id: r.running for r in finance.running_trust(ledger).collect()} == {1: 7, 2: 6, 3: 2, 4: 9}
    assert finance.running_trust(ledger.limit(0)).count() == 0


def test_rates(spark):
    staff = spark.createDataFrame([(1, "attorney", D("300.00")), (2, "admin", None)], "id long, role string, default_billing_rate decimal(10,2)")
    overrides = spark.createDataFrame([(1, 1, D("0.00"))], "matter_id long, staff_id long, rate decimal(10,2)")
    pairs = spark.createDataFrame([(m, s) for m in (1, 2, 3, 9) for s in (1, 2)], "matter_id long, staff_id long")
    got = {(r.matter_id, r.staff_id): r.rate for r in finance.resolve_rates(pairs, matters(spark), staff, overrides).collect()}
    assert got == {(1, 1): 0, (1, 2): None, (2, 1): 0, (2, 2): 0, (3, 1): 80, (3, 2): None}
    assert finance.unknown_pairs(pairs, matters(spark), staff).count() == 2


def test_bill_shares_add_up(spark):
    entries = spark.createDataFrame([(1, None, None, D("100.00"), False, True)], "matter_id long, hours decimal(6,2), rate decimal(10,2), amount decimal(12,2), billed boolean, billable boolean")
    splits = spark.createDataFrame([(1, k, D("33.33")) for k in (1, 2)] + [(1, 3, D("33.34"))], "matter_id long, client_id long, split_pct decimal(5,2)")
    assert sum(r.share for r in finance.produce_bill(entries, splits).collect()) == D("100.00")


def test_due_dates(spark):
    for service, days in ((date(2026, 3, 19), None), (date(2026, 3, 20), 30), (date(2026, 3, 21), 0)):
        assert one(spark, scalar.due_date(F.lit(service), F.lit(days).cast("int"))) == date(2026, 4, 20)


def test_scalars(spark):
    assert one(spark, scalar.strip_fences(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(spark, scalar.parse_date(F.lit("2024-02-30"))) is None
    assert one(spark, scalar.parse_sex(F.lit("FEMALE"))) == "female"
    assert one(spark, scalar.slug_to_title(F.lit("work-product"))) == "Work Product"
    assert one(spark, scalar.md_plain(F.lit("***a*** **b** *c*"))) == "a b c"
    assert one(spark, scalar.full_name(*(F.lit(x) for x in ("Dr.", "", "Ann", "Lee", None)))) == "Dr. Ann Lee"
    assert one(spark, scalar.name_struct_to_text(F.lit(None).cast("struct<first_name:string,last_name:string>"))) is None
    assert one(spark, scalar.confidence(F.lit(0.0), F.lit("x"))) == "low"
    assert one(spark, scalar.page_text(F.array(F.lit("short"), F.lit("x" * 20), F.lit("y" * 30)))) == "x" * 20 + "\n\n" + "y" * 30
    assert one(spark, scalar.first_underscore(F.lit("a_b_c"))) == "a b_c"
    assert [one(spark, scalar.md_block(F.lit(x))) for x in ("", "1. a", "- b", "* c", "d")] == ["blank", "numbered", "bullet", "bullet", "paragraph"]
    assert one(spark, scalar.effective_status(F.lit("pending_client"), F.lit(False), F.lit("  "), F.lit(0))) == "pending_attorney"
    assert one(spark, scalar.effective_status(F.lit("pending_client"), F.lit(False), F.lit(None).cast("string"), F.lit(1))) == "pending_client"
    assert one(spark, scalar.on_increment(F.lit(0.3), 0.25)) is False


def test_similarity(spark):
    sim = lambda a, b: one(spark, scalar.similarity(F.lit(a), F.lit(b)))
    assert sim("Ann Lee", "lee  ann") == 1.0
    assert sim("###", "###") == 0.0
    assert 0 < sim("ann lee", "joann leeds") == sim("joann leeds", "ann lee") < 1


def test_conflicts(spark):
    clients = spark.createDataFrame([(1, "Ann", "Lee"), (2, "Joann", "Leeds"), (3, "Bo", "Tu")], "id long, first_name string, last_name string")
    parties = spark.createDataFrame([(7, ""), (8, "ANN LEE")], "id long, full_name string")
    names = spark.createDataFrame([("ann lee",), ("joann leed",), (" ",)], "search string")
    subjects = conflicts.subjects(clients, parties)
    hits = {(r.search, r.source, r.entity_id) for r in conflicts.search_substring(names, subjects).collect()}
    assert {("ann lee", "client", 1), ("ann lee", "client", 2), ("ann lee", "opposing_party", 7), ("ann lee", "opposing_party", 8)} <= hits
    assert {(r.search, r.source, r.entity_id) for r in conflicts.search_substring(names, subjects, few=0).collect()} == hits
    many = spark.createDataFrame([("ann lee",), ("ann lee",), ("o",), ("lee joann leeds",)], "search string")
    by_scan, by_pieces = (sorted(tuple(r) for r in conflicts.search_substring(many, subjects, few=n).collect()) for n in (100, 0))
    assert by_scan == by_pieces and len(by_scan) > 8
    best = conflicts.best_of_many(conflicts.search_trigram(names, subjects)).collect()
    assert {(r.source, r.entity_id): r.search for r in best}[("client", 2)] == "joann leed"
    assert ("client", 3) not in {(r.source, r.entity_id) for r in best}
    assert conflicts.searched_names("a", " b, ,c") == ["a", "b", "c"]


def test_many_searches(spark):
    """Names that share a beginning: pairs that are met are few beside all pairs, and none over the threshold is lost."""
    people = spark.range(1500).select(F.col("id"), F.concat(F.lit("customer"), F.lit("")).alias("first_name"), F.lpad(F.hash("id").cast("string").substr(-6, 6), 6, "0").alias("last_name"))
    subjects = conflicts.subjects(people, spark.createDataFrame([], "id long, full_name string"))
    names = subjects.select(F.concat(F.col("name"), F.lit("1")).alias("search")).distinct()
    n = names.count() * subjects.count()
    for threshold in (0.3, 0.8):
        x, y = scalar.trigrams(F.lower("search")), scalar.trigrams(F.col("name"))
        shared = F.size(F.array_intersect(x, y))
        every = names.crossJoin(subjects).filter(scalar.ratio32(shared, F.size(x) + F.size(y) - shared) > threshold)
        got = conflicts.search_trigram(names, subjects, threshold)
        assert got.count() == every.count()
    some = names.orderBy("search").limit(40)
    by_scan, by_grams = (sorted(map(tuple, conflicts.search_trigram(some, subjects, 0.3, few=n).collect())) for n in (100, 0))
    assert by_scan == by_grams and by_scan
    assert conflicts.candidates(names, subjects, 0.8).count() < 0.1 * n
    asked = subjects.select(F.col("name").substr(4, 20).alias("search")).distinct()
    found = conflicts.search_substring(asked, subjects, few=0)
    pairs = asked.crossJoin(subjects).filter(F.contains("name", F.col("search"))).select("search", "source", "entity_id", "name")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, pairs.collect()))


def test_places(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 7).alias("k"), (F.col("id") * 37 % 101).alias("v"))
    got = sorted((r.place, r.v, r.id) for r in relations.placed(rows, [F.desc("v"), F.col("id")]).collect())
    assert [(v, i) for _, v, i in got] == sorted(((v, i) for _, v, i in got), key=lambda x: (-x[0], x[1])) and [p for p, *_ in got] == list(range(1, 3001))
    within = relations.placed(rows, [F.desc("v"), F.col("id")], "k").collect()
    for k in range(7):
        own = sorted((r.place, -r.v, r.id) for r in within if r.k == k)
        assert [x[1:] for x in own] == sorted(x[1:] for x in own) and [x[0] for x in own] == list(range(1, len(own) + 1))
    assert relations.placed(rows.limit(0), [F.col("id")]).count() == 0


def test_append_and_principals(spark, tmp_path):
    path = str(tmp_path / "matters")
    good = spark.createDataFrame([(1, "intake")], "id long, status string")
    writes.append(path, "matters", good, ["id"])
    writes.append(path, "matters", good.withColumn("id", F.lit(2).cast("long")), ["id"])
    with pytest.raises(writes.Refused):
        writes.append(path, "matters", good.withColumn("status", F.lit("lost")), ["id"])
    with pytest.raises(writes.Refused) as told:
        writes.append(path, "matters", good.unionByName(good.withColumn("id", F.lit(7).cast("long"))), ["id"])
    assert [tuple(r) for r in told.value.violations.collect()] == [("unique_id", "1")]
    assert sorted(r.id for r in writes.read(spark, path).collect()) == [1, 2]
    writes.replace(path, writes.read(spark, path).withColumn("status", F.lit("closed")))
    assert {tuple(r) for r in writes.read(spark, path).collect()} == {(1, "closed"), (2, "closed")}
    assert sorted(x.name for x in tmp_path.iterdir()) == ["matters"]  # nothing is left aside
    roles = spark.createDataFrame([("u1", "client", 5, None), ("u2", "admin", None, 9), (None, "client", 7, None)], "uid string, role string, client_id long, staff_id long")
    assert security.principal("u1", roles) == security.Principal("client", 5, None, "u1") and security.principal("zz", roles).role == "none"
    found = security.principals(spark.createDataFrame([("u2",), ("zz",), (None,)], "uid string"), roles).collect()
    assert {(r.uid, r.role, r.staff_id) for r in found} == {("u2", "admin", 9), ("zz", None, None), (None, None, None)}


def test_seeds(spark):
    table = seeds.objections(spark)
    count = lambda kind: table.filter(F.arrays_overlap("applies_to", F.array(F.lit(kind), F.lit("*")))).count()
    assert [count(k) for k in ("disclosures", "production", "interrogatories", "admissions")] == [4, 7, 9, 7]
    assert seeds.add_missing(table, seeds.objections(spark)).count() == 10
    assert seeds.add_missing(table.limit(0), table).count() == 10
    assert seeds.privileges(spark).count() == 5


def test_rules(spark):
    splits = spark.createDataFrame([(1, D("60.00")), (1, D("40.00")), (2, D("60.00")), (2, D("30.00")), (3, D("60.00")), (3, D("50.00"))], "matter_id long, split_pct decimal(5,2)")
    assert [r.matter_id for r in quality.over_split(splits).collect()] == [3]
    assert [r.matter_id for r in quality.incomplete_splits(splits).collect()] == [2]
    schema = "id long, hours decimal(6,2), billed boolean, billing_cycle_id long"
    before = spark.createDataFrame([(1, None, True, None), (2, None, True, None), (3, None, False, None)], schema)
    after = spark.createDataFrame([(1, D("1.00"), True, None), (2, None, True, 5), (3, D("1.00"), True, None)], schema)
    assert [r.id for r in quality.billed_changes(before, after).collect()] == [1]
    roles = spark.createDataFrame([("attorney", 1, None), ("attorney", None, 1), ("client", None, None), ("client", None, 2)], "role string, staff_id long, client_id long")
    assert quality.failing(roles, quality.role_rules(), ["role"]).count() == 2


def test_writes(spark):
    table = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id long, name string, n int")
    patch = spark.createDataFrame([(1, None, 9)], "id long, name string, n int")
    assert {tuple(r) for r in writes.update(table, patch).collect()} == {(1, "a", 9), (2, "b", 6)}
    with pytest.raises(ValueError):
        writes.update(table, patch.select("id"))
    assert {tuple(r) for r in writes.upsert(table, spark.createDataFrame([(2, "z", 1), (3, "c", 2)], table.schema), ["id"]).collect()} == {(1, "a", 5), (2, "z", 1), (3, "c", 2)}
    with pytest.raises(writes.Refused):
        writes.insert(table, table, violations=table)
    claims = spark.createDataFrame([(1, 10), (2, 20)], "matter_id long, pleading_id long")
    left = writes.delete({"matters": table, "matter_claims": claims}, "matters", spark.createDataFrame([(1,)], "id long"))
    assert left["matters"].count() == 1 and [r.matter_id for r in left["matter_claims"].collect()] == [2]
    trail = writes.audit("x.update", "x", table.limit(0), table, "u").collect()
    assert len(trail) == 2 and trail[0].before_json is None


def test_security(spark):
    tables = {"matters": matters(spark)}
    cycles = spark.createDataFrame([(1, 1, "open"), (2, 1, "closed"), (3, 3, "closed")], "id long, matter_id long, status string")
    see = lambda who: [r.id for r in security.secure(cycles, "billing_cycles", who, tables).orderBy("id").collect()]
    assert see(security.Principal("paralegal")) == [1, 2, 3]
    assert see(security.Principal("client", client_id=1)) == [2]
    assert see(security.Principal("client", client_id=2)) == [3]
    assert see(security.Principal("stranger")) == []
    assert security.secure(cycles, "trust_ledger", security.Principal("client", client_id=1), tables).count() == 0
    with pytest.raises(PermissionError):
        security.require(security.Principal("client"), security.STAFF)
    assert security.may_write(security.Principal("attorney"), "trust_ledger") and not security.may_write(security.Principal("paralegal"), "trust_ledger")


def test_pleadings(spark):
    rows = spark.createDataFrame([(1, None, False), (2, 1, False), (3, 2, False), (4, None, True)], "id long, amends_pleading_id long, is_supplement boolean")
    assert [r.id for r in relations.live_pleadings(rows).collect()] == [3]
    assert {(r.id, r.root, r.depth) for r in relations.amend_chains(rows).collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 4, 0)}


DOC = """PLAINTIFF'S FIRST INTERROGATORIES
Served on 2026-03-20. Answer within 30 days.
INTERROGATORY NO. 1: State your name.
INTERROGATORY NO. 2: State your address.
INTERROGATORY NO. 0: Nothing."""


def test_ingest(spark):
    docs = spark.createDataFrame([("d", 1, DOC), ("own", 1, "Propounded by our client. REQUEST NO. 1 x"), ("lost", 99, "x"), ("bare", 3, "no heading")], "doc string, matter_id long, text string")
    out = ingest.ingest_discovery(docs, matters(spark), "2026-01-05")
    parent = {r.doc: r for r in out["documents"].collect()}
    assert set(parent) == {"d", "bare"} and parent["d"].request_type == "interrogatories" and parent["d"].due_date == date(2026, 4, 20)
    assert parent["bare"].propounded_date == date(2026, 1, 5)
    assert [(r.request_number, r.source_text) for r in out["items"].orderBy("request_number").collect()] == [(1, "State your name."), (2, "State your address.")]
    assert {(r.doc, r.reason) for r in out["rejected"].collect()} == {("own", "propounded by our client"), ("lost", "unknown matter")}
    assert {r.doc for r in out["warnings"].collect()} == {"d", "bare"}


def test_pleading_commit(spark):
    reply = '```json\n{"title": "Petition", "court_name": "County Court", "county": "Travis", "children": [{"name": "Al", "sex": "Male"}, {"name": ""}], "counsel": [{"name": "New Name", "bar_state": "TX", "bar_number": "1"}, {"name": "Y", "bar_state": "TX", "bar_number": "2"}, {"name": "Z"}]}\n```'
    claims = '[{"kind": "claim", "label": "fraud"}, {"kind": "nonsense", "label": "x"}]'
    rows = spark.createDataFrame([("p", 1, "ORIGINAL PETITION FOR DIVORCE\nCause No. 12-X", reply, claims), ("q", 3, "ORIGINAL ANSWER\n", "oops", None)], "doc string, matter_id long, text string, reply string, claims_reply string")
    m = spark.createDataFrame([(1, "District Court", None), (3, None, None)], "id long, court_name string, county string")
    counsel = spark.createDataFrame([(5, "Old Name", None, "TX", "1")], "id long, name string, email string, bar_state string, bar_number string")
    preview = ingest.preview_pleading(rows, m, counsel)
    diffs = {r.doc: {k: tuple(v) for k, v in r.diffs.items()} for r in preview["diffs"].collect()}
    assert diffs["p"] == {"court_name": ("District Court", "County Court")}
    assert preview["matched"].first().counsel_id == 5 and preview["new"].count() == 2
    assert {r.warning for r in preview["warnings"].collect()} == {"unknown claim kind skipped", "metadata could not be read"}
    links = spark.createDataFrame([], "matter_id long, counsel_id long")
    kept = ingest.commit_pleading(preview, rows.select("doc", "matter_id"), counsel.select("bar_state", "bar_number"), links)
    assert [r.bar_number for r in kept["counsel"].collect()] == ["2"] and kept["links"].count() == 1
    counts = {r.doc: r for r in kept["counts"].collect()}
    assert (counts["p"].children, counts["p"].claims, counts["p"].counsel, counts["q"].counsel) == (1, 1, 2, 0)


def test_billing_notes(spark):
    notes = spark.createDataFrame(
        [(1, "bill .25 to Anna Jones Divorce for drafting initial petition"), (2, "1.5 hours last friday, no charge, for a call"), (3, "filing fee $320.50 on 2026-03-01"), (4, "something")], "note long, text string"
    )
    got = {r.note: r for r in ingest.parse_notes(notes, "2026-03-18").collect()}
    assert got[1].hours == D("0.25") and got[1].description == "drafting initial petition" and got[1].confidence == "high"
    assert got[2].hours == D("1.50") and not got[2].billable and got[2].invoice_date == date(2026, 3, 13)
    assert got[3].entry_type == "expense" and got[3].amount == D("320.50") and got[3].hours is None
    assert got[4].confidence == "low"


def test_new_entries(spark):
    asked = spark.createDataFrame(
        [(1, None, "time", None, D("2.00"), D("100.00"), None), (2, 4, "time", date(2026, 1, 1), D("2.00"), D("100.00"), None), (2, 4, "expense", None, None, None, D("9.00"))],
        "matter_id long, staff_id long, entry_type string, entry_date date, hours decimal(6,2), rate decimal(10,2), amount decimal(12,2)",
    )
    got = {(r.matter_id, r.entry_type): r for r in ingest.new_entries(asked, matters(spark), 7, "2026-02-02").collect()}
    assert (got[1, "time"].staff_id, got[1, "time"].amount, got[1, "time"].entry_date) == (7, D("200.00"), date(2026, 2, 2))
    assert got[2, "time"].amount == 0 and got[2, "expense"].amount == 9


def test_outline_and_logins(spark):
    items = spark.createDataFrame(
        [(1, 2, "B", [], [], [("overbroad", "too wide")], None), (1, 1, "A", ["as asked"], [("work-product", "ours")], [], "yes")],
        "discovery_request_id long, request_number int, source_text string, interpretations array<string>, privileges array<struct<privilege_name:string,text:string>>, objections array<struct<objection_name:string,text:string>>, response string",
    )
    assert ingest.outline(items).first().outline == "No. 1\nRequest: A\nInterpretations: as asked\nPrivileges: Work Product: ours\nResponse: yes\n\nNo. 2\nRequest: B\nObjections: Overbroad: too wide"
    roles = spark.createDataFrame([(None, 1, "A@x"), ("u2", 2, "b@x")], "uid string, staff_id long, auth_email string")
    staff = spark.createDataFrame([(1, None), (2, "u2")], "id long, uid string")
    logins = spark.createDataFrame([("a@X", "u1")], "email string, uid string")
    roles, staff = ingest.link_logins(*ingest.link_logins(roles, staff, logins), logins)
    assert sorted(r.uid for r in roles.collect()) == sorted(r.uid for r in staff.collect()) == ["u1", "u2"]


def test_streams_equal_batch(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    ledger, log = adapter.load(spark, source, "trust_ledger"), adapter.load(spark, source, "audit_log")
    for name, rows in (("ledger", ledger), ("log", log)):
        rows.repartition(3).write.parquet(str(tmp_path / name))
    stream = spark.readStream.schema(ledger.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ledger"))
    q = streams.trust_balances(stream).writeStream.outputMode("complete").format("memory").queryName("balances").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("balances").collect()} == {tuple(r) for r in finance.trust_balance(ledger).collect()}
    late = log.limit(1).withColumn("created_at", F.lit("2999-01-01").cast("date")).withColumn("action", F.lit("end"))
    late.write.mode("append").parquet(str(tmp_path / "log"))  # an event so late that all windows close
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    q = streams.audit_counts(stream).writeStream.outputMode("append").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    want = sorted((r.start, r.action, r.n) for r in streams.audit_counts(log).collect())
    assert sorted((r.start, r.action, r.n) for r in spark.table("counts").collect()) == want and len(want) > 20
