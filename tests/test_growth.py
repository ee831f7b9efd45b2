"""What must not grow faster than the tables: tasks that get all nulls, rows worked out twice, groups of one common key."""

import pytest
from pyspark.sql import functions as F

from lexframe.llm import secret_scan
from lexframe.operators import conflicts, drafting, finance, name_index, relations, security, surface
from lexframe.plans import ingest, pipelines
from lexframe.sources import adapter
from lexframe.streaming import alerts


@pytest.fixture
def shuffled(spark):
    """The session without broadcasts and without partitions put together or split at run time."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_entries_without_a_cycle_stay_spread(shuffled):
    """Half of the entries have no cycle; none of eight tasks has more than twice its share."""
    n = F.col("id")
    entries = shuffled.range(0, 8000, 1, 8).select(n.alias("matter_id"), F.when(n % 2 == 0, n).alias("billing_cycle_id"), F.when(n % 3 > 0, n % 3 == 1).alias("billed"))
    cycles = shuffled.range(8000).select("id", F.when(n % 4 == 0, "open").otherwise("closed").alias("status"))
    after, _, _ = finance.close_cycle(entries, cycles, cycles.select("id"), 3)
    sizes = [r["count"] for r in after.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 8000 and max(sizes) <= 2000
    got = {r.matter_id: r.billed for r in after.collect()}
    assert got == {k: True if k % 4 == 0 else None if k % 3 == 0 else k % 3 == 1 for k in range(8000)}


def test_a_patch_is_judged_in_one_pass(spark):
    """What is refused and what is written come from one join of the table with the patch, not from one for each reason."""
    rows = spark.range(60).select("id", F.col("id").alias("request_id"), (F.col("id") % 5 == 0).alias("is_final"))
    tables = {"matters": spark.range(6).select("id", F.col("id").alias("client_id")), "discovery_requests": spark.range(60).select("id", (F.col("id") % 6).alias("matter_id"))}
    patch = rows.select("id", (F.col("id") % 2 == 0).alias("is_final")).unionByName(spark.createDataFrame([(99, True)], "id long, is_final boolean"))
    judge = getattr(security, "judged", security.refused_updates)
    got = judge("discovery_responses", rows, patch, security.Principal("client", client_id=3), tables)
    assert plan(got).count("Join") <= 9 and {r.id: r.reason for r in got.collect() if r.reason != "hidden"} == {k: "written" for k in (3, 9, 21, 27, 33, 39, 51, 57)}
    none = security.refused_updates("discovery_responses", rows, patch, security.Principal("attorney"), tables)
    assert [tuple(r) for r in none.collect()] == [(99, "hidden")]


def test_places_within_a_null(spark):
    """Rows of no value are placed too, and ranges that a value is spread over go on where the one before ended."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 3001).alias("v"))
    got = [tuple(r) for r in relations.placed(rows, [F.col("v")], "k").collect()]
    want = [(k, v, at + 1) for k in (None, 1, 2) for at, v in enumerate(sorted(i * 7919 % 3001 for i in range(3000) if (i % 3 or None) == k))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_few_searches_are_compared_by_all_tasks(spark):
    """However few files the names lie in."""
    subjects = spark.range(0, 500, 1, 1).select(F.lit("client").alias("source"), F.col("id").alias("entity_id"), F.concat(F.lit("customer "), "id").alias("name"))
    hits = conflicts.search_trigram(spark.createDataFrame([("customer 12",)], "search string"), subjects)
    assert hits.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and hits.count() > 400


def test_a_function_splits_each_name_once(spark):
    load = lambda session, name: adapter.load(session, "/root/testdata/sf0.001", name)
    found = surface.opened(spark, load).sql("SELECT * FROM search_conflicts('customer 000000012', 0.3)")
    assert plan(found).count("split(lower(") <= 1 and found.count() > 100  # the search's own are folded


def test_a_function_compares_by_many_tasks(shuffled, tmp_path):
    load = lambda session, name: adapter.load(session, "/root/testdata/sf0.001", name)
    found = surface.opened(shuffled, load).sql("SELECT * FROM search_conflicts('customer 000000012', 0.3)")
    assert found.rdd.getNumPartitions() >= 8


def test_a_bucket_is_written_by_many_tasks(shuffled, tmp_path, monkeypatch):
    """All names have the trigrams of "customer": their postings are not one task's, and what is met carries no arrays."""
    spark = shuffled
    monkeypatch.setattr(name_index, "SHARE", 100, raising=False)
    names = spark.range(800).select(F.lit("client").alias("source"), F.col("id").alias("entity_id"), F.concat(F.lit("customer "), "id").alias("name"))
    name_index.extend(str(tmp_path / "i"), names)
    posted = spark.read.parquet(str(tmp_path / "i" / "postings")).filter("gram = 'cus'")
    assert posted.count() == 800 and posted.select(F.input_file_name()).distinct().count() > 1
    met = name_index.met(spark, str(tmp_path / "i"), spark.createDataFrame([("customer 12",)], "search string"), 0.3)
    assert not [c for c, kind in met.dtypes if kind.startswith("array")]


def test_claims_that_items_cannot_tell_apart_are_one(spark):
    """A thousand claims of one text: an item meets one form of them, and the smallest ids come first."""
    claims = spark.range(1000).selectExpr("1L AS matter_id", "lpad(string(id), 4, '0') AS claim_id", "concat('breach of trust b', id % 50) AS text")
    items = spark.createDataFrame([(1, "i", "breach"), (1, "j", "trust b7")], "matter_id long, item_id string, text string")
    indexed = drafting.index(claims)
    found = [(r.item_id, r.claim_id, r.place) for r in drafting.best_claims(items, indexed).orderBy("item_id", "place").collect()]
    assert found == [("i", "0000", 1), ("i", "0001", 2), ("i", "0002", 3), ("j", "0007", 1), ("j", "0057", 2), ("j", "0107", 3)]
    words = spark.createDataFrame([(1, "breach"), (1, "trust"), (1, "b7")], "matter_id long, term string")
    assert sorted(len(r.claim_ids) for r in drafting.forms(words, indexed, 3).collect()) == [3, 3]


def test_alerts_make_no_empty_frames():
    """A matter whose rows cross nothing gives no frame."""
    import pandas as pd

    class State:
        def __init__(self):
            self.row = (500, "green", 0, False)

        exists, get = lambda self: True, lambda self: self.row

        def update(self, row):
            self.row = row

    each = alerts.Alerts(30)
    each.state, each.handle = State(), None
    rows = [pd.DataFrame({"matter_id": [1], "id": [k], "ts": [at], "cents": [c], "floor": [40]}) for k, at, c in ((2, 9, 5), (1, 3, 7))]
    assert list(each.handleInputRows((1,), iter(rows), None)) == [] and each.state.row == (512, "green", 0, False)
    assert list(each.handleExpiredTimer((1,), None, None)) == []


def test_draws_are_shuffled_as_words(spark, monkeypatch):
    """No group's draws are gathered before they are shuffled, and the tokens do not depend on how many tasks join them."""
    n = F.col("id")
    texts = spark.range(3000).select(F.concat_ws(" ", F.translate(F.hex(n * 7919), "0123456789", "ghijklmnop"), F.lit("common"), n.cast("string")).alias("t"))
    one = secret_scan.language(texts)
    above, _, below = one._jdf.queryExecution().executedPlan().toString().partition("Exchange ")
    assert "collect_list" in above and below and "collect_list" not in below
    want = sorted(r.x for r in one.collect())
    monkeypatch.setattr(secret_scan, "TASK_DRAWS", 500)
    many = secret_scan.language(texts)
    assert sorted(r.x for r in many.collect()) == want and len(want) > 500
    sizes = [r["count"] for r in many.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 10 and max(sizes) < len(want) / 5


def test_replies_are_parsed_once(spark):
    """No part of a preview parses a reply again, and the counts are those of the parts: counsel known twice count twice,
    those without a state once, a document named twice has two rows, one without a readable reply has zeros."""
    reply = '{"children": [{"name": "A"}, {"name": ""}, {"name": null}], "counsel": [{"bar_state": "TX", "bar_number": "1"}, {"bar_state": "TX", "bar_number": "2"}, {"bar_number": "3"}, {"name": "N"}]}'
    said = '[{"kind": "claim", "label": "x"}, {"kind": "claim", "label": ""}, {"kind": "wish", "label": "y"}, {"kind": "defense", "label": "z"}]'
    rows = spark.createDataFrame([(1, 10, "", f"```json\n{reply}\n```", said), (2, 10, "", "oops", "["), (3, 99, "", "{}", None), (4, 10, "", None, said)], "doc long, matter_id long, text string, reply string, claims_reply string")
    m = spark.createDataFrame([(10, "Court", "Travis")], "id long, court_name string, county string")
    counsel = spark.createDataFrame([(k, f"C{k}", None, "TX", "1") for k in (5, 6)] + [(7, "D", None, "OK", "2")], "id long, name string, email string, bar_state string, bar_number string")
    preview = ingest.preview_pleading(rows, m, counsel)
    docs = rows.select("doc", "matter_id").unionByName(rows.select("doc", "matter_id").filter("doc = 1"))
    kept = ingest.commit_pleading(preview, docs, counsel.select("bar_state", "bar_number"), spark.createDataFrame([(10, 6)], "matter_id long, counsel_id long"))
    assert sorted(tuple(r) for r in kept["counts"].collect()) == [(1, 1, 2, 4), (1, 1, 2, 4), (2, 0, 0, 0), (3, 0, 0, 0), (4, 0, 2, 0)]
    assert {(r.bar_state, r.bar_number) for r in kept["counsel"].collect()} == {("TX", "2"), (None, "3")} and [tuple(r) for r in kept["links"].collect()] == [(10, 5)]
    assert {r.doc for r in preview["warnings"].filter("warning like 'metadata%'").collect()} == {2, 4} and {r.doc for r in preview["diffs"].collect()} == {1, 2, 4}
    assert not any(word in plan(df) for df in (*preview.values(), *kept.values()) for word in ("parseJson", "from_json"))


def test_a_commit_does_all_its_stages(spark):
    """Two documents of one matter name the same counsel, known and new: the first adds the counsel and its link, the last one's
    word is left in the fields; a link that is there is not made again, counsel who came in since the preview are known, and a
    document that is not committed writes nothing."""
    said = lambda county, name, n: f'{{"title": "T", "county": "{county}", "children": [{{"name": "A"}}], "counsel": [{{"name": "{name}", "bar_state": "TX", "bar_number": "1"}}, {{"name": "{name}", "bar_state": "TX", "bar_number": "{n}"}}]}}'
    claims = '[{"kind": "claim", "label": "x"}]'
    rows = spark.createDataFrame([(1, 10, "", said("Bexar", "N1", 2), claims), (2, 10, "", said("Hays", "N2", 2), claims), (3, 11, "", said("Travis", "N3", 4), claims), (4, 11, "", "oops", None), (5, 11, "", said("Lee", "N5", 3), claims)], "doc long, matter_id long, text string, reply string, claims_reply string")
    m = spark.createDataFrame([(10, "Court", "Travis"), (11, "Court", "Travis")], "id long, court_name string, county string")
    counsel = spark.createDataFrame([(7, "Old", None, "TX", "1")], "id long, name string, email string, bar_state string, bar_number string")
    preview = ingest.preview_pleading(rows, m, counsel)
    now = counsel.select("id", "bar_state", "bar_number").unionByName(spark.createDataFrame([(8, "TX", "4")], "id long, bar_state string, bar_number string"))
    kept = ingest.commit_pleading(preview, rows.select("doc", "matter_id").filter("doc < 5"), now, spark.createDataFrame([(11, 7)], "matter_id long, counsel_id long"))
    got = {part: sorted((r.asDict() for r in kept[part].collect()), key=repr) for part in kept}
    assert got["counsel"] == [{"doc": 1, "name": "N1", "email": None, "bar_state": "TX", "bar_number": "2"}]
    assert [tuple(r.values()) for r in got["links"]] == [(10, 7), (11, 8)] and [tuple(r.values()) for r in got["new_links"]] == [(10, "TX", "2")]
    assert got["matters"] == [{"matter_id": 10, "court_name": None, "county": "Hays"}]
    assert got["counsel_patch"] == [{"counsel_id": 7, "name": "N3", "email": None}, {"counsel_id": 8, "name": "N3", "email": None}]
    assert [(r["doc"], r["matter_id"], r["title"]) for r in got["pleadings"]] == [(1, 10, "T"), (2, 10, "T"), (3, 11, "T"), (4, 11, "(untitled)")]
    assert [(r["doc"], r["matter_id"]) for r in got["children"]] == [(r["doc"], r["matter_id"]) for r in got["claims"]] == [(1, 10), (2, 10), (3, 11)]
    assert [tuple(r) for r in kept["records"].orderBy("doc").collect()] == [(1, "T", 1, 1, 2, 1, 2, 0, 0), (2, "T", 1, 1, 2, 0, 0, 0, 1), (3, "T", 1, 1, 2, 0, 1, 2, 0), (4, "(untitled)", 0, 0, 0, 0, 0, 0, 0)]


@pytest.mark.parametrize("table, column", [("matter_opposing_counsel", "links"), ("opposing_counsel", "new_counsel"), ("opposing_counsel", "counsel_fields"), ("matters", "matter_fields")])
def test_what_a_commit_meets_tells_in_its_result(spark, table, column):
    """Without the rows of a table that a stage of pipe_pleading_commit reads, the result is another."""
    load = lambda name: adapter.load(spark, "/root/testdata/sf0.001", name)
    without = lambda name: load(name).limit(0) if name == table else load(name)
    total = lambda t: pipelines.pipe_pleading_commit(t).agg(F.sum(column)).first()[0]
    assert total(load) != total(without)


def test_pleadings_are_dealt_to_all_tasks(spark):
    """Ids are few bytes, so that partitions put together by size would leave the parsing of all replies to one task."""
    made = pipelines._pleadings(lambda _: spark.range(0, 3000, 1, 1).select("id", (F.col("id") % 7).alias("matter_id")))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.parallelismFirst")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    try:
        sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", old)
    assert sum(sizes) == 3000 and max(sizes) < 500
