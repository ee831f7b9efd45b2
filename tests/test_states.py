"""The audit trail as states, pages from files, and streams that are stopped and started again."""

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from lexframe.operators import finance, history
from lexframe.sources import adapter, pages
from lexframe.streaming import ledger as streams

LOG = "id long, entity_type string, entity_id long, created_at date, before_json string, after_json string"


def test_changes(spark):
    log = spark.createDataFrame(
        [
            (1, "m", 1, date(2026, 1, 1), None, '{"a":1,"b":"x","c":null}'),
            (2, "m", 1, date(2026, 1, 2), '{"a":1,"b":"x"}', '{"a":2,"b":"x","d":[1,2]}'),
            (3, "m", 1, date(2026, 1, 3), '{"a":2}', None),
            (4, "m", 1, date(2026, 1, 4), None, None),
            (5, "m", 1, date(2026, 1, 5), "oops", '{"a":"é"}'),
            (6, "m", 1, date(2026, 1, 6), '{"a":1}', '{"a":1}'),
        ],
        LOG,
    )
    got = sorted(tuple(r) for r in history.changes(log, "id").select("id", "field", "old", "new").fillna("-").collect())
    assert got == [(1, "a", "-", "1"), (1, "b", "-", "x"), (2, "a", "1", "2"), (2, "d", "-", "[1,2]"), (3, "a", "2", "-"), (5, "a", "-", "é")]
    assert history.changes(log.limit(0), "id").count() == 0


def test_states_at_moments(spark):
    log = spark.createDataFrame([(k, "m", e, date(2026, 1, d), None, a) for k, e, d, a in [(1, 1, 1, "A"), (3, 1, 2, "B"), (2, 1, 2, "C"), (4, 1, 5, None), (5, 2, 3, "X"), (6, None, 1, "N")]], LOG)
    moments = spark.createDataFrame([("m", e, date(2026, 1, d)) for e, d in [(1, 1), (1, 2), (1, 4), (1, 9), (2, 2), (2, 3), (3, 9)]] + [("m", 1, date(2026, 1, 1))], "entity_type string, entity_id long, at date")
    got = {(r.entity_id, r["at"].day): r.after_json for r in history.states(log, moments).collect()}
    assert got == {(1, 1): "A", (1, 2): "B", (1, 4): "B", (1, 9): None, (2, 3): "X"}  # ties of a day: the greater id; nothing before the first entry


def test_pages(spark, tmp_path):
    long = ["a page with text enough on it", "another page, with enough text too"]
    docs = spark.createDataFrame([(1, long), (2, ["short", long[0], " " * 50]), (3, []), (4, ["", "x"]), (5, [long[1] + "\nwith\ftwo lines\r\n"])], "doc long, pages array<string>")
    pages.write_pages(docs, str(tmp_path / "files"), "doc", "pages")
    assert len(list((tmp_path / "files").rglob("part-*"))) == 5
    text, short = pages.read_pages(spark, str(tmp_path / "files"))
    assert text.count() == 4 and {(r.doc, r.page) for r in text.collect()} == {(1, 1), (1, 2), (2, 2), (5, 1)}
    assert {(r.doc, r.page) for r in short.collect()} >= {(2, 1), (2, 3), (4, 1), (4, 2)}
    got = {r.doc: r.text for r in pages.joined(text, "doc").collect()}
    assert got == {1: "\n\n".join(long), 2: long[0], 5: long[1] + "\nwith two lines\r\n"}


def test_bundles(spark, tmp_path):
    """Documents by the hundred share a file, and come back as they were, whatever characters they have."""
    odd = ["", "a\x1eb\fc\x1bd", "\x1b0\x1b1\x1b2", "x\r\ny\n", "\x1b"]
    docs = spark.range(300).select(F.col("id").cast("string").alias("doc"), F.slice(F.lit(odd), F.lit(1), (F.col("id") % 6).cast("int")).alias("pages"))
    more = spark.createDataFrame([(None, ["no key"]), ("7", ["one id, two documents"])], "doc string, pages array<string>")
    pages.write_bundles(docs.unionByName(more).coalesce(2), str(tmp_path / "b"), "doc", "pages")
    assert len(list((tmp_path / "b").rglob("part-*"))) <= 2  # not a file for each
    got = sorted((r.doc or "", r.pages) for r in pages.read_bundles(spark, str(tmp_path / "b"), "doc").collect())
    want = [(str(k), [*(odd[: k % 6] or [""]), ""]) for k in range(300)] + [("", ["no key", ""]), ("7", ["one id, two documents", ""])]
    assert got == sorted(want)


def test_page_query_writes_few_files(spark, tmp_path, monkeypatch):
    from lexframe.plans import pipelines

    spark.range(200).selectExpr("id AS doc_id", "concat('a line with text enough on it ', id, '\nshort') AS text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(pipelines, "fresh_path", lambda spark, label: str(tmp_path / label))
    assert pipelines.QUERIES["src_pdf_text"](spark, str(tmp_path)).count() == 400
    assert sum(1 for _ in tmp_path.rglob("part-*.txt")) <= 8


@pytest.fixture
def ledger(spark, tmp_path):
    rows = [(k, k % 5, "deposit" if k % 3 else "withdrawal", D(k), date(2026, 1, 1 + k % 28)) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, matter_id long, transaction_type string, amount decimal(12,2), transaction_date date")
    df.repartition(6).write.parquet(str(tmp_path / "ledger"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ledger"))
    return df, stream


def test_a_stream_that_is_stopped_after_a_write(spark, ledger, tmp_path):
    """The third batch is written, and the stream ends before it is marked as done; started again it gives the batch
    result, and the batch is there once."""
    rows, stream = ledger
    out, marks, seen = str(tmp_path / "out"), str(tmp_path / "marks"), []

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        seen.append(number)
        if number == 2:
            raise RuntimeError("lost")

    query = streams.trust_balances(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", marks).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    assert seen == [0, 1, 2]
    again = streams.upsert(streams.trust_balances(stream), out, marks)
    again.awaitTermination()
    assert sorted(p.name for p in (tmp_path / "out").glob("batch=*")) == [f"batch={k}" for k in range(6)]
    want = {tuple(r) for r in finance.trust_balance(rows).collect()}
    newest = lambda: {tuple(r) for r in streams.newest(spark, out, ["matter_id"]).select("matter_id", "trust").collect()}
    assert newest() == want
    assert again.lastProgress["stateOperators"][0]["numRowsTotal"] == 5  # a row for each matter
    streams.compact(spark, out, ["matter_id"])
    assert newest() == want and [p.name for p in (tmp_path / "out").glob("batch=*")] == ["batch=5"]
    rows.limit(50).withColumn("id", F.col("id") + 1000).write.mode("append").parquet(str(tmp_path / "ledger"))
    streams.upsert(streams.trust_balances(stream), out, marks).awaitTermination()
    assert newest() == {tuple(r) for r in finance.trust_balance(spark.read.parquet(str(tmp_path / "ledger"))).collect()} != want


def test_audit_counts_of_the_driver_tables(spark):
    log = adapter.load(spark, "/root/testdata/sf0.001", "audit_log")
    assert streams.audit_counts(log).agg(F.sum("n")).first()[0] == log.count()
