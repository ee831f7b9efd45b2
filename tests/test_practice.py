"""The stored index of names, drafting from claims, figures by period, and alerts on balances."""

import math
from datetime import date, datetime, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from lexframe.operators import conflicts, drafting, intelligence, name_index, surface
from lexframe.streaming import alerts


def subjects(spark, n, at=0):
    return spark.range(at, at + n).select(F.lit("client").alias("source"), F.col("id").alias("entity_id"), F.concat(F.lit("customer "), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 7)).alias("name"))


def test_index_equals_the_scan(spark, tmp_path):
    path, every = str(tmp_path / "index"), subjects(spark, 900)
    name_index.extend(path, every.filter("entity_id < 500"))
    name_index.extend(path, every)  # what is there is not added again
    name_index.extend(path, every.limit(0))
    assert spark.read.parquet(f"{path}/names").count() == 900
    names = every.filter("entity_id % 90 = 3").select(F.concat("name", F.lit("x")).alias("search")).unionByName(spark.createDataFrame([("###",), ("customer",), ("nobody",), ("customer",)], "search string"))
    for threshold in (0.3, 0.6):
        got, want = (sorted(map(tuple, df.collect())) for df in (name_index.search(spark, path, names, threshold), conflicts.search_trigram(names, every, threshold)))
        assert got == want and got


def test_a_search_reads_its_own_buckets(spark, tmp_path):
    """One name at a high threshold: a few of the folders are read, and few of the names are met."""
    path = str(tmp_path / "index")
    name_index.extend(path, subjects(spark, 600))
    one = subjects(spark, 1).select(F.col("name").alias("search"))
    grams = name_index.rarest(spark, path, one, 0.8)
    buckets = name_index._buckets(grams)
    assert len(buckets) <= 5
    met = name_index.met(spark, path, one, 0.8)
    plan = met._jdf.queryExecution().executedPlan().toString()
    scan = name_index.of_buckets(spark, f"{path}/postings", buckets)
    folders = {r[0].split("bucket=")[1].split("/")[0] for r in scan.select(F.input_file_name()).distinct().collect()}
    assert folders == {str(b) for b in buckets}
    assert met.count() < 60 and f"{path}/names" not in plan  # no name is split again: those that are met come from the postings


def test_a_lost_append_counts_once(spark, tmp_path):
    """Postings that were written before the list of names was: the append is done again, and no hit comes twice."""
    path, some = str(tmp_path / "index"), subjects(spark, 50)
    name_index.extend(path, some)
    grams = spark.read.parquet(f"{path}/postings")
    grams.limit(200).write.partitionBy("bucket").mode("append").parquet(f"{path}/postings")
    names = some.select(F.col("name").alias("search"))
    got = sorted(map(tuple, name_index.search(spark, path, names, 0.5).collect()))
    assert got == sorted(map(tuple, conflicts.search_trigram(names, some, 0.5).collect()))


def test_best_claims(spark):
    rows = [(1, "a", "breach of contract and breach of trust"), (1, "b", "fraud"), (1, "c", "contract"), (2, "d", "fraud fraud contract"), (2, "e", ""), (2, "f", None)]
    items = [(1, "i", "Contract; BREACH!"), (1, "j", "nothing here"), (2, "k", "fraud contract fraud"), (3, "l", "fraud"), (2, "m", None)]
    got = [tuple(r) for r in drafting.best_claims(spark.createDataFrame(items, "matter_id long, item_id string, text string"), drafting.index(spark.createDataFrame(rows, "matter_id long, claim_id string, text string")), 2).orderBy("item_id", "place").collect()]
    texts = [(m, c, t.split()) for m, c, t in rows if t]
    mean = sum(len(t) for *_, t in texts) / len(texts)

    def score(words, matter, claim):
        t = next(t for m, c, t in texts if (m, c) == (matter, claim))
        total = 0.0
        for w in words:
            df, tf = sum(w in x for *_, x in texts), t.count(w)
            total += math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean)) if tf else 0
        return total

    want = [("i", "a", score(["contract", "breach"], 1, "a"), 1), ("i", "c", score(["contract"], 1, "c"), 2), ("k", "d", score(["fraud", "contract"], 2, "d"), 1)]
    assert [(i, c, p) for i, c, _, p in got] == [(i, c, p) for i, c, _, p in want]
    assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want))


def test_periods_merge_days(spark):
    rows = spark.range(30_000).selectExpr("id % 7000 AS matter_id", "'deposit' AS transaction_type", "CAST(id % 1000 AS DECIMAL(12,2)) AS amount", "date_add(DATE '2026-01-01', CAST(id % 60 AS INT)) AS transaction_date")
    got = intelligence.periods(intelligence.daily(rows), "year").first()
    assert got.n == 30_000 and got.total == D(30 * 499_500) and abs(got.matters - 7000) < 0.05 * 7000 and abs(got.median - 500) < 25
    months = intelligence.periods(intelligence.daily(rows)).orderBy("start").collect()
    assert [r.start for r in months] == [date(2026, 1, 1), date(2026, 2, 1), date(2026, 3, 1)] and sum(r.n for r in months) == 30_000
    assert intelligence.daily(rows.limit(0)).count() == 0


@pytest.fixture(scope="module")
def streaming(spark):
    own = surface.own_session(spark)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", alerts.PROVIDER)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    return own


LEDGER = "id long, matter_id long, time timestamp, transaction_type string, amount decimal(12,2)"


def run(spark, batches, tmp_path):
    """What a stream of these batches alerts, a file a batch."""
    matters = spark.createDataFrame([(1, D("100.00"), D("0.4000")), (2, D("100.00"), D("0.4000"))], "id long, retainer_amount decimal(12,2), refresh_trigger_pct decimal(5,4)")
    out = []
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(LEDGER).parquet(str(tmp_path / "in"))
    for batch in batches:
        spark.createDataFrame(batch, LEDGER).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = alerts.alerts(stream, matters).writeStream.outputMode("append").foreachBatch(lambda df, n: out.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "marks"))
        query.trigger(availableNow=True).start().awaitTermination()
    return sorted((m, at.date().isoformat(), kind, after) for m, at, kind, _, after in out)


def test_alerts(streaming, tmp_path):
    day = lambda n: datetime(2026, 1, 1) + timedelta(days=n)
    first = [(2, 1, day(1), "withdrawal", D("70")), (1, 1, day(0), "deposit", D("100")), (3, 2, day(1), "deposit", D("10"))]
    second = [(4, 1, day(20), "deposit", D("70")), (5, 2, day(50), "refund", D("11"))]
    third = [(6, 2, day(51), "deposit", D("20")), (7, 1, day(100), "deposit", D("1"))]
    assert run(streaming, [first, second, third], tmp_path) == [
        (1, "2026-01-01", "crossed", "green"), (1, "2026-01-02", "crossed", "yellow"), (1, "2026-01-21", "crossed", "green"),
        (2, "2026-01-02", "crossed", "yellow"), (2, "2026-02-01", "still yellow", "yellow"), (2, "2026-02-20", "crossed", "red"), (2, "2026-02-21", "crossed", "yellow"),
        (2, "2026-03-23", "still yellow", "yellow"),  # by its timer, when the other matter's entry moves the watermark
    ]
