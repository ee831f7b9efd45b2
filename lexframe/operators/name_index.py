"""A stored index of names by trigram, for conflict searches that come one after the other.

A posting is a trigram and a name that has it. Postings lie in folders by the trigram's bucket, so a search reads the
buckets of its own rarest trigrams and nothing else; how many names have a trigram is kept beside them, so it is known
without counting. New names are appended: those that the index has (by source and id) are left out, and no name that is
there is split again.

Names of one trigram are as many as there are; a search whose trigrams are all common reads them, since its result may
hold them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scalar
from ..sources.shared import exists, narrow, written

BUCKETS = 64
#: A bucket's postings are written by a task for each so many new names: a trigram that all names have is in one bucket.
SHARE = 500_000
KEY = ("source", "entity_id")


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def extend(path: str, subjects: DataFrame) -> None:
    """Add the subjects (source, entity_id, name) that the index does not have. What is written last is the list of
    names: an append that is lost before is done again, and the postings that it left count once."""
    spark = subjects.sparkSession
    new = subjects.select(*KEY, "name").dropDuplicates(list(KEY))
    if exists(spark, f"{path}/names"):
        new = new.join(spark.read.parquet(f"{path}/names").select(*KEY), list(KEY), "left_anti")
    new = written(new, "new")
    shares = F.pmod(F.xxhash64(*KEY), F.lit(new.count() // SHARE + 1))
    grams = scalar.trigrams(F.col("name"))
    spread = new.repartition(3 * spark.sparkContext.defaultParallelism, *KEY)  # few bytes, much work: all tasks split names
    postings = spread.select(*KEY, "name", F.size(grams).alias("grams"), F.explode(grams).alias("gram")).withColumn("bucket", bucket(F.col("gram")))
    postings.repartition("bucket", shares).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").mode("append").parquet(f"{path}/postings")
    counts = spark.read.parquet(f"{path}/postings") if not exists(spark, f"{path}/often") else postings
    counts.groupBy("gram").agg(F.count("*").alias("n")).withColumn("bucket", bucket(F.col("gram"))).write.partitionBy("bucket").mode("append").parquet(f"{path}/often")
    new.write.mode("append").parquet(f"{path}/names")


def of_buckets(spark: SparkSession, path: str, which: list[int]) -> DataFrame:
    """The rows of a part of the index that lie in these buckets; other folders are not listed."""
    return spark.read.parquet(path).filter(F.col("bucket").isin(which))


def _buckets(grams: DataFrame) -> list[int]:
    """The buckets of the grams: BUCKETS numbers at most, however many grams there are."""
    return sorted(r[0] for r in grams.select(bucket(F.col("gram"))).distinct().collect())


def rarest(spark: SparkSession, path: str, names: DataFrame, threshold: float) -> DataFrame:
    """search, grams (of the search), gram: those of which a subject over the threshold has at least one."""
    asked = names.select("search").distinct().withColumn("grams", scalar.trigrams(F.lower("search"))).filter(F.size("grams") > 0)
    each = asked.select("search", "grams", F.explode("grams").alias("gram"))
    often = of_buckets(spark, f"{path}/often", _buckets(each)).groupBy("gram").agg(F.sum("n").alias("n"))
    counted = each.join(often, "gram", "left").groupBy("search", "grams").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("o"))
    n = F.size("grams")
    kept = F.slice(F.transform("o", lambda x: x["gram"]), F.lit(1), (n - F.ceil(threshold * n - 1e-6) + 1).cast("int"))
    return counted.select("search", "grams", F.explode(kept).alias("gram"))


def met(spark: SparkSession, path: str, names: DataFrame, threshold: float) -> DataFrame:
    """Searches and the names that may be similar to them, a row for each trigram on which they meet."""
    wanted = rarest(spark, path, names, threshold)
    postings = of_buckets(spark, f"{path}/postings", _buckets(wanted)).drop("bucket")
    n = F.size(wanted["grams"])
    lengths = (postings["grams"] >= threshold * n - 1e-6) & (threshold * postings["grams"] - 1e-6 <= n)
    joined = postings.join(narrow(wanted), (postings["gram"] == wanted["gram"]) & lengths)
    return joined.select("search", *KEY, "name")


def search(spark: SparkSession, path: str, names: DataFrame, threshold: float = 0.3) -> DataFrame:
    """names (column search) against the index: search, source, entity_id, matched_name, sim over the threshold."""
    asked = names.select("search").distinct().withColumn("_q", scalar.trigrams(F.lower("search")))
    pairs = met(spark, path, names, threshold).distinct().join(narrow(asked), "search")  # narrow rows are told apart; grams come after
    shared = pairs.withColumn("_t", scalar.trigrams(F.col("name"))).select("*", F.explode(F.array(F.size(F.array_intersect("_q", "_t")))).alias("_k"))
    found = shared.withColumn("sim", scalar.ratio32(F.col("_k"), F.size("_q") + F.size("_t") - F.col("_k")))
    return found.filter(F.col("sim") > threshold).select("search", *KEY, F.col("name").alias("matched_name"), "sim")
