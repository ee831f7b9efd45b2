"""Benchmark decontamination: containment search by MinHash in size partitions, verified exactly.

An item's sketch holds its shingles of least hash. A document that contains 0.8 of an item's shingles contains each
member of the sketch with that chance, whatever its own length, so looking up sketch members among the document's
shingles finds short items inside long documents. Items are partitioned by their number of shingles: each partition
has its own sketch size and, from it, a number of members that must be found, so that a long item, which shares more
with others by chance, must show more of itself. Candidates are verified on the shingles' words.

Documents need no sketch: containment asks for the item's shingles only, and a sketch of a long document would lose a
short item. Everything is DataFrame functions. The sketch is broadcast only if its rows are few; else the join shuffles.

Defined cases: null texts are empty; a shingle has five words, and an item of fewer words is one shingle of all of
them; items and documents without words match nothing; a null doc_id or item_id is an id like any other; repeated
rows of one id count as one document or item, but `decontaminate` takes each row for itself; very long texts are
taken whole; ties of a sketch's hashes go by the shingle's own hash; empty tables give an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import SHINGLE_WORDS, SIMILARITY, cut, sized, unused

#: Size partitions: items of up to so many shingles have a sketch of so many. The first holds items whole.
PARTITIONS = ((16, 16), (64, 24), (256, 32), (None, 48))
#: A document that contains enough of an item is missed with less than this chance.
MISS = 1e-6
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and non-ASCII characters; an empty string may stand at either end."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1)


def _shingles(w: Column, width: int, make: Callable[[Column], Column]) -> Column:
    """make(place) for each run of so many words; an empty string at either end is none."""
    first = F.when(F.element_at(w, 1) == "", 1).otherwise(0)
    last = F.size(w) - F.when(F.element_at(w, -1) == "", 1).otherwise(0) - width
    empty = F.array().cast("array<int>")
    return F.transform(F.when(last >= first, F.sequence(first, last)).otherwise(empty), make)


def hashed(w: Column, width: int) -> Column:
    return _shingles(w, width, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))


def spelled(w: Column, width: int) -> Column:
    return _shingles(w, width, lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(width))))


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, shingle, width, h), each once."""
    w = items.select("item_id", words(F.col("text")).alias("w")).withColumn("n", F.size(F.filter("w", lambda x: x != "")))
    widths = range(1, SHINGLE_WORDS + 1)
    of_width = [F.when(F.least("n", F.lit(SHINGLE_WORDS)) == k, spelled(F.col("w"), k)) for k in widths]
    rows = w.filter("n > 0").select("item_id", F.least("n", F.lit(SHINGLE_WORDS)).alias("width"), F.explode(F.coalesce(*of_width)).alias("shingle")).distinct()
    part = F.split("shingle", " ")
    return rows.withColumn("h", F.coalesce(*(F.when(F.col("width") == k, F.xxhash64(*(F.get(part, F.lit(j)) for j in range(k)))) for k in widths)))


def needed(n: int, threshold: float) -> int:
    """Sketch members that must be found for an item of a sketch of n: a document at the threshold has fewer
    with a chance below MISS."""
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
        if total >= MISS:
            return max(1, m)
    return n


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_shared, containment) with containment at or over the threshold."""
    spelling = cut(item_shingles(items), "shingles")
    widths = sorted(r.width for r in spelling.select("width").distinct().collect())  # five at most
    every = lambda w, of: F.flatten(F.array(*(of(w, k) for k in widths)))
    if not widths:
        return docs.select("doc_id").join(items.select("item_id"), F.lit(False)).select("doc_id", "item_id", F.lit(0).cast("long").alias("n_item"), F.lit(0).cast("long").alias("n_shared"), F.lit(0.0).alias("containment"))
    n = F.col("n_item")
    by_size = lambda of: F.coalesce(*(F.when(n <= most, of(size)) if most else of(size) for most, size in PARTITIONS))
    grouped = spelling.groupBy("item_id").agg(F.count("*").alias("n_item"), F.array_sort(F.collect_list(F.struct(F.xxhash64("h", F.lit(7)).alias("order"), "h"))).alias("all"))
    sized_items = cut(grouped.select("item_id", "n_item", F.slice("all", F.lit(1), by_size(F.lit)).alias("sketch")), "items")
    # an item that is its own sketch needs the exact share
    least = F.when(n == F.size("sketch"), F.ceil(F.round(n * threshold, 6))).otherwise(by_size(lambda size: F.lit(needed(size, threshold))))
    sketch = sized_items.select("item_id", least.cast("int").alias("least"), F.explode("sketch").alias("x")).select("item_id", "least", F.col("x.h").alias("h"))

    w = docs.select("doc_id", words(F.col("text")).alias("w"))
    found = (
        w.select("doc_id", F.explode(every(F.col("w"), hashed)).alias("h"))
        .join(sized(sketch), "h")
        .groupBy("doc_id", "item_id", "least")
        .agg(F.count_distinct("h").alias("n"))
        .filter("n >= least")
        .select("doc_id", "item_id")
    )
    found = cut(found, "candidates")

    ids = found.select(F.col("doc_id").alias("id")).distinct()
    suspects = docs.join(sized(ids), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("doc_id", words(F.col("text")).alias("w"))
    spoken = suspects.select("doc_id", F.explode(every(F.col("w"), spelled)).alias("shingle")).join(sized(spelling.select("item_id", "shingle")), "shingle").distinct()
    pairs = found.select(F.col("doc_id").alias("d"), F.col("item_id").alias("i"))
    shared = spoken.join(pairs, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("item_id").eqNullSafe(F.col("i")), "left_semi").groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    counts = sized_items.select(F.col("item_id").alias("i"), "n_item")
    return (
        shared.join(sized(counts), F.col("item_id").eqNullSafe(F.col("i")))
        .filter(F.col("n_shared") >= F.round(F.col("n_item") * threshold, 6))
        .select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    )


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The documents that contain no item, judged row by row; columns as they are. A row is known by the hash of
    its doc_id and text, so rows that share an id, or have none, do not answer for each other."""
    own, name = unused(docs, "_row", "_bad")
    marked = docs.withColumn(own, F.xxhash64("doc_id", "text"))
    bad = contaminated(marked.select(F.col(own).alias("doc_id"), "text"), items, threshold).select(F.col("doc_id").alias(name)).distinct()
    return marked.join(bad, F.col(own) == F.col(name), "left_anti").drop(own)


#: The same pairs in DuckDB.
SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
v AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
k AS (SELECT DISTINCT least(len(w), 5) AS k FROM v WHERE len(w) > 0),
d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) + 2 - k), lambda i: array_to_string(w[i:i+k-1], ' '))) AS s FROM w, k),
b AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) + 2 - k), lambda i: array_to_string(w[i:i+k-1], ' '))) AS s FROM (SELECT *, least(len(w), 5) AS k FROM v) q WHERE k > 0),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item
"""
