"""What filters take from each other: for every order of five filters and every part of the corpus, what each step
removes, keeps and would have removed anyway.

Exact duplicates (filter E) are found by partition refinement. Texts are split by code-point length, then by the hashes
of successive blocks, each four times as long as the one before; what is alone in its class is dropped after each
split. The surviving texts are compared as a whole (they are keys of an aggregation) and all but the smallest doc_id of
a text are marked. Then only the counts of the 32 combinations of failed filters go on, and every order is read off
these.

Blocks are hashed once, in the first pass; classes are refined on narrow rows. Texts are read a second time, for what is
left, and collapse map-side, so a text that a third of all rows have is one row of each task.

Defined cases: a null text is an empty one; a null lang is the part ''; a row with a null doc_id is no duplicate and makes
none; rows that repeat a doc_id and text are no duplicates of each other; a document with several labels is good, or
toxic, if any of them says so; very long texts are taken whole, in pieces; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import columns, cut, map_docs, sized

FILTERS = "ABCDE"
#: Limits of A, B (per cent), C (per cent) and the characters of D.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, b"#$%&*|"
#: Bytes of the first block; each has GROWTH times as many as the one before.
BLOCK, GROWTH = 256, 4
#: Bytes of a text whose words are split at once.
PIECE = 1 << 20
_CAPITALS, _CONTINUED = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
FEATURES = columns("mask int, n bigint, blocks array<bigint>")
Hash = Callable[[bytes], int]


def pieces(raw: bytes) -> Iterator[bytes]:
    """The text in pieces that end between words."""
    at = 0
    while at < len(raw):
        end = _SPACE.search(raw, at + PIECE)
        yield raw[at : end.start() if end else len(raw)]
        at = end.start() if end else len(raw)


def failed(raw: bytes) -> int:
    """Which of A to D the text fails, as bits."""
    n, seen = 0, set()
    for piece in pieces(raw):
        words = piece.split()
        n += len(words)
        seen.update(words)
    capitals, points = len(raw) - len(raw.translate(None, _CAPITALS)), len(raw.translate(None, _CONTINUED))
    fails = (n < LEAST_WORDS, 100 * len(seen) < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * points, any(c in raw for c in SYMBOLS))
    return sum(bit << k for k, bit in enumerate(fails))


def blocks(raw: bytes, hashed: Hash) -> list[int]:
    out, at, size = [], 0, BLOCK
    while at < len(raw):
        out.append(hashed(raw[at : at + size]) - (1 << 63))
        at, size = at + size, size * GROWTH
    return out


def described(docs: DataFrame, hashed: Hash, *keep: str) -> DataFrame:
    """doc_id, part and what else is kept, with mask (A to D), code points and block hashes of each text."""

    def features(raw: bytes) -> list[tuple]:
        return [(failed(raw), len(raw.translate(None, _CONTINUED)), blocks(raw, hashed))]

    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return map_docs(rows, features, FEATURES, ["doc_id", "part", *keep])


def split(key: Column, block: Column) -> Column:
    return F.xxhash64(key, block)


def last_key() -> Column:
    """The key that a text has when all its blocks are taken in."""
    return F.aggregate("blocks", F.xxhash64("n"), split)


def refined(rows: DataFrame) -> DataFrame:
    """The rows (n, blocks and others) that are not alone in their class, with the class's key."""
    done, left, k = [], rows.withColumn("key", F.xxhash64("n")), 0
    while True:
        several = cut(left.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key"), "several")
        left = cut(left.join(sized(several), "key", "left_semi"), "left")
        done.append(left.filter(F.size("blocks") <= k))
        left = left.filter(F.size("blocks") > k)
        if not left.limit(1).count():
            break
        left = left.withColumn("key", split(F.col("key"), F.get("blocks", F.lit(k))))
        k += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def mask_counts(docs: DataFrame, labels: DataFrame, hashed: Hash = xxhash.xxh64_intdigest) -> DataFrame:
    """part, mask (bit k: fails the k-th filter), n, good, toxic."""
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias({"quality": "good"}.get(c, c))
    marks = cut(labels.filter("doc_id is not null").groupBy("doc_id").agg(is_one("quality"), is_one("toxic")), "labels")
    marked = lambda rows: rows.join(sized(marks), "doc_id", "left")
    rows = cut(marked(described(docs, hashed)), "described")
    alike = cut(refined(rows.filter("doc_id is not null")), "alike")

    keys = cut(alike.select("key").distinct(), "keys")
    texts = described(docs.filter("doc_id is not null"), hashed, "text").withColumn("key", last_key())
    firsts = texts.join(sized(keys), "key", "left_semi").groupBy("key", "text").agg(F.min("doc_id").alias("first"))
    of_key = cut(cut(firsts.select("key", "first"), "firsts").groupBy("key").agg(F.count("*").alias("texts"), F.min("first").alias("first")), "keys")
    copies = alike.join(sized(of_key.filter("texts = 1").select("key", "first")), "key").filter("doc_id > first").select("part", "mask", "good", "toxic")
    shared = of_key.filter("texts > 1").select("key")  # different texts of one key: told apart by the texts
    if shared.limit(1).count():
        own = texts.join(sized(shared), "key", "left_semi")
        first = own.groupBy("key", "text").agg(F.min("doc_id").alias("first"))
        copies = copies.unionByName(marked(own.join(first, ["key", "text"]).filter("doc_id > first")).select("part", "mask", "good", "toxic"))

    every, again = cut(counted(rows), "counts"), cut(counted(copies), "copies")
    less = again.select("part", "mask", *(F.col(c).alias(f"_{c}") for c in ("n", "good", "toxic")))
    once = every.join(less, ["part", "mask"], "left").select("part", "mask", *((F.col(c) - F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("n", "good", "toxic")))
    return once.unionByName(again.withColumn("mask", F.col("mask") + F.lit(1 << 4)))


def steps(counts: DataFrame) -> DataFrame:
    """part, filter_order, step and what the step does, for all orders, from the counts of a part's masks."""
    of_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c"))  # 32 at most
    orders = of_part.withColumn("filter_order", F.explode(F.lit(["".join(p) for p in itertools.permutations(FILTERS)])))
    rows = orders.withColumn("step", F.explode(F.lit(list(range(1, 6)))))
    place = {f: F.instr("filter_order", f) for f in FILTERS}
    bits = lambda test: sum((F.when(test(place[f]), 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumns({"own": bits(lambda p: p == F.col("step")), "before": bits(lambda p: p < F.col("step"))})

    def total(field: str, test: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.filter("c", lambda x: test(x["mask"])), F.lit(0).cast("long"), lambda a, x: a + x[field])

    own, before = F.col("own"), F.col("before")
    here = lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) == 0)
    rows = rows.select(
        "part", "filter_order", "step", "own",
        total("n", lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")  # 120 rows each


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return steps(cut(mask_counts(docs, labels), "masks"))


#: The same rows in DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)] AS f, coalesce(good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
m AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, f),
k AS (SELECT unnest(range(1, 6)) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT array_to_string(list_transform(o, lambda x: substring('ABCDE', x, 1)), '') AS filter_order, o, k::INT AS step FROM o, k),
p AS (SELECT *, list_transform(o[1:step - 1], lambda x: f[x]) AS earlier, f[o[step]] AS fails FROM s, m),
r AS (SELECT part, filter_order, step, sum(n) FILTER (NOT fails AND NOT list_contains(earlier, true)) AS kept, sum(n) FILTER (fails AND NOT list_contains(earlier, true)) AS removed,
    sum(n) FILTER (fails AND list_contains(earlier, true)) AS redundant, sum(n) FILTER (fails AND len(list_filter(f, lambda x: x)) = 1) AS unique_fails,
    sum(good) FILTER (fails AND NOT list_contains(earlier, true)) AS good_lost, sum(toxic) FILTER (fails AND NOT list_contains(earlier, true)) AS toxic_lost
  FROM p GROUP BY part, filter_order, step)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, sum(coalesce(removed, 0)) OVER (PARTITION BY part, substring(filter_order, step, 1))::BIGINT AS shapley FROM r
"""
