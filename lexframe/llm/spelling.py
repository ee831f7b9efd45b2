"""Spelling variants: words that differ by one letter, and the frequent word that each stands for.

Pairs are found by merging the errata of a trie. A node's heavy child is the one with most words below; every edge to
another child, and a word's end, is light, so no word has more than log2(words) light edges. Two words at one edit part
at exactly one node, and at least one of them leaves it by a light edge. So it is enough to merge what hangs on light
edges, with the letter skipped or replaced, into the rest (small to large), and to see which ends coincide:

* the letter skipped: the word without it;
* the letter replaced by the heavy child's: that word;
* the heavy child's letter put before it: that word;
* the letter replaced by another light one: words that are alike but for it.

The first three are looked up among the words, the last are groups of as many words as there are letters at most. Each
pair comes up once. Nodes are hashes of prefixes, so a very long word costs its length; which child is called heavy does
not touch the result, so neither does a collision.

Words are counted map-side, once for each document. Which word stands for which is a forest, since counts grow along it;
its roots are found by doubling.

Defined cases: a null text has no words; in a row with a null doc_id no letter is deleted; rows that repeat a doc_id count
as they are; very long texts are taken whole, in pieces that end between words; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import columns, cut, sized

#: Code points and occurrences that a word has at least; how much more frequent its form is.
LEAST_POINTS, LEAST_COUNT, RATIO = 6, 5, 5
#: One in so many distinct words of a document loses a letter.
SLIPS = 199
#: Code points of a text that are searched at once; words that are counted before they go on.
PIECE, HELD = 1 << 20, 200_000
WORD = re.compile("[a-zÀ-ÿ]+")
END = re.compile("[^a-zÀ-ÿ]")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
COUNTS = columns("word string, n bigint")
NODES = columns("id bigint, place int, node bigint, letter string")
_MODULUS, _BASE = (1 << 61) - 1, 1_000_003


def runs(raw: bytes) -> Counter[str]:
    """The maximal runs of letters, A to Z in lower case, and how often each occurs."""
    text, at, found = raw.translate(_LOWER).decode(), 0, Counter()
    while at < len(text):
        end = END.search(text, at + PIECE)
        stop = end.start() if end else len(text)
        found.update(WORD.findall(text, at, stop))
        at = stop
    return found


def slipped(doc_id: object, run: str) -> str:
    """The run, or what is left of it when the document's slip takes a letter."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % SLIPS:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    held: Counter[str] = Counter()
    for batch in batches:
        for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            for run, n in runs(raw or b"").items():
                if len(run) >= LEAST_POINTS and len(word := run if doc_id is None else slipped(doc_id, run)) >= LEAST_POINTS:
                    held[word] += n
            if len(held) >= HELD:
                yield out(held)
                held.clear()
    if held:
        yield out(held)


def words(docs: DataFrame) -> DataFrame:
    """word, n: the words that are long and frequent enough."""
    counts = docs.select("doc_id", "text").mapInArrow(_count, COUNTS)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each node on a word's path: the letter that follows, empty at the end."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(NODES)
    for batch in batches:
        made: list[list] = [[], [], [], []]
        for id_, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = 1
            for place, letter in enumerate([*word, ""]):
                for column, x in zip(made, (id_, place, h, letter), strict=True):
                    column.append(x)
                h = (h * _BASE + ord(letter)) % _MODULUS if letter else h
            if len(made[0]) >= HELD:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, schema, strict=True)], schema=schema)
                made = [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, schema, strict=True)], schema=schema)


def light_edges(vocabulary: DataFrame) -> DataFrame:
    """word, n, place, letter, heavy: where each word leaves the heavy path, and the letter that the path goes on with."""
    nodes = cut(vocabulary.select(F.xxhash64("word").alias("id"), "word").mapInArrow(_nodes, NODES), "nodes")
    below = cut(nodes.groupBy("node", "letter").agg(F.count("*").alias("words")), "below")
    heavy = below.groupBy("node").agg(F.max_by("letter", F.when(F.col("letter") != "", F.struct("words", "letter"))).alias("heavy"), F.count("*").alias("children"))
    heavy = cut(heavy.filter("children > 1").select("node", "heavy"), "heavy")
    edges = cut(nodes.join(sized(heavy), "node").filter("letter <> heavy").select("id", "place", "letter", "heavy"), "light")
    return vocabulary.withColumn("id", F.xxhash64("word")).join(edges, "id").drop("id")


def best(word: Column | str, n: Column | str) -> Column:
    """Orders near words: the largest count first, then the smallest word."""
    return F.struct((-F.col(n) if isinstance(n, str) else -n).alias("less"), (F.col(word) if isinstance(word, str) else word).alias("form"))


def near(vocabulary: DataFrame) -> DataFrame:
    """word, n_near, best: how many words are at one edit, and the most frequent of them."""
    edges = cut(light_edges(vocabulary), "edges")
    before, after = F.expr("left(word, place)"), F.expr("substring(word, place + 2)")
    letter, heavy = F.col("letter"), F.col("heavy")
    skipped = F.when((letter != "") & ~F.startswith(after, letter), F.concat(before, after))  # of a run, its last letter
    replaced = F.when(letter != "", F.concat(before, heavy, after))
    put_before = F.concat(before, heavy, letter, after)
    asked = edges.select("word", "n", F.explode(F.array_compact(F.array(skipped, replaced, put_before))).alias("other"))
    met = asked.join(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    pairs = met.select(F.explode(F.array(F.struct("word", best("other", "other_n").alias("best")), F.struct(F.col("other").alias("word"), best("word", "n").alias("best")))).alias("x")).select("x.word", F.lit(1).cast("long").alias("k"), "x.best")

    # words that differ in one light letter: each gets the best of the others, and how many these are
    alike = edges.filter(letter != "").groupBy(F.xxhash64(before, after, F.col("place")).alias("_h"), before.alias("before"), after.alias("after")).agg(F.array_sort(F.collect_list(best("word", "n"))).alias("c"))
    alike = alike.filter(F.size("c") > 1).select("c", F.posexplode("c").alias("at", "own"))
    light = alike.select(F.col("own.form").alias("word"), (F.size("c") - 1).cast("long").alias("k"), F.when(F.col("at") == 0, F.get("c", F.lit(1))).otherwise(F.get("c", F.lit(0))).alias("best"))
    return pairs.unionByName(light).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root from (word, form), where forms lead to no cycle: each round doubles the steps."""
    rows = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = rows.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = cut(rows.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not further.filter("moved").limit(1).count():
            return further.select("word", "root")
        rows = further.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form (the near word of the largest count, if that is RATIO times the word's), form_n, root."""
    vocabulary = cut(words(docs), "words")
    known = vocabulary.join(near(vocabulary), "word", "left")
    stands = -F.col("best.less") >= RATIO * F.col("n")
    known = cut(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(stands, F.col("best.form")).alias("form"), F.when(stands, -F.col("best.less")).alias("form_n")), "forms")
    return known.join(roots(known.filter("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))


#: The same rows in DuckDB: the checksum byte by byte, near words by what is left when one letter goes.
SQL = r"""
WITH RECURSIVE b AS (SELECT i::BIGINT AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, k + 1 FROM b WHERE k < 8),
i AS (SELECT i, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, k + 1 FROM i WHERE k < 8),
t AS (SELECT list(c ORDER BY i) AS t FROM i WHERE k = 8),
r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents) q
  WHERE length(run) >= 6 GROUP BY doc_id, run),
x AS (SELECT doc_id, run, n, hex(encode(doc_id::VARCHAR || ':' || run)) AS x FROM r),
h AS (SELECT doc_id, run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda j: ((instr('0123456789ABCDEF', x[j]) - 1) * 16 + instr('0123456789ABCDEF', x[j + 1]) - 1)::BIGINT)),
    lambda c, y: xor(t.t[(xor(c, y) % 256 + 1)::INT], c // 256))) AS h FROM x, t),
s AS (SELECT n, CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS (SELECT DISTINCT word, n, p, left(word, p - 1) || substring(word, p + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM w) q),
e AS (SELECT DISTINCT a, b, b_n FROM (
  SELECT d.word AS a, w.word AS b, w.n AS b_n FROM d JOIN w ON w.word = d.less UNION ALL SELECT w.word, d.word, d.n FROM d JOIN w ON w.word = d.less
  UNION ALL SELECT x.word, y.word, y.n FROM d x JOIN d y ON x.p = y.p AND x.less = y.less AND x.word <> y.word) q),
f AS (SELECT w.word, w.n, m.n_near, CASE WHEN m.b_n >= 5 * w.n THEN m.b END AS form, CASE WHEN m.b_n >= 5 * w.n THEN m.b_n END AS form_n
  FROM w LEFT JOIN (SELECT a, count(*) AS n_near, first(b ORDER BY b_n DESC, b) AS b, max(b_n) AS b_n FROM e GROUP BY a) m ON m.a = w.word),
o AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, o.root FROM f JOIN o ON f.form = o.word)
SELECT f.word, form, o.root, n, coalesce(n_near, 0)::BIGINT AS n_near, form_n FROM f JOIN o ON o.word = f.word
"""
