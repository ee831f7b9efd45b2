"""Line dedup by a log-template tree of fixed depth.

A line's path in the tree is its number of tokens and its leading tokens (three, or what it has); tokens with
digits are variable fields (`<*>`). Below a leaf, a token stays if at least `min_docs` lines have it at that place,
and is a variable field otherwise; what results is the line's template. A template of at least `min_docs` documents,
of which half the tokens or more are constant, recurs: its lines are dropped. With `keep_first` those of the first
document (smallest doc_id) that has it stay, so a group of copies is not emptied as a whole.

The tree is a sequence of aggregations over hashes of lines, one row for each distinct line of a document, and
only lines below leaves with lines enough go further. Counts are pre-aggregated; a line in a third of all
documents is one row below its leaf.

Defined cases: a null text is an empty one and stays null; lines without a token stay; very long texts are taken
whole; a null doc_id counts for no document and is never the first; rows of one doc_id count as one document, each
with its own lines; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import columns, cut, map_docs, sized, unused

#: Documents from which a template recurs; leading tokens of a path; share of constants.
MIN_DOCS, DEPTH, CONSTANT = 10, 3, 0.5
VARIABLE = b"<*>"
DIGIT = re.compile(rb"[0-9]")
HASHES = columns("leaf bigint, line bigint")
SPELLED = columns("leaf bigint, line bigint, tokens array<string>")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masked(line: bytes) -> list[bytes]:
    tokens = line.split()
    return [VARIABLE if DIGIT.search(t) else t for t in tokens] if DIGIT.search(line) else tokens


def hashes(tokens: list[bytes]) -> tuple[int, int]:
    """The hashes of the path and of the whole masked line."""
    n = b"%d " % len(tokens)
    return signed(xxhash.xxh64_intdigest(n + b" ".join(tokens[:DEPTH]))), signed(xxhash.xxh64_intdigest(n + b" ".join(tokens)))


def _lines(raw: bytes) -> list[tuple[int, int]]:
    return list({hashes(t) for x in set(raw.split(b"\n")) if (t := masked(x))})


def _spelled(raw: bytes) -> list[tuple[int, int, list[str]]]:
    found = {hashes(t): t for x in set(raw.split(b"\n")) if (t := masked(x))}
    return [(*k, [x.decode() for x in t]) for k, t in found.items()]


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, constant: float = CONSTANT, keep_first: bool = False) -> DataFrame:
    """(doc_id, th, line): hashes of the lines to drop of each document."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    lines = cut(map_docs(rows, _lines, HASHES, ["doc_id", "th"]), "lines")
    distinct = lines.groupBy("leaf", "line").agg(F.count_distinct("doc_id").alias("n"))
    distinct = cut(distinct, "distinct")
    leaves = distinct.groupBy("leaf").agg(F.sum("n").alias("all")).filter(F.col("all") >= min_docs).select("leaf")
    below = cut(distinct.join(sized(cut(leaves, "leaves")), "leaf", "left_semi"), "below")

    # the tokens of each distinct line below such leaves, from any document that has it
    some = lines.join(sized(below.select("leaf", "line")), ["leaf", "line"], "left_semi").groupBy("leaf", "line").agg(F.max("th").alias("th"))
    some = cut(some, "some")
    holders = rows.join(sized(some.select("th").distinct()), "th", "left_semi").dropDuplicates(["th"])
    tokens = map_docs(holders, _spelled, SPELLED, ["th"]).join(some, ["th", "leaf", "line"], "left_semi").join(below, ["leaf", "line"])
    tokens = cut(tokens.select("leaf", "line", "n", "tokens"), "tokens")
    places = tokens.select("leaf", "line", "n", F.posexplode("tokens").alias("place", "token"))
    often = cut(places.groupBy("leaf", "place", "token").agg(F.sum("n").alias("often")), "often")
    templates = (
        places.join(sized(often), ["leaf", "place", "token"])
        .withColumn("stays", (F.col("often") >= min_docs) & (F.col("token") != VARIABLE.decode()))
        .groupBy("leaf", "line")
        .agg(
            F.array_sort(F.collect_list(F.struct("place", F.when(F.col("stays"), F.col("token")).otherwise(VARIABLE.decode()).alias("t")))).alias("at"),
            F.sum(F.col("stays").cast("int")).alias("constants"),
            F.count("*").alias("length"),
        )
        .filter(F.col("constants") >= constant * F.col("length"))
        .select("leaf", "line", F.xxhash64(F.transform("at", lambda x: x["t"])).alias("template"))
    )
    templates = cut(templates, "templates")
    held = lines.join(sized(templates), ["leaf", "line"]).select("doc_id", "th", "leaf", "template", "line")
    held = cut(held, "held")
    holders = held.select("leaf", "template", "doc_id").distinct()  # counted in two steps: a hot template is spread over its documents
    first = holders.groupBy("leaf", "template").agg(F.count("doc_id").alias("docs"), F.min("doc_id").alias("first")).filter(F.col("docs") >= min_docs)
    drops = held.join(sized(cut(first, "first")), ["leaf", "template"])
    if keep_first:
        drops = drops.filter(~F.col("first").eqNullSafe(F.col("doc_id")))
    return drops.select("doc_id", "th", "line")


def drop_recurring(docs: DataFrame, **options: float) -> DataFrame:
    """docs with text left of recurring lines, and the columns n_lines and n_dropped (lines with a token)."""
    docs = docs.drop("n_lines", "n_dropped")
    lines, own, id_, th = unused(docs, "_gone", "_th", "_id", "_t")
    gone = cut(recurring(docs, **options).groupBy("doc_id", "th").agg(F.collect_set("line").alias("lines")), "gone")
    gone = gone.select(F.col("doc_id").alias(id_), F.col("th").alias(th), F.col("lines").alias(lines))
    joined = docs.withColumn(own, F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(th)), "left")
    others = [c for c in docs.columns if c != "text"]
    out = T.StructType([*(docs.schema[c] for c in others), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, drops = [], [], []
            for raw, gone in zip(batch.column(len(others)).to_pylist(), batch.column(len(others) + 1).to_pylist(), strict=True):
                all_lines = (raw or "").encode().split(b"\n")
                kept, gone, with_token = [], set(gone or ()), 0
                for x in all_lines:
                    with_token += bool(x.split(None, 1))
                    if not gone or not (t := masked(x)) or hashes(t)[1] not in gone:
                        kept.append(x)
                texts.append(None if raw is None else b"\n".join(kept).decode())
                counts.append(with_token)
                drops.append(len(all_lines) - len(kept))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(others))), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(drops, pa.int64())], names=out.names)

    return joined.select(*others, "text", lines).mapInArrow(run, out)


def dropped(docs: DataFrame, **options: float) -> DataFrame:
    """docs with text left of recurring lines; n_chars, if there is one, is that of what is left. A text that has
    lost all its lines goes with its row; texts that were empty before stay. The option keep_first is for a later
    stage that looks for copies: it finds one whole text of each group."""
    left = drop_recurring(docs, **options)
    left = left.filter((F.col("n_dropped") == 0) | F.col("text").rlike("[^ \\t-\\r]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return left.select(docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of what is left of each document."""
    return drop_recurring(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The same rows in DuckDB.
SQL = r"""
WITH l AS (
  SELECT doc_id, n, line, list_transform(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t
  FROM (SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
d AS (SELECT DISTINCT doc_id, t, t[1:3] AS lead, len(t) AS k FROM l WHERE len(t) > 0),
c AS (SELECT lead, k, t, count(DISTINCT doc_id) AS n FROM d GROUP BY ALL),
p AS (SELECT lead, k, t, n, unnest(t) AS w, unnest(range(k)) AS i FROM c),
o AS (SELECT lead, k, i, w, sum(n) AS often FROM p GROUP BY ALL),
m AS (SELECT lead, k, t, list(CASE WHEN often >= 10 THEN w ELSE '<*>' END ORDER BY i) AS template, count(*) FILTER (often >= 10 AND w <> '<*>') AS constants
      FROM p JOIN o USING (lead, k, i, w) GROUP BY ALL),
h AS (SELECT doc_id, t, lead, k, template FROM d JOIN m USING (lead, k, t) WHERE constants >= 0.5 * k),
f AS (SELECT lead, k, template FROM h GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
g AS (SELECT DISTINCT doc_id, t FROM h JOIN f USING (lead, k, template))
SELECT l.doc_id, count(*) FILTER (len(l.t) > 0)::BIGINT AS n_lines, count(g.t)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.n) FILTER (g.t IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.t = g.t GROUP BY l.doc_id
"""
