"""N-gram Jaccard join with Bayesian candidate pruning.

Texts with equal sets of five-word shingles are one class member. Members that agree on one of 25 bands of four
MinHash values (a pair at 0.8 is missed with a chance of 2e-6) meet in a tile: a bucket's members are dealt into
blocks, and a tile holds two blocks at most, whatever the bucket's size. In a tile, pairs compare their 100
MinHash values 20 at a time and are dropped when the posterior chance (uniform prior) of a similarity of the
threshold falls below `TOLERANCE`; a pair is looked at only in the first band that it shares. Tiles that have
pairs left get the shingle sets and verify them exactly.

Pairs stay inside tiles. What leaves a tile is a number of links for each member and a spanning forest; the
forest's edges are joined to classes by large-star and small-star steps, which aggregate minima and never
collect a neighbourhood.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Defined cases: null and empty texts
have no words, so no links, and are each a class of their own; fewer than five words make one shingle; a null
doc_id has links, and its class has the least id that is not null; rows of one doc_id are rows like any other
(two with equal texts count as each other's copy); other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import SIMILARITY, columns, cut, map_docs, shingle_set, sized, unused

BANDS, ROWS = 25, 4
HASHES, STEP = BANDS * ROWS, 20
TOLERANCE = 1e-6
#: Members of a block, about.
BLOCK = 128
#: Shingles that are hashed at once, so that long texts need no more memory.
SEGMENT = 1 << 12
_MULTIPLIERS = np.random.default_rng(20240401).integers(0, 2**63, HASHES, np.int64).astype(np.uint64) | np.uint64(1)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
FEATURES = columns("key binary, bands array<bigint>")
SETS = columns("sig binary, shingles binary")
PRUNED = columns("tile bigint, key binary, no int, partners array<int>")
VERIFIED = columns("key binary, docs bigint, root binary")


def shingles(raw: bytes) -> np.ndarray:
    return shingle_set(raw.translate(_LOWER).split())


def signature(s: np.ndarray) -> np.ndarray:
    """100 MinHash values of a set that is not empty."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), SEGMENT):
        piece = s[at : at + SEGMENT]
        for k in range(HASHES):
            out[k] = min(out[k], (piece * _MULTIPLIERS[k] >> np.uint64(32)).min())
    return out


def _features(raw: bytes) -> list[tuple]:
    s = shingles(raw)
    if not len(s):
        return [(None, None)]
    bands = signature(s).reshape(BANDS, ROWS)
    return [(xxhash.xxh3_128_digest(s.tobytes()), [xxhash.xxh64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(bands)])]


def _sets(raw: bytes) -> list[tuple]:
    s = shingles(raw)
    return [(signature(s).tobytes(), s.tobytes())]


@functools.cache
def needed(n: int, threshold: float) -> int:
    """Equal values of n from which the posterior chance of a similarity of the threshold is over TOLERANCE.
    With a uniform prior it is the chance of at most m successes in n + 1 trials of that probability."""
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= TOLERANCE:
            return m
    return n


def survivors(sigs: np.ndarray, block: np.ndarray, across: bool, band: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y), as places in a tile, that share this band first and pass the pruning. A tile of two
    blocks pairs them across (one may have no members), a tile of one its members with each other."""
    if across:
        low = block == block.min()
        x, y = (a.ravel() for a in np.meshgrid(np.flatnonzero(low), np.flatnonzero(~low), indexing="ij"))
    else:
        x, y = np.triu_indices(len(block), 1)
    for k in range(0, band):  # not met in a band before
        own = slice(k * ROWS, (k + 1) * ROWS)
        fresh = (sigs[x, own] != sigs[y, own]).any(axis=1)
        x, y = x[fresh], y[fresh]
    same = np.zeros(len(x), np.int64)
    for n in range(STEP, HASHES + 1, STEP):
        same += (sigs[x, n - STEP : n] == sigs[y, n - STEP : n]).sum(axis=1)
        alive = same >= needed(n, threshold)
        x, y, same = x[alive], y[alive], same[alive]
    return x, y


def _pruner(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(PRUNED)
        for batch in batches:
            for tile, band, across, members in zip(*(batch.column(k) for k in range(4)), strict=True):
                rows = members.values
                sigs = np.frombuffer(b"".join(rows.field("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
                x, y = survivors(sigs, rows.field("block").to_numpy(), across.as_py(), band.as_py(), threshold)
                if not len(x):
                    continue
                order = np.argsort(x, kind="stable")
                x, y = x[order], y[order]
                seen = np.unique(np.concatenate([x, y]))
                number = np.full(len(sigs), -1)
                number[seen] = np.arange(len(seen))
                at = np.searchsorted(x, seen), np.searchsorted(x, seen, "right")
                partners = pa.ListArray.from_arrays(pa.array(np.append(at[0], at[1][-1]), pa.int32()), pa.array(number[y], pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([tile.as_py()] * len(seen), pa.int64()), rows.field("key").take(pa.array(seen)), pa.array(range(len(seen)), pa.int32()), partners], schema=schema)

    return run


def _verifier(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(VERIFIED)
        for batch in batches:
            for members in batch.column(0):
                rows = members.values.take(pa.array(np.argsort(members.values.field("no").to_numpy())))
                keys, copies = rows.field("key").to_pylist(), rows.field("copies").to_numpy()
                sets = [np.frombuffer(s, np.uint64) for s in rows.field("shingles").to_pylist()]
                docs, root = np.zeros(len(keys), np.int64), list(range(len(keys)))

                def top(a: int, root: list[int] = root) -> int:
                    while root[a] != a:
                        root[a] = a = root[root[a]]
                    return a

                for a, partners in enumerate(rows.field("partners").to_pylist()):
                    for b in partners:
                        small, large = sorted((sets[a], sets[b]), key=len)
                        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                        both = int((large[at] == small).sum())
                        if both >= threshold * (len(small) + len(large) - both) - 1e-9:
                            docs[a] += copies[b]
                            docs[b] += copies[a]
                            p, q = top(a), top(b)
                            root[max(p, q)] = min(p, q)
                linked = np.flatnonzero(docs).tolist()
                if linked:
                    yield pa.RecordBatch.from_arrays([pa.array([keys[a] for a in linked], pa.binary()), pa.array(docs[linked], pa.int64()), pa.array([keys[top(a)] for a in linked], pa.binary())], schema=schema)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(key, label): the least key of the component of each key in the edges (a, b), by large-star and small-star."""
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))  # a: node, b: neighbour
        # minima are written before they are joined, so that the join's shuffles can be split at a hot centre
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a")), "least")
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        large = cut(large, "large")
        least = cut(large.groupBy("b").agg(F.min("a").alias("m")), "least")  # small star: from a node to its smaller neighbours
        joined = large.join(least, "b")
        small = joined.filter("a > m").select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(joined.select(F.col("m").alias("x"), F.col("b").alias("y")))
        edges = cut(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == tuple(now):
            return edges.select(F.col("b").alias("key"), F.col("a").alias("label"))
        state = tuple(now)


def classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, th, class_id, n_links) for each row: th is the text's hash, class_id the least doc_id of the
    connected class, n_links the number of other rows at the threshold or over, copies too."""
    return _labelled(docs, threshold).select("doc_id", "th", "class_id", "n_links")


def _labelled(docs: DataFrame, threshold: float) -> DataFrame:
    """What `classes` gives, with the label of the class, null for texts without words."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    features = cut(map_docs(rows, _features, FEATURES, ["doc_id", "th"]), "features")
    texts = features.filter("key is not null").groupBy("key").agg(F.count("*").alias("copies"), F.max("th").alias("th"))
    texts = cut(texts, "texts")
    # a text's bands are a function of its set, so any row of it will do
    bands = features.join(texts.select("key", "th").withColumnRenamed("th", "_th"), (F.col("th") == F.col("_th")) & features["key"].eqNullSafe(texts["key"])).select(features["key"], "bands").dropDuplicates(["key"])
    buckets = bands.select("key", F.posexplode("bands").alias("band", "value"))
    counts = cut(buckets.groupBy("band", "value").agg(F.count("*").alias("m")).filter("m > 1"), "buckets")
    n_blocks = F.ceil(F.col("m") / BLOCK)
    members = buckets.join(sized(counts), ["band", "value"]).withColumns({"n_blocks": n_blocks, "block": F.pmod(F.xxhash64("key", "value"), n_blocks)})
    tiles = members.select("key", "band", "value", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("other"))
    tiles = cut(tiles.select("key", "band", "block", (F.col("block") != F.col("other")).alias("across"), F.xxhash64("band", "value", F.least("block", "other"), F.greatest("block", "other")).alias("tile")), "tiles")

    ids = cut(tiles.select("key").distinct().join(texts, "key"), "ids")
    holders = rows.join(sized(ids.select("th")), "th", "left_semi").dropDuplicates(["th"]).join(ids, "th").select("key", "copies", "text")
    sets = cut(map_docs(holders, _sets, SETS, ["key", "copies"]), "sets")
    packed = tiles.join(sets.select("key", "sig"), "key").groupBy("tile", "band", "across").agg(F.collect_list(F.struct("key", "block", "sig")).alias("members")).filter(F.size("members") > 1)
    pruned = cut(packed.mapInArrow(_pruner(threshold), PRUNED), "pruned")
    packed = pruned.join(sets.select("key", "copies", "shingles"), "key").groupBy("tile").agg(F.collect_list(F.struct("key", "no", "partners", "copies", "shingles")).alias("members"))
    verified = cut(packed.select("members").mapInArrow(_verifier(threshold), VERIFIED), "verified")

    label = components(verified.select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("key").agg(F.sum("docs").alias("docs"))
    known = cut(texts.select("key", "copies").join(links, "key", "left").join(label, "key", "left").select("key", F.coalesce("label", "key").alias("label"), (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "known")
    of_row = cut(features.select("doc_id", "th", "key").join(known, "key").select("doc_id", "th", "label", "n_links"), "rows")
    least = cut(of_row.groupBy("label").agg(F.min("doc_id").alias("class_id")), "least")
    found = of_row.join(least, "label").select("doc_id", "th", "label", "class_id", "n_links")
    return found.unionByName(features.filter("key is null").select("doc_id", "th", F.col("key").alias("label"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The documents with one row of each class: that of the least (doc_id, hash of the text), a null doc_id last.
    Columns as they are. Texts without words all stay. Of rows with that id and equal texts one stays."""
    found = cut(_labelled(docs, threshold), "classes")
    same = found.filter("label is not null").groupBy("label", "doc_id", "th").agg(F.count("*").alias("n"))
    first = same.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "n")).alias("x")).select("x.doc_id", "x.th", (F.col("x.n") > 1).alias("many"))
    wordless = found.filter("label is null").select("doc_id", "th", F.lit(False).alias("many")).distinct()
    columns, (own, id_, th, many) = docs.columns, unused(docs, "_th", "_id", "_t", "_many")
    winners = cut(first.unionByName(wordless).select(F.col("doc_id").alias(id_), F.col("th").alias(th), F.col("many").alias(many)), "winners")
    marked = docs.withColumn(own, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(th))
    single = marked.join(winners.filter(~F.col(many)), same, "left_semi").select(columns)
    several = marked.join(winners.filter(F.col(many)), same, "left_semi").dropDuplicates(["doc_id", own]).select(columns)
    return single.unionByName(several)


#: doc_id, class_id and n_links in DuckDB, by all pairs.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, least(w.doc_id, coalesce(m.least, w.doc_id)) AS class_id, coalesce(k.n, 0)::BIGINT AS n_links
FROM w LEFT JOIN (SELECT a, min(b) AS least FROM r GROUP BY a) m ON m.a = w.doc_id
LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = w.doc_id
"""
