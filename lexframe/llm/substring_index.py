"""Substring dedup over a log-structured fingerprint index.

Of the hashes of all 20-word windows of a text, winnowing keeps the least of each 31 neighbours, so every
50-word window has one anchor among them, and equal 50-word windows have equal anchors. The index holds
immutable runs, bucketed and sorted by hash:

* anchor runs: hash, first and last document that had it;
* window runs: digests (96 bits over the words) of the 50-word windows of shared anchors, first document.

A batch is merge-joined with the anchor runs. For anchors that the index or the batch has already, the 50-word
windows are digested and merge-joined with the window runs: that verifies a candidate on its whole window. When an
anchor is met the second time, its first document's windows are fetched from its text; later ones find them in a
window run. Runs of a level are compacted into one of the next level when there are `fanout` of them, and deleted.

The runs of an index lie in one folder with a manifest, so a later session can open it and add the next batch. The
manifest is written when a batch is done: a job that is lost leaves the index as it was.

Hashes are pre-aggregated before every shuffle to one row each, so one passage in a third of all rows is one
row of a run; what is joined row by row is split by the engine's skew join. No pair of documents is made.

Defined cases: a null text is an empty one; a row with a null doc_id keeps all words and counts for nobody;
rows of one doc_id do not count against each other; fewer than 50 words make no window; very long texts are taken
whole; ids are of any type that has an order; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import columns, cut, map_docs, remove, shared_dir, sized, window_hashes, word_hashes

WIDTH, ANCHOR = 50, 20
#: Neighbouring anchors' places within one window.
SPAN = WIDTH - ANCHOR + 1
#: Places that are winnowed at once, so that long texts need no more memory.
SEGMENT = 1 << 15
_SECOND = np.random.default_rng(20240301).integers(0, 2**63, WIDTH, np.int64).astype(np.uint64) | np.uint64(1)
FEATURES = columns("n_words bigint, all_sha256 string, h array<bigint>")
WINDOWS = columns("th bigint, a array<bigint>, b array<int>, start array<int>")
RESULT = columns("th bigint, n_removed bigint, kept_sha256 string")
MANIFEST = "version bigint, kind string, level int, name string, buckets int, fanout int, id_type string"
#: Ids that are drawn to cut the documents into batches of about equal numbers.
DRAWN = 1000


def winnowed(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 50-word window the place of its anchor, and the anchor hashes by place."""
    g = window_hashes(h, ANCHOR)
    n = len(h) - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.int64), g
    at = [np.lib.stride_tricks.sliding_window_view(g[s : min(s + SEGMENT, n) + SPAN - 1], SPAN).argmin(axis=1) + np.arange(s, min(s + SEGMENT, n)) for s in range(0, n, SEGMENT)]
    return np.concatenate(at), g


def _features(raw: bytes) -> list[tuple]:
    words = raw.split()
    at, g = winnowed(word_hashes(words)) if len(words) >= WIDTH else (np.empty(0, np.int64), np.empty(0, np.uint64))
    return [(len(words), hashlib.sha256(b" ".join(words)).hexdigest(), np.unique(g[np.unique(at)]).view(np.int64))]


def digests(raw: bytes, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, start) of the 50-word windows whose anchor is wanted: 64 and 32 bits over the words."""
    h = word_hashes(raw.split())
    at, g = winnowed(h)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
    start = np.flatnonzero(np.isin(g[at], wanted))
    a, b = np.empty(len(start), np.uint64), np.empty(len(start), np.uint64)
    for s in range(0, len(start), SEGMENT):
        own = start[s : s + SEGMENT]
        a[s : s + SEGMENT] = window_hashes(h[own[0] : own[-1] + WIDTH], WIDTH)[own - own[0]]
        total = np.zeros(len(own), np.uint64)
        for k in range(WIDTH):
            total += (h[own + k] ^ np.uint64(0x9E3779B97F4A7C15)) * _SECOND[k]
        b[s : s + SEGMENT] = total >> np.uint64(32)
    return a.view(np.int64), b.astype(np.uint32).view(np.int32), start.astype(np.int32)


def _with_id(schema: T.StructType, rows: DataFrame) -> T.StructType:
    return T.StructType([rows.schema["doc_id"], *schema.fields])


def windows_of(rows: DataFrame) -> DataFrame:
    """From doc_id, th, hs (wanted anchors) and text a row of arrays for each document: WINDOWS."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = _with_id(WINDOWS, rows)
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths, texts = batch.column(0).cast(schema.field(0).type), batch.column(1), batch.column(3).cast(pa.binary())
            for at in range(0, batch.num_rows, 100):
                n = min(100, batch.num_rows - at)
                found = [digests(texts[i].as_py() or b"", batch.column(2)[i].values.to_numpy(zero_copy_only=False).view(np.uint64)) for i in range(at, at + n)]
                made = [pa.array([x[k] for x in found], schema.field(k + 2).type) for k in range(3)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, n), ths.slice(at, n), *made], schema=schema)

    return rows.select("doc_id", "th", "hs", "text").mapInArrow(run, out)


def left_of(rows: DataFrame) -> DataFrame:
    """From doc_id, th, starts (of windows to remove) and text what is left of each document: RESULT."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = _with_id(RESULT, rows)
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas = [], []
            for i in range(batch.num_rows):
                words = (batch.column(3)[i].as_py() or "").encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                starts = np.unique(batch.column(2)[i].values.to_numpy(zero_copy_only=False))
                edge[starts] += 1
                edge[starts + WIDTH] -= 1
                covered = np.cumsum(edge)[:-1] > 0
                removed.append(int(covered.sum()))
                shas.append(hashlib.sha256(b" ".join(w for w, gone in zip(words, covered.tolist(), strict=True) if not gone)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema.field(0).type), batch.column(1), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], schema=schema)

    return rows.select("doc_id", "th", "starts", "text").mapInArrow(run, out)


class FingerprintIndex:
    """Runs of anchors and windows, by level, in the folder `root`. `add` judges a batch against all documents added
    before and those of the batch with a smaller doc_id; batches must come in the order of doc_id."""

    KEYS = {"anchors": {"h": "bigint"}, "windows": {"a": "bigint", "b": "int"}}

    def __init__(self, spark: SparkSession, root: str, buckets: int, fanout: int, version: int, id_type: str, runs: dict[str, list[list[str]]]) -> None:
        self.spark, self.root, self.buckets, self.fanout, self.version, self.id_type, self.runs = spark, root, buckets, fanout, version, id_type, runs
        self.gone: list[str] = []

    @classmethod
    def create(cls, spark: SparkSession, root: str | None = None, fanout: int = 2, buckets: int | None = None) -> FingerprintIndex:
        """An empty index, in a folder of its own unless one is named. The number of buckets is the index's own."""
        index = cls(spark, root or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), fanout, -1, "", {k: [[]] for k in cls.KEYS})
        index._commit()
        return index

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> FingerprintIndex:
        """The index as the last finished batch left it."""
        manifest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
        rows = manifest.join(F.broadcast(manifest.agg(F.max("version").alias("version"))), "version").collect()  # a row for each run
        head = next(r for r in rows if r.kind == "index")
        runs = {k: [sorted(r.name for r in rows if r.kind == k and r.level == n) for n in range(1 + max((r.level for r in rows if r.kind == k), default=0))] for k in cls.KEYS}
        index = cls(spark, root, head.buckets, head.fanout, head.version, head.id_type, runs)
        for kind, levels in runs.items():
            for name in (x for level in levels for x in level):
                index._attach(kind, name)
        return index

    def _attach(self, kind: str, name: str) -> None:
        keys = ", ".join(self.KEYS[kind])
        fields = ", ".join(f"`{c}` {t}" for c, t in {**self.KEYS[kind], "first": self.id_type, "last": self.id_type}.items())
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({fields}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{name}'")

    def _commit(self) -> None:
        """Write the manifest's next version, then delete what it no longer names."""
        self.version += 1
        rows = [("index", 0, "")] + [(kind, n, name) for kind, levels in self.runs.items() for n, level in enumerate(levels) for name in level]
        rows = [(self.version, *r, self.buckets, self.fanout, self.id_type) for r in rows]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").partitionBy("version").parquet(f"{self.root}/manifest")
        for name in self.gone:
            self._delete(name)
        self.gone = []

    def _delete(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, f"{self.root}/{name}")

    def drop(self) -> None:
        """Delete the index, tables and files."""
        for name in (x for levels in self.runs.values() for level in levels for x in level):
            self._delete(name)
        remove(self.spark, self.root)

    def _write(self, kind: str, run: DataFrame) -> str:
        name = f"lexframe_{kind}_{uuid.uuid4().hex}"
        keys = list(self.KEYS[kind])
        run.write.bucketBy(self.buckets, *keys).sortBy(*keys).option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def _push(self, kind: str, name: str) -> None:
        """Add a run; compact a level that is full. The merged run is one row for each hash, like any run."""
        levels, k = self.runs[kind], 0
        levels[0].append(name)
        while len(levels[k]) >= self.fanout:
            rows = self.spark.table(levels[k][0])
            for other in levels[k][1:]:
                rows = rows.unionByName(self.spark.table(other))
            merged = self._write(kind, rows.groupBy(*self.KEYS[kind]).agg(F.min("first").alias("first"), F.max("last").alias("last")))
            self.gone += levels[k]
            levels[k] = []
            k += 1
            if k == len(levels):
                levels.append([])
            levels[k].append(merged)

    def _prior(self, kind: str, name: str) -> DataFrame | None:
        """What the runs so far have of the hashes of a new run: first and last document of each."""
        keys, own = list(self.KEYS[kind]), self.spark.table(name)
        found = [self.spark.table(run).join(own.select(*keys), keys) for level in self.runs[kind] for run in level]
        if not found:
            return None
        rows = found[0]
        for other in found[1:]:
            rows = rows.unionByName(other)
        return rows.groupBy(*keys).agg(F.min("first").alias("p_first"), F.max("last").alias("p_last"))

    def _shared(self, kind: str, name: str) -> DataFrame:
        """Hashes of the new run that more than one document has, counting the runs before."""
        own, prior = self.spark.table(name), self._prior(kind, name)
        if prior is None:
            none = F.lit(None).cast(self.id_type)
            return own.filter("first < last").withColumns({"p_first": none, "p_last": none})
        return own.join(prior, list(self.KEYS[kind]), "left").filter("first < last or p_first is not null")

    def add(self, batch: DataFrame, so_far: DataFrame) -> DataFrame:
        """batch and so_far (all documents to the end of the batch) have doc_id, th and text; of so_far only the texts
        are read whose anchors are met the second time. Returns for each row of the batch doc_id, n_words, n_removed
        and kept_sha256."""
        self.id_type = self.id_type or batch.schema["doc_id"].dataType.simpleString()
        features = cut(map_docs(batch, _features, FEATURES, ["doc_id", "th"]), "features")
        anchors = features.filter("doc_id is not null").select("doc_id", F.explode("h").alias("h"))
        run = self._write("anchors", anchors.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")))
        shared = cut(self._shared("anchors", run), "shared")
        self._push("anchors", run)

        own = anchors.join(shared.select("h"), "h", "left_semi").select("doc_id", "h")
        fetched = shared.filter("p_first = p_last").select(F.col("p_first").alias("doc_id"), "h")  # met once so far
        wanted = cut(own.unionByName(fetched).groupBy("doc_id").agg(F.collect_list("h").alias("hs")), "wanted")
        texts = so_far.join(sized(wanted.select("doc_id")), "doc_id", "left_semi").select("doc_id", "th", "text")
        packed = cut(windows_of(texts.join(wanted, "doc_id")), "windows")

        # hashes go before places: one row for each window
        windows = packed.select("doc_id", "th", F.explode(F.arrays_zip("a", "b", "start")).alias("x")).select("doc_id", "th", "x.a", "x.b", "x.start")
        run = self._write("windows", windows.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")))
        firsts = self._shared("windows", run).select("a", "b", F.least("first", F.coalesce("p_first", "first")).alias("first"))
        firsts = cut(firsts, "firsts")
        self._push("windows", run)
        self._commit()

        removed = windows.join(firsts, ["a", "b"]).filter("first < doc_id").groupBy("doc_id", "th").agg(F.collect_list("start").alias("starts"))
        removed = cut(removed, "removed")
        old = batch.join(sized(removed.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "th", "text")
        left = left_of(old.join(removed, ["doc_id", "th"])).dropDuplicates(["doc_id", "th"])
        return cut(
            features.drop("h")
            .join(left, ["doc_id", "th"], "left")
            .select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256")),
            "kept",
        )


def dedup_substrings(docs: DataFrame, batches: int = 3, fanout: int = 2) -> DataFrame:
    """All documents, in `batches` batches of about equal numbers by doc_id, through one index, which goes afterwards."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    drawn = rows.select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(DRAWN).collect() if batches > 1 else []
    drawn = sorted(r.doc_id for r in drawn)
    ends = sorted({drawn[len(drawn) * k // batches - 1] for k in range(1, batches) if len(drawn) * k >= batches})
    index, out = FingerprintIndex.create(rows.sparkSession, fanout=fanout), None
    for k in range(len(ends) + 1):
        upto = F.col("doc_id") <= F.lit(ends[k]) if k < len(ends) else F.lit(True)
        after = F.col("doc_id") > F.lit(ends[k - 1]) if k else F.lit(True)
        last = k == len(ends)
        batch = rows.filter((upto & after) | F.col("doc_id").isNull() if last and k else upto & after)
        part = index.add(batch, rows.filter(upto))
        out = part if out is None else out.unionByName(part)
    index.drop()
    return out


#: The same rows in DuckDB.
SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM w),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS s FROM g),
f AS (SELECT s, min(doc_id) AS first FROM x GROUP BY s),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM x JOIN f USING (s) WHERE first < doc_id),
p AS (SELECT doc_id, list(k) AS gone FROM r GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(coalesce(gone, []), k)), lambda k: w[k]), ' ')) AS kept_sha256
FROM w LEFT JOIN p USING (doc_id)
"""
