"""What the corpus operators share: tables in the shared folder, sized broadcasts, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: A side of a join is broadcast only when it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 200_000
#: Words a shingle has, and the similarity from which texts count as near copies.
SHINGLE_WORDS, SIMILARITY = 5, 0.8

_own_dir: dict[str, str] = {}
_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "binary": T.BinaryType()}


def columns(text: str) -> T.StructType:
    """A schema from "name type, name type", without a session; types are those of _TYPES and arrays of them."""
    pairs = (x.split() for x in text.split(","))
    return T.StructType([T.StructField(n, T.ArrayType(_TYPES[t[6:-1]]) if t.startswith("array<") else _TYPES[t]) for n, t in pairs])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as keep it apart from the columns of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a folder of our own only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="lexframe-")
    return _own_dir[app]


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends here, and a lost
    executor costs a reread, not the work before it."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count of its rows allows that, else as it is (a shuffled join)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def map_docs(df: DataFrame, of_text: Callable, schema: T.StructType, keep: list[str], text: str = "text") -> DataFrame:
    """mapInArrow with of_text(utf-8 bytes) -> list of tuples, one output row for each; the columns in
    keep go before them. A null text counts as empty. Output goes out in pieces of bounded size."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([*(df.schema[k] for k in keep), *schema.fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows, source = [], []
                for i, raw in enumerate(part.column(len(keep)).cast(pa.binary()).to_pylist()):
                    found = of_text(raw or b"")
                    rows += found
                    source += [i] * len(found)
                if not rows:
                    continue
                kept = [part.column(k).take(pa.array(source, pa.int64())).cast(arrow.field(k).type) for k in range(len(keep))]
                made = [pa.array(c, arrow.field(len(keep) + k).type) for k, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([*kept, *made], schema=arrow)

    return df.select(*keep, text).mapInArrow(run, out)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


#: Odd multipliers, one for each place of a window; from a fixed seed, the same on every machine.
_PLACES = np.random.default_rng(20240229).integers(0, 2**63, 64, np.int64).astype(np.uint64) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width consecutive words, from the words' hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += h[k : k + n] * _PLACES[k]
    return mixed(total)


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the shingles of five words; fewer words make one shingle, none make none."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(SHINGLE_WORDS, len(words))))
