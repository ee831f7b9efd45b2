"""Near copies among embeddings by Euclidean p-stable hashing, and exact cosines.

Vectors of one label are normalised; TABLES tables hash each by K Gaussian projections, cut into cells of WIDTH. Two
unit vectors at the cosine in question are a known distance apart, so the chance that they share no table follows from
both numbers: K keeps unrelated vectors apart for the number of vectors there is, and the tables are as many as make
that chance MISSED at most (at the limit itself; nearer vectors are missed far less).

Exact copies are one member. Buckets with one member go. In the others, members are compared on sketches (64 more
projections, a byte each), which only says who must be compared exactly, and what is near is joined to groups. Then all
vectors of a group are compared exactly, once each: a pair that no table holds counts too, if the group has both. Large
buckets and groups are dealt in blocks, and each tile of two blocks gives a row for each member, not for each pair: its
links and the tile's component.

Defined cases: a null vec_id or label, a null, empty or zero vector and one with a null or non-finite component link with
nothing; vectors of different lengths do not link; rows that repeat a vec_id are vectors of their own; of a row with a
null vec_id the component is null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import columns, cut, sized
from .jaccard_join import components

COSINE = 0.93
#: Width of a cell, in units of a normalised vector; the chance to miss a pair at the limit.
WIDTH, MISSED = 2.0, 1e-3
#: Bytes of a sketch, and what one step of it is worth.
SKETCH, UNIT = 64, 1 / 24
#: Members of a block: of sketches, of vectors. Rows of a block that are compared at once.
SKETCHES, VECTORS, CHUNK = 512, 2048, 256
HASHED = columns("key binary, sketch binary, buckets array<bigint>")
NEAR = columns("a binary, b binary")
EXACT = columns("key binary, links bigint, root binary")
Near = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def same_cell(distance: float) -> float:
    """The chance that vectors so far apart fall into one cell of a projection."""
    t = WIDTH / distance
    return math.erf(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * (1 - math.exp(-t * t / 2))


def apart(cosine: float) -> float:
    return math.sqrt(2 - 2 * cosine)


def shape(n: int, cosine: float) -> tuple[int, int]:
    """Projections of a table and tables for n vectors."""
    k = max(1, math.ceil(math.log(max(n, 2)) / -math.log(same_cell(apart(0)))))
    return k, math.ceil(math.log(MISSED) / math.log1p(-(same_cell(apart(cosine)) ** k)))


@functools.lru_cache(maxsize=4)
def projections(dim: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gaussian directions, offsets and those of the sketch; the same on every machine."""
    rng = np.random.default_rng([20240517, dim])
    sketch = rng.standard_normal((dim, SKETCH))
    return rng.standard_normal((dim, k * tables)), rng.uniform(0, WIDTH, k * tables), sketch


def unit(values: np.ndarray | None) -> np.ndarray | None:
    """The vector with length 1, in double precision; None if it has no direction."""
    if values is None or not len(values) or not np.isfinite(values).all():
        return None
    largest = np.abs(values).max()
    if not largest:
        return None
    scaled = values / largest  # squares neither overflow nor vanish
    return scaled / math.sqrt(scaled @ scaled)


def arrays(column: pa.ListArray) -> list[np.ndarray | None]:
    """The vectors of a column; a null component is not a number."""
    values, at = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_pylist()
    return [values[a:b] if there else None for there, a, b in zip(column.is_valid().to_pylist(), at, at[1:], strict=False)]


def keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding and key: the digest of label and vector, null if it links with nothing."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = vectors.select("vec_id", "label", "embedding")
    out = T.StructType([*rows.schema.fields, T.StructField("key", T.BinaryType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for id_, label, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), arrays(batch.column(2)), strict=True):
                linked = id_ is not None and label is not None and unit(v) is not None
                keys.append(hashlib.blake2b(repr(label).encode() + (v + 0.0).tobytes(), digest_size=16).digest() if linked else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).cast(arrow.field(k).type) for k in range(3)), pa.array(keys, pa.binary())], schema=arrow)

    return rows.mapInArrow(run, out)


def _hasher(n: int, cosine: float):
    k, tables = shape(n, cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(HASHED)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                keys, labels, units = part.column(0).to_pylist(), part.column(1).to_pylist(), [unit(v) for v in arrays(part.column(2))]
                for dim in sorted({len(v) for v in units}):
                    own = [i for i, v in enumerate(units) if len(v) == dim]
                    x = np.stack([units[i] for i in own])
                    directions, offsets, sketched = projections(dim, k, tables)
                    cells = np.floor((x @ directions + offsets) / WIDTH).astype(np.int16).reshape(len(own), tables, k)
                    sketches = np.clip(np.rint(x @ sketched / UNIT), -127, 127).astype(np.int8)
                    spaces = [f"{labels[i]!r} {dim} ".encode() for i in own]
                    buckets = [[xxhash.xxh64_intdigest(space + cell.tobytes(), t) - (1 << 63) for t, cell in enumerate(row)] for space, row in zip(spaces, cells, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in own], pa.binary()), pa.array([s.tobytes() for s in sketches], pa.binary()), pa.array(buckets, pa.list_(pa.int64()))], schema=schema)

    return run


def tiled(rows: DataFrame, group: str, block: int) -> DataFrame:
    """rows (key and a group that some key shares) with the tiles of the group that they are in: tile, block, across."""
    counts = cut(rows.groupBy(group).agg(F.count("*").alias("m")).filter("m > 1"), "sizes")
    blocks = F.ceil(F.col("m") / block)
    dealt = rows.join(sized(counts), group).withColumns({"_n": blocks, "block": F.pmod(F.xxhash64("key", group), blocks)})
    tiles = dealt.select(*rows.columns, "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("other"))
    return tiles.withColumns({"tile": F.xxhash64(group, F.least("block", "other"), F.greatest("block", "other")), "across": F.col("block") != F.col("other")}).drop("other")


def close(sizes: np.ndarray, x: np.ndarray, block: np.ndarray, across: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that are near, of tiles that lie one after the other in x."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    squares = (x * x).sum(axis=1)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for size in np.unique(sizes[sizes > 1]):
        own = starts[sizes == size]
        if size <= 16:  # tiles of one size at once
            i, j = np.triu_indices(size, 1)
            for at in range(0, len(own), CHUNK):
                a, b = ((own[at : at + CHUNK, None] + k).ravel() for k in (i, j))
                pair = ~across[a] | (block[a] != block[b])
                a, b = a[pair], b[pair]
                yes = near((x[a] * x[b]).sum(axis=1), squares[a], squares[b])
                found.append((a[yes], b[yes]))
            continue
        for start in own:
            here = np.arange(start, start + size)
            left, right = (here[block[here] == block[start]], here[block[here] != block[start]]) if across[start] else (here, here)
            for at in range(0, len(left), CHUNK):
                some = left[at : at + CHUNK]
                a, b = np.nonzero(near(x[some] @ x[right].T, squares[some][:, None], squares[right][None, :]))
                a, b = some[a], right[b]
                pair = slice(None) if across[start] else a < b
                found.append((a[pair], b[pair]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places, the first place of its component."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root != root[root]).any():
            root = root[root]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole tiles, in pieces of about a batch; rows come in the order of tiles."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tile = batch.column(0).to_numpy()
        last = int(np.searchsorted(tile, tile[-1]))  # where the batch's last tile begins
        if held and (last or held[-1].column(0)[0].as_py() != tile[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _parts(table: pa.Table, kind: type) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Rows of a table (tile, key, block, across, vector) by the length of their vectors: places and vectors."""
    keys, raw = table.column(1).to_pylist(), table.column(4).to_pylist()
    widths = np.array([len(r) for r in raw])
    by_width = ((w := np.flatnonzero(widths == width), np.frombuffer(b"".join(raw[i] for i in w), kind).reshape(len(w), -1)) for width in np.unique(widths))
    return table.column(0).to_numpy(), keys, table.column(2).to_numpy(), table.column(3).to_numpy(), by_width


def _pairs(table: pa.Table, kind: type, near: Near) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The keys of the rows and the near pairs among them, as places."""
    tile, keys, block, across, by_width = _parts(table, kind)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for own, x in by_width:
        _, sizes = np.unique(tile[own], return_counts=True)
        a, b = close(sizes, x.astype(np.float64 if kind is np.float64 else np.float32), block[own], across[own], near)
        found.append((own[a], own[b]))
    return keys, *(np.concatenate(c) for c in zip(*found, strict=True))


def _sketched(cosine: float):
    limit = (apart(cosine) * 2 / UNIT) ** 2 * SKETCH  # twice the distance: far above what chance adds, far below unrelated

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        for table in _tiles(batches):
            keys, a, b = _pairs(table, np.int8, lambda dot, u, v: u + v - 2 * dot <= limit)
            root = least_linked(len(keys), a, b)
            other = np.flatnonzero(root != np.arange(len(keys))).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([keys[root[i]] for i in other], pa.binary()), pa.array([keys[i] for i in other], pa.binary())], schema=to_arrow_schema(NEAR))

    return run


def _exact(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        for table in _tiles(batches):
            keys, a, b = _pairs(table, np.float64, lambda dot, u, v: dot >= cosine)
            copies = table.column(5).to_numpy()
            links = np.bincount(a, copies[b], len(keys)) + np.bincount(b, copies[a], len(keys))
            root = least_linked(len(keys), a, b)
            linked = np.flatnonzero(links).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in linked], pa.binary()), pa.array(links[linked].astype(np.int64)), pa.array([keys[root[i]] for i in linked], pa.binary())], schema=to_arrow_schema(EXACT))

    return run


def _unit_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = [unit(v).tobytes() for v in arrays(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.binary()), batch.column(2)], names=["key", "vector", "copies"])


def near_copies(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links (other vectors at the cosine or over), component_id (the least vec_id that links reach), kept."""
    rows = keyed(vectors)
    members = cut(rows.select("vec_id", "key"), "members")
    nodes = rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"))
    nodes = cut(nodes, "nodes")
    hashed = cut(nodes.select("key", "label", "embedding").mapInArrow(_hasher(nodes.count(), cosine), HASHED), "hashed")

    met = cut(tiled(hashed.select("key", F.explode("buckets").alias("bucket")), "bucket", SKETCHES).select("tile", "key", "block", "across"), "tiles")
    tiles = met.join(hashed.select("key", "sketch"), "key").select("tile", "key", "block", "across", "sketch")
    edges = cut(tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(_sketched(cosine), NEAR).distinct(), "near")

    stars = components(edges)  # all but the centres
    groups = cut(stars.unionByName(stars.select("label").distinct().select(F.col("label").alias("key"), "label")), "groups")
    whole = cut(tiled(groups, "label", VECTORS).select("tile", "key", "block", "across"), "tiles")
    units = nodes.join(groups.select("key"), "key", "left_semi").select("key", "embedding", "copies").mapInArrow(_unit_bytes, columns("key binary, vector binary, copies bigint"))
    tiles = whole.join(cut(units, "units"), "key").select("tile", "key", "block", "across", "vector", "copies")
    exact = cut(tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(_exact(cosine), EXACT), "exact")

    links = exact.groupBy("key").agg(F.sum("links").alias("links"))
    known = nodes.select("key", "first", "copies").join(links, "key", "left").join(components(exact.select(F.col("root").alias("a"), F.col("key").alias("b"))), "key", "left")
    known = cut(known.select("key", "first", F.coalesce("label", "key").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "known")
    least = cut(known.groupBy("label").agg(F.min("first").alias("component_id")), "least")
    of_key = cut(known.join(least, "label").select("key", "n_links", "component_id"), "of_key")
    linked = members.filter("key is not null").join(sized(of_key), "key").select("vec_id", "n_links", "component_id")
    alone = members.filter("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: The same rows in DuckDB, by all pairs of a label.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT v.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(m.b, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(m.b, v.vec_id)) AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = v.vec_id LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = v.vec_id
"""
