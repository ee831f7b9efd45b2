"""Mixing sources to target weights by proportionate-fair scheduling.

A source's documents, in the order of a hash of their ids, are cut into blocks. In the ideal mix every source has at
each moment its exact weight's share of the slots, and the others go on in proportion when one has no more blocks.
Block j of a source is released in the slot in which the ideal mix begins it and due by the end of the slot in which
that has finished it; at each slot the released block with the earliest deadline runs, so at every slot each source
is less than one block from its share. Shares are exact: weights become integers of a common power of two.

Slots are dealt in one task that reads one row for each source and writes one for each block; what it holds grows
with the sources only, and nothing of it passes through the driver.

Numbers within a source come from counts by (source, hash bucket), their running sums and a row number within a
bucket, so a source with a third of all rows is spread over buckets. Each bucket has the slots of its blocks beside
it, so whole rows are shuffled once, to their bucket, however many blocks there are.

Defined cases: a null source is a source of its own; null doc_ids have places like any other; repeated rows each
have a place; texts are not looked at, so empty and very long ones are places like others; ties of deadlines go by
the source's name, ties of a row's hash by doc_id; sources without a given weight get `other`; sources of weight 0
come after all others; an empty table gives an empty result; a column of the input that is named like one of the
result is replaced.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import columns, cut, unused

#: Documents in a block; documents in a hash bucket, about.
BLOCK, BUCKET = 16, 2000
#: Weights that are not given are the source's size to this power, as in temperature sampling.
POWER = 0.5
#: Rows that the dealing task writes at a time.
PIECE = 50_000


def exact(weights: dict[str, float]) -> dict[str, int]:
    """Integers in the proportions of the weights, without rounding."""
    ratios = {s: float(w).as_integer_ratio() for s, w in weights.items()}
    unit = max((d for _, d in ratios.values()), default=1)  # denominators are powers of two
    return {s: n * (unit // d) for s, (n, d) in ratios.items()}


def dealt(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot) by slot, blocks and slots from 0."""
    base = 0
    for some in ({s: n for s, n in blocks.items() if weights[s] > 0}, {s: n for s, n in blocks.items() if weights[s] <= 0}):
        keys = sorted(s for s, n in some.items() if n > 0)
        parts = exact({s: weights[s] if weights[s] > 0 else 1 for s in keys})
        n, w = [some[s] for s in keys], [parts[s] for s in keys]
        # the ideal mix: after v of each unit of weight, the sources that ended by v have had all their blocks
        order = sorted(range(len(keys)), key=lambda i: Fraction(n[i], w[i]))
        ends = [n[i] / w[i] for i in order]
        ended = [0, *itertools.accumulate(n[i] for i in order)]
        going = [sum(w) - x for x in (0, *itertools.accumulate(w[i] for i in order))]

        def phase(i: int, j: int) -> int:
            """How many sources have ended when source i has done j blocks; the float is a guess, integers decide."""
            k = bisect.bisect_right(ends, j / w[i])
            while k < len(order) and n[order[k]] * w[i] <= j * w[order[k]]:
                k += 1
            while k and n[order[k - 1]] * w[i] > j * w[order[k - 1]]:
                k -= 1
            return k

        def begun(i: int, j: int) -> int:
            """The slot in which the ideal mix has done j blocks of source i."""
            k = phase(i, j)
            return ended[k] + j * going[k] // w[i]

        def due(i: int, j: int) -> int:
            """The end of that slot."""
            k = phase(i, j)
            return ended[k] - (-j * going[k] // w[i])

        waiting, ready = [(0, i, 0) for i in range(len(keys))], []  # release, source, block; deadline, source, block
        for slot in range(sum(n)):
            while waiting and (waiting[0][0] <= slot or not ready):
                _, i, j = heapq.heappop(waiting)
                heapq.heappush(ready, (due(i, j + 1), i, j))
            _, i, j = heapq.heappop(ready)
            yield keys[i], j, base + slot
            if j + 1 < n[i]:
                heapq.heappush(waiting, (begun(i, j + 1), i, j + 1))
        base += sum(n)


SLOTS = columns("_key string, block bigint, slot bigint")
PLACES = ("block", "slot", "place")


def key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("-"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, other: float | None = None, block: int = BLOCK) -> DataFrame:
    """docs with block (number within its source), slot (of the whole mix) and place (within the block). Ordered
    by slot and place, the documents follow the weights. Every row has a place; none is dropped or repeated."""
    docs = docs.drop(*PLACES)
    source, order, bucket, offset, slots, i = unused(docs, "_key", "_order", "_bucket", "_offset", "_slots", "_i")
    rows = docs.withColumns({source: key(F.col("source")), order: F.xxhash64(F.col("doc_id").cast("string"), F.lit("mix"))})
    n_buckets = max(1, -(-docs.count() // BUCKET))
    rows = rows.withColumn(bucket, F.pmod(F.shiftrightunsigned(order, 20), F.lit(n_buckets)))
    counts = cut(rows.groupBy(source, bucket).agg(F.count("*").alias("n")), "counts")
    sizes = cut(counts.groupBy(source).agg(F.sum("n").alias("n")), "sizes")
    given = {key_of(s): w for s, w in (weights or {}).items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {s: n for b in batches for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
        target = {s: given.get(s, other if other is not None else n**POWER) for s, n in held.items()}
        for piece in itertools.batched(dealt({s: -(-n // block) for s, n in held.items()}, target), PIECE):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*piece), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=SLOTS.names)

    # where each block goes, from the numbers of blocks alone: one row for each block
    where = cut(sizes.select(source, "n").coalesce(1).mapInArrow(deal, SLOTS), "slots").withColumnRenamed("_key", source)

    # for each bucket the slots of its blocks, in order, so that the rows move once, to their bucket
    before = Window.partitionBy(source).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn(offset, F.coalesce(F.sum("n").over(before), F.lit(0)))
    reach = F.sequence(F.floor(F.col(offset) / block), F.floor((F.col(offset) + F.col("n") - 1) / block))
    placed = (
        offsets.select(source, bucket, offset, F.explode(reach).alias("block"))
        .join(where, [source, "block"])
        .groupBy(source, bucket)
        .agg(F.first(offset).alias(offset), F.sort_array(F.collect_list(F.struct("block", "slot"))).alias(slots))
    )
    within = Window.partitionBy(source, bucket).orderBy(order, "doc_id")
    here = F.element_at(slots, (F.floor(F.col(i) / block) - F.floor(F.col(offset) / block) + 1).cast("int"))
    return (
        rows.withColumn(i, F.row_number().over(within) - 1)
        .join(placed.hint("merge"), [source, bucket])  # both sides are dealt and sorted by the bucket already
        .withColumn(i, F.col(i) + F.col(offset))
        .withColumns({"block": here["block"], "slot": here["slot"], "place": F.col(i) % block})
        .select(*docs.columns, *PLACES)
    )


def key_of(source: str | None) -> str:
    return "-" if source is None else f"s{source}"
