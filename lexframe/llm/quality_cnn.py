"""Quality classifier: a byte-level convolutional network in numpy.

Filters of learned weights slide over the bytes of overlapping chunks that cover the whole document; a chunk's
value for a filter is the mean of its rectified responses, a document's is the largest over its chunks, and a
logistic unit combines these into one probability.

Training takes a bounded sample of labelled rows: `per_class` of each label, chosen by hash. Their whole texts are written
once to the shared folder and come to the driver one after the other, in another order each epoch, so what it holds is
a part of the sample and not all of it. Scoring takes whole texts, in Arrow batches with the weights in the closure
(some 10 KB), without a shuffle.

Defined cases: a null text is an empty one and gets the score of the bias and the values of no response;
null doc_ids are never training rows; labels that are null are left out; repeated rows are scored each, and one of
them (the least text) is trained on; of several labels of an id the least counts; ties of the sample go by doc_id; a
table without labels of both kinds scores 0.5 throughout; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import columns, cut, map_docs

FILTERS, WIDTH, HALF_CHUNK = 8, 4, 128
#: Bytes that are worked on at once; a multiple of half a chunk, so long documents need no more memory.
SEGMENT = 256 * HALF_CHUNK


class Network:
    """Weights: a table [place, byte, filter] (a convolution over one-hot bytes), filter biases, output unit."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.5, FILTERS).astype(np.float32)
        self.out_bias = np.float32(0.0)

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Rectified responses at each place of data, but for the last WIDTH - 1."""
        n = len(data) - WIDTH + 1
        total = self.table[0][data[:n]]
        for k in range(1, WIDTH):
            total += self.table[k][data[k : k + n]]
        total += self.bias
        return np.maximum(total, 0, out=total)

    def halves(self, data: np.ndarray) -> np.ndarray:
        """Sums of the responses over each half chunk of a document; the last half may be short."""
        sums = []
        for at in range(0, max(1, len(data) - WIDTH + 1), SEGMENT):
            r = self.responses(data[at : at + SEGMENT + WIDTH - 1])
            sums.append(np.add.reduceat(r, np.arange(0, len(r), HALF_CHUNK), axis=0))
        return np.concatenate(sums)

    @staticmethod
    def bytes_of(raw: bytes) -> np.ndarray:
        return np.frombuffer(raw + b"\0" * (WIDTH - len(raw)) if len(raw) < WIDTH else raw, np.uint8)

    def chunks(self, data: np.ndarray) -> np.ndarray:
        """Mean response of each chunk of two neighbouring halves: chunks overlap by half."""
        sums, n = self.halves(data), len(data) - WIDTH + 1
        if len(sums) == 1:
            return sums / n
        sizes = np.full(len(sums), HALF_CHUNK)
        sizes[-1] = n - HALF_CHUNK * (len(sums) - 1)
        return (sums[:-1] + sums[1:]) / (sizes[:-1] + sizes[1:])[:, None]

    def score(self, raw: bytes) -> float:
        top = self.chunks(self.bytes_of(raw)).max(axis=0)
        return float(1 / (1 + np.exp(-np.clip(top @ self.out + self.out_bias, -30, 30))))

    def gradient(self, raw: bytes, label: float, grads: list[np.ndarray]) -> None:
        data = self.bytes_of(raw)
        means = self.chunks(data)
        which, n = means.argmax(axis=0), len(data) - WIDTH + 1
        top = means[which, np.arange(FILTERS)]
        error = 1 / (1 + np.exp(-np.clip(top @ self.out + self.out_bias, -30, 30))) - label
        grads[2] += error * top
        grads[3] += error
        for f in range(FILTERS):  # the gradient goes to the chunk that gave the largest value
            a, b = which[f] * HALF_CHUNK, min(n, (which[f] + 2) * HALF_CHUNK)
            piece = data[a : b + WIDTH - 1]
            on = sum(self.table[k, piece[k : k + b - a], f] for k in range(WIDTH)) + self.bias[f] > 0
            g = error * self.out[f] / (b - a)
            grads[1][f] += g * on.sum()
            for k in range(WIDTH):
                grads[0][k, :, f] += g * np.bincount(piece[k : k + b - a][on], minlength=256)


def train(epoch: Callable[[int], Iterable[tuple[bytes, int]]], zeros: int, ones: int, epochs: int = 8, rate: float = 0.02, batch: int = 32) -> Network:
    """Adam over minibatches; epoch(k) gives the samples (text, label) in the order of that epoch. Both labels count alike
    whatever their numbers."""
    net = Network()
    if not zeros or not ones:
        net.out[:] = 0
        return net
    weights = ((zeros + ones) / (2 * zeros), (zeros + ones) / (2 * ones))
    names = ("table", "bias", "out", "out_bias")
    first = [np.zeros_like(getattr(net, k), dtype=np.float64) for k in names]
    second = [np.zeros_like(x) for x in first]
    step = 0
    for k in range(epochs):
        samples = iter(epoch(k))
        while some := list(itertools.islice(samples, batch)):
            total = [np.zeros_like(x) for x in first]
            for text, label in some:
                own = [np.zeros_like(x) for x in first]
                net.gradient(text, label, own)
                for t, g in zip(total, own, strict=True):
                    t += weights[label] * g / batch
            step += 1
            for i, name in enumerate(names):
                first[i] = 0.9 * first[i] + 0.1 * total[i]
                second[i] = 0.999 * second[i] + 0.001 * total[i] ** 2
                move = rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
                setattr(net, name, (getattr(net, name) - move).astype(np.float32))
    return net


def held_out(doc_id: Column) -> Column:
    """The fold that is kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 700) -> Network:
    """Train on at most `per_class` labelled documents of each label outside the held-out fold."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = [known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    ids = F.broadcast(chosen[0].union(chosen[1]))  # at most 2 * per_class rows
    rows = docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    sample = cut(rows, "sample")
    sizes = {r.quality: r["count"] for r in sample.groupBy("quality").count().collect()}

    def epoch(k: int) -> Iterable[tuple[bytes, int]]:
        in_order = sample.orderBy(F.xxhash64("doc_id", F.lit(k)), "doc_id")
        return (((r.text or "").encode(), r.quality) for r in in_order.toLocalIterator())

    return train(epoch, sizes.get(0, 0), sizes.get(1, 0))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = 700) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 from `threshold` on)."""
    net = fit(docs, labels, per_class)
    scored = map_docs(docs, lambda raw: [(net.score(raw),)], columns("score double"), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
