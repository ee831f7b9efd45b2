"""The network against a convolution written out, and training on whole texts."""

import math
import random

import numpy as np
import pytest

from lexframe.llm import quality_cnn
from lexframe.llm.quality_cnn import FILTERS, HALF_CHUNK, WIDTH, Network


def plain_score(net, raw):
    """One place, one filter, one chunk at a time."""
    data = list(raw) + [0] * max(0, WIDTH - len(raw))
    places = len(data) - WIDTH + 1
    responses = [[max(0.0, sum(float(net.table[k, data[at + k], f]) for k in range(WIDTH)) + float(net.bias[f])) for f in range(FILTERS)] for at in range(places)]
    starts = range(0, max(1, places - HALF_CHUNK), HALF_CHUNK)
    top = [max(sum(r[f] for r in responses[a : a + 2 * HALF_CHUNK]) / len(responses[a : a + 2 * HALF_CHUNK]) for a in starts) for f in range(FILTERS)]
    return 1 / (1 + math.exp(-(sum(t * float(o) for t, o in zip(top, net.out)) + float(net.out_bias))))


@pytest.mark.parametrize("n", [0, 1, 3, 4, 130, 131, 132, 259, 260, 387, 388, 1000, 40_000])
def test_score_is_the_convolution(n):
    rng = random.Random(n)
    raw = bytes(rng.choice(b"abcdefgh \n\xc3\xa9") for _ in range(n))
    net = Network(seed=3)
    net.bias += np.linspace(-0.5, 0.5, FILTERS, dtype=np.float32)
    assert abs(net.score(raw) - plain_score(net, raw)) < 1e-4


def test_training_reads_whole_texts(spark):
    """What tells the labels apart stands at the end of texts of 60,000 characters."""
    rng = random.Random(9)
    filler = lambda: " ".join("".join(rng.choices("abcdeg", k=5)) for _ in range(10_000))
    rows = [(k, filler() + ("zqzq " if k % 2 else "fine ") * 80) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k, _ in rows], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality_cnn.classify(docs, labels).collect()}
    assert min(v for k, v in got.items() if not k % 2) > max(v for k, v in got.items() if k % 2)
    nameless = quality_cnn.classify(docs.limit(2).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text"), labels).collect()
    assert [(r.doc_id, r.held_out, r.score) for r in nameless] == [(None, False, 0.5)] * 2
