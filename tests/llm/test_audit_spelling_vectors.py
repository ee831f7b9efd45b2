"""The filter audit, spelling variants and near vectors against plain Python, and their defined cases."""

import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexframe.llm import filter_audit, near_vectors, spelling

DOCS = "doc_id long, text string, lang string, extra string, mask int, key string"
SPACE = "[^\\x20\\x09-\\x0D]+"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, "k") for i, t, lang in rows], DOCS)


# 11: filter interaction audit


def plain_audit(rows, labels):
    fails, first = [], {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    marks = defaultdict(lambda: [False, False])
    for i, q, x in labels:
        marks[i][0] |= q == 1
        marks[i][1] |= x == 1
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(SPACE, t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        fails.append((lang or "", f, *(marks[i] if i is not None else (False, False))))
    out = {}
    for part in {x[0] for x in fails}:
        own = [x for x in fails if x[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, here in enumerate(order):
                gone = lambda f, n=k, o=order: any(f[x] for x in o[:n])
                removed = [x for x in own if x[1][here] and not gone(x[1])]
                out[part, order, k + 1] = [
                    sum(not x[1][here] and not gone(x[1]) for x in own), len(removed), sum(x[1][here] and gone(x[1]) for x in own), sum(x[1][here] and sum(x[1].values()) == 1 for x in own),
                    sum(x[2] for x in removed), sum(x[3] for x in removed),
                ]
        for letter in "ABCDE":
            total = sum(v[1] for (p, o, k), v in out.items() if p == part and o[k - 1] == letter)
            for (p, o, k), v in out.items():
                if p == part and o[k - 1] == letter:
                    v.append(total)
    return out


def audited(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_audit(spark):
    rng = random.Random(1)
    prose = lambda n, m=500: " ".join(f"w{rng.randrange(m)}" for _ in range(n))
    texts = [prose(rng.choice((10, 250, 400)), rng.choice((30, 900))) + rng.choice(("", " #", " ABCDEFGHIJKLMNOP" * 8, "é|")) for _ in range(60)]
    texts += [None, "", " \n", "A", prose(300) + "x" * 70_000, prose(30_000, 20_000)]
    texts += [texts[k] for k in (0, 0, 1, 60, 61, 64, 65, 65)]
    texts += [t[:-1] + "q" for t in texts[:5]] + ["q" + t[1:] for t in texts[:5]]  # as long, and other only in one place
    rows = [(k, t, rng.choice(("en", "de", None, ""))) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [(None, texts[0], "en"), (None, texts[0], "en"), (70, texts[0], "en"), (3, texts[3], "de"), (3, texts[5], "de")]
    labels = [(k, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for k in range(0, 70, 2)] + [(4, 1, 1), (None, 1, 1)]
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = plain_audit(rows, labels)
    assert audited(filter_audit.audit(docs, marks)) == want
    alike = filter_audit.steps(filter_audit.mask_counts(docs, marks, lambda block: len(block) % 3))  # hashes that tell little
    assert audited(alike) == want
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert audited(filter_audit.audit(docs, marks.limit(0))) == plain_audit(rows, [])


def test_audit_pieces():
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(9)}" for _ in range(900_000)).encode()
    assert len(list(filter_audit.pieces(text))) > 1 and b"".join(filter_audit.pieces(text)) == text
    assert filter_audit.failed(text) == 2 and filter_audit.failed(b"x" * 3_000_000) == 1
    assert len(filter_audit.blocks(b"x" * 3_000_000, len)) < 10


# 12: spelling variants


def plain_variants(rows):
    counts = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= 5}

    def edits(w):
        letters = {c for x in n for c in x}
        for k in range(len(w) + 1):
            yield from (w[:k] + c + w[k:] for c in letters)
            if k < len(w):
                yield w[:k] + w[k + 1 :]
                yield from (w[:k] + c + w[k + 1 :] for c in letters)

    form, near = {}, {}
    for w in n:
        close = {x for x in edits(w) if x in n and x != w}
        top = min(close, key=lambda x: (-n[x], x), default=None)
        near[w], form[w] = len(close), top if top and n[top] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], near[w], n.get(form[w]))
    return out


def found_variants(df):
    got = df.collect()
    assert len(got) == len({r.word for r in got})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


def test_spelling(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 9))) for _ in range(400)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abcdef", "abcdefg", "bcdefg", "Letter", "LETTER", "lettÉr", "lett÷r", "zzzzzz"]
    for w in base[:100]:  # a chain of three, each rarer
        for _ in range(2):
            k = rng.randrange(len(w))
            w = w[:k] + rng.choice(("d", "e", "df", "")) + w[k + 1 :]
            base.append(w)
    weights = [(900 if k < 100 else 20) if k < 411 else (100, 12)[(k - 411) % 2] for k in range(len(base))]
    rows = [(k, " ".join(rng.choices(base, weights, k=rng.randint(0, 400)))) for k in range(120)]
    rows += [(7, rows[7][1]), (None, "letter letter letters"), (5000, None), (5001, ""), (5002, "a1b2"), (5003, " ".join(rng.choices(base, weights, k=20_000)))]
    rows += [(6000 + k, "x" * 3000 + " " + "x" * 2999 + "y") for k in range(8)]  # very long words
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    want = plain_variants(rows)
    assert sum(v[0] is not None for v in want.values()) > 50 and any(v[0] != v[1] and v[0] for v in want.values())
    assert found_variants(spelling.variants(docs)) == want
    assert spelling.variants(docs.limit(0)).count() == 0


def test_spelling_light_edges(spark):
    """A trie with many words has few light edges; every pair comes up once."""
    words = spark.range(3000).select(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 9).alias("word"), (F.col("id") + 5).alias("n"))
    assert spelling.light_edges(words).count() < 3000 * 6
    close = sorted("".join(p) for p in itertools.product("abc", repeat=6))
    got = {r.word: r for r in spelling.near(spark.createDataFrame([(w, 5) for w in close], "word string, n long")).collect()}
    assert len(got) == len(close) and all(r.n_near == 12 for r in got.values())  # two other letters at each of six places
    assert got["aaaaaa"].best.form == "aaaaab" and got["ccccca"].best.form == "accccca"[:1] + "cccca"


def test_spelling_pieces():
    text = ("Word " * 300_000 + "é" * 10).encode()
    assert spelling.runs(text) == Counter({"word": 300_000, "é" * 10: 1})
    began = time.time()
    assert sum(spelling.runs(b"a" * 5_000_000).values()) == 1 and time.time() - began < 5


# 13: near vectors


def plain_links(rows, cosine=0.93):
    keys = [k for k, (i, e, label) in enumerate(rows) if i is not None and label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    linked = defaultdict(set)
    for a, b in itertools.combinations(keys, 2):
        x, y = (np.array(rows[k][1], np.float64) for k in (a, b))
        if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
            linked[a].add(b)
            linked[b].add(a)
    out = []
    for k, (i, *_) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for b in linked[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        least = i if i is None else min(rows[b][0] for b in seen)
        out.append((i, len(linked[k]), least, i == least))
    return sorted(out, key=repr)


EMBEDDINGS = "vec_id long, embedding array<float>, label int, key string, n_links int"


def embedded(spark, rows):
    clean = [(i, None if e is None else [None if x is None else float(x) for x in e], label, "k", 1) for i, e, label in rows]
    return spark.createDataFrame(clean, EMBEDDINGS)


def as32(rows):
    return [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e], label) for i, e, label in rows]


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(120):
        v = rng.standard_normal(32)
        v /= np.linalg.norm(v)
        for r in range(int(rng.integers(1, 5))):  # from far too far to near
            rows.append((int(rng.permutation(10**6)[0]), list(v + rng.standard_normal(32) * rng.choice([0.01, 0.04, 0.06, 0.07]) * (r > 0)), int(k % 3)))
    rows += [(2_000_000 + k, rows[0][1], rows[0][2]) for k in range(40)]  # copies
    rows += [(3_000_000, [2 * x for x in rows[0][1]], rows[0][2]), (3_000_001, [-x for x in rows[0][1]], rows[0][2]), (3_000_002, rows[0][1], 9), (3_000_003, rows[0][1], None)]
    rows += [(3_000_004, None, 1), (3_000_005, [], 1), (3_000_006, [0.0] * 32, 1), (3_000_007, [None, *rows[0][1][1:]], 0), (3_000_008, [float("nan"), *rows[0][1][1:]], 0), (3_000_009, [float("inf"), *rows[0][1][1:]], 0)]
    rows += [(None, rows[0][1], rows[0][2]), (rows[5][0], rows[5][1], rows[5][2]), (3_000_010, rows[0][1][:16], rows[0][2]), (3_000_011, [*rows[0][1][:16]], rows[0][2]), (3_000_012, [1e-30] * 8, 2), (3_000_013, [1e30] * 8, 2)]
    rows = as32(rows)
    got = near_vectors.near_copies(embedded(spark, rows))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect() if r.vec_id is not None), key=repr) == [x for x in plain_links(rows) if x[0] is not None]
    assert [tuple(r) for r in got.filter("vec_id is null").collect()] == [(None, 0, None, True)]
    assert near_vectors.near_copies(embedded(spark, rows).limit(0)).count() == 0


def test_near_vectors_blocks(spark, monkeypatch):
    """Groups of several blocks, and those that hang together by chains."""
    monkeypatch.setattr(near_vectors, "SKETCHES", 20)
    monkeypatch.setattr(near_vectors, "VECTORS", 30)
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(24)
    rows = [(k, list(centre + rng.standard_normal(24) * 0.2 * np.linalg.norm(centre) / 24**0.5), 1) for k in range(250)]
    turn = np.linspace(0, 3, 60)
    rows += [(1000 + k, [np.cos(t), np.sin(t), *[0.0] * 22], 2) for k, t in enumerate(turn)]
    rows = as32(rows)
    assert sorted(map(tuple, near_vectors.near_copies(embedded(spark, rows)).collect()), key=repr) == plain_links(rows)


def test_near_vectors_recall():
    """What the tables promise, measured: pairs at the limit itself share a table but for a few in a thousand."""
    rng, n, dim = np.random.default_rng(7), 3000, 48
    k, tables = near_vectors.shape(10_000, 0.93)
    u = rng.standard_normal((n, dim))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w = rng.standard_normal((n, dim))
    w -= (w * u).sum(axis=1)[:, None] * u
    v = 0.93 * u + (1 - 0.93**2) ** 0.5 * w / np.linalg.norm(w, axis=1)[:, None]
    directions, offsets, _ = near_vectors.projections(dim, k, tables)
    cells = [np.floor((x @ directions + offsets) / near_vectors.WIDTH).reshape(n, tables, k) for x in (u, v)]
    met = (cells[0] == cells[1]).all(axis=2)
    assert met.any(axis=1).mean() > 0.99
    others = (cells[0][:-1] == cells[0][1:]).all(axis=2).mean()
    assert others < 10 / 10_000


@pytest.mark.parametrize("n,edges,want", [(5, [(1, 3), (3, 4), (4, 2)], [0, 1, 1, 1, 1]), (3, [], [0, 1, 2]), (6, [(5, 4), (4, 3), (3, 2), (2, 1), (1, 0)], [0] * 6)])
def test_least_linked(n, edges, want):
    a, b = np.array(edges, np.int64).reshape(-1, 2).T
    assert near_vectors.least_linked(n, a, b).tolist() == want
