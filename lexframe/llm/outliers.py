"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates per language and source.

Statistics of each text are taken once, transformed, and written as a narrow table of integers. Every language and
source has an estimate of its own, however few rows it has: `PRIOR` pseudo-rows with the mean and covariance of its
language join its own rows, and those of all rows join the language's, so an estimate moves smoothly from what is
known above it to what its rows say.

An estimate is searched from three starts (medians and quartiles; with correlations of squashed values; with those of
directions): two concentration steps each, then the one of least determinant goes on until its determinant no longer
falls. A step is one aggregation by group and bin of distance, whose rows are few, so a group with a third of all
rows is pre-aggregated in every task like any other; of the bin in which the share ends, that part counts which the
share still needs. Pseudo-rows are in every step, so the determinant falls with each. Sums are of integers, so results do not
depend on the order of rows. No direction has less variance than counting gives it (one occurrence in a text of the
group's mean size), so a statistic that is nearly always 0 does not reject every other value.

Defined cases: a null text is an empty one; null language or source is a group of its own; null or repeated
doc_ids pass through row by row; ties of distance are one bin; very long texts are taken whole; other columns pass
through `keep_quality` and are ignored otherwise; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import columns, cut, map_docs, sized, unused, window_hashes, word_hashes

#: Share of rows that an estimate rests on; pseudo-rows of the estimate above; steps of every start, and at most in all.
SHARE, PRIOR, FIRST_STEPS, MOST_STEPS = 0.75, 60, 2, 40
#: Chance of a larger distance from which a normal row is rejected.
CHANCE = 1e-4
#: Transformed values are held as integers of 1/UNIT, their variances from counting as integers of 1/NOISE_UNIT.
UNIT, NOISE_UNIT = 512, 1 << 24
#: Characters, lines and words that are added to a text's own where a share is taken: in a very short text one
#: occurrence says little.
CHARS, LINES, SOME_WORDS = 100, 4, 16
#: Spreads of the coordinates that are taken for granted before any row is seen.
WIDE = (1.0, 0.3, 0.1, 0.3, 0.2, 0.1, 0.1)
NAMES = ("words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "marks")
D = len(NAMES)
SYMBOLS = re.compile(rb"[#*$%&|<>]+")
MARKS = re.compile(rb"[!?;:\"'()\[\]{}@_=+/\\~^`]+")
CAPITALS = re.compile("[A-ZÀ-ÖØ-Þ]+")
STATS = columns("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_capitals bigint, n_marks bigint")


def repeated_words(words: list[bytes]) -> int:
    """Words in five-word windows that the text has twice or more. Equal hashes are compared by their words."""
    if len(words) < 6:
        return 0
    h = window_hashes(word_hashes(words), 5)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    covered = np.zeros(len(words), bool)
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    seen: dict[tuple, int] = {}
    for i in np.flatnonzero(twice).tolist():
        key = tuple(words[i : i + 5])
        if key in seen:
            covered[i : i + 5] = True
            covered[seen[key] : seen[key] + 5] = True
        else:
            seen[key] = i
    return int(covered.sum())


def statistics(raw: bytes) -> list[tuple]:
    words = raw.split()
    chars = len(raw.decode()) if not raw.isascii() else len(raw)
    blank = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    capitals = sum(map(len, CAPITALS.findall(raw.decode())))
    return [
        (
            len(words),
            chars - blank,
            sum(map(len, SYMBOLS.findall(raw))),
            len(lines) - len(set(lines)),
            repeated_words(words),
            len(lines),
            capitals,
            sum(map(len, MARKS.findall(raw))),
        )
    ]


def vector() -> list[Column]:
    """Transformed statistics as integers, logarithms of sizes and square roots of shares: x*; and the variances that
    they have from counting: v*."""
    c, one = F.col, F.lit(1.0)
    chars, words, lines = c("word_chars") + CHARS, c("n_words") + SOME_WORDS, c("n_lines") + LINES
    values = (
        F.log1p(c("n_words")),
        2 * F.log1p(c("word_chars") / F.greatest(c("n_words"), one)),
        F.sqrt(c("n_symbols") / chars),
        F.sqrt(c("n_dup_lines") / lines),
        F.sqrt(c("n_repeat_words") / words),
        F.sqrt(c("n_capitals") / chars),
        F.sqrt(c("n_marks") / chars),
    )
    noise = (1 / (c("n_words") + one), 0.4 / (c("n_words") + one), 1 / chars, 1 / lines, 5 / words, 1 / chars, 1 / chars)
    whole = lambda xs, unit, name: [F.round(x * unit).cast("long").alias(f"{name}{k}") for k, x in enumerate(xs)]
    return whole(values, UNIT, "x") + whole(noise, NOISE_UNIT, "v")


X, V = [f"x{k}" for k in range(D)], [f"v{k}" for k in range(D)]
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
SUMS = ["n", *(f"s{i}" for i in range(D)), *(f"s{i}_{j}" for i, j in PAIRS)]
PARAMS = columns("g string, start int, center array<double>, whiten array<double>, cov array<double>, noise array<double>, det double, moves int")


def chi_squared(x: float, k: int) -> float:
    """The chance of at most x, for k degrees."""
    term = math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2 + 1)) if x > 0 else 0.0
    total = 0.0
    for n in range(1, 1000):
        total += term
        term *= x / 2 / (k / 2 + n)
    return total


def quantile(p: float, k: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_squared(middle, k) < p else (low, middle)
    return low


def scale() -> float:
    """What makes the covariance of the closest rows that of all, if rows are normal."""
    return SHARE / chi_squared(quantile(SHARE, D), D + 2)


def _sums(of: Callable[[int], Column]) -> list[Column]:
    return [F.count("*").alias("n"), *(F.sum(of(i)).alias(f"s{i}") for i in range(D)), *(F.sum(of(i) * of(j)).alias(f"s{i}_{j}") for i, j in PAIRS)]


def moments(r: tuple, unit: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Number, sum and sum of products of a row of SUMS."""
    total, products = np.array([getattr(r, f"s{i}") for i in range(D)], float) / unit, np.zeros((D, D))
    for i, j in PAIRS:
        products[i, j] = products[j, i] = getattr(r, f"s{i}_{j}") / unit**2
    return float(r.n), total, products


def floored(cov: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """cov with at least the variance of counting in every direction."""
    sd = np.sqrt(np.outer(noise, noise))
    values, vectors = np.linalg.eigh(cov / sd)
    return (vectors * np.maximum(values, 1)) @ vectors.T * sd


def settled(g: str, start: int, center: np.ndarray, cov: np.ndarray, noise: np.ndarray, before: float) -> tuple:
    """A row of PARAMS; whiten holds the rows of W (lower triangle) with |W (x - center)|^2 the squared distance."""
    w = np.linalg.inv(np.linalg.cholesky(cov))
    det = float(np.linalg.slogdet(cov)[1])
    return g, start, center.tolist(), [float(w[i, j]) for i in range(D) for j in range(i + 1)], cov.ravel().tolist(), noise.tolist(), det, int(det < before - 1e-9)


def _starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Three estimates of each group: its medians, with no, squashed and directional correlations."""
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            noise = np.array(r.noise, float)
            spread = np.array(r.spread, float)
            for start, name in enumerate(("none", "tanh", "sign")):
                corr = np.eye(D)
                if name != "none":
                    products = np.zeros((D, D))
                    for i, j in PAIRS:
                        products[i, j] = products[j, i] = getattr(r, f"{name}{i}_{j}")
                    size = np.sqrt(np.maximum(np.diag(products), 1))
                    corr = 0.99 * products / np.outer(size, size) + 0.01 * np.eye(D)
                    np.fill_diagonal(corr, 1)
                out.append(settled(r.g, start, np.array(r.middle, float), floored(corr * np.outer(spread, spread), noise), noise, math.inf))
        yield pd.DataFrame(out, columns=PARAMS.names)


def _estimates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean and covariance of each group's closest rows and the pseudo-rows of the estimate above."""
    factor = scale()
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            n, total, products = moments(r, UNIT)
            center, cov = np.array(r.above_center, float), np.array(r.above_cov, float).reshape(D, D) / factor
            n, total, products = n + PRIOR, total + PRIOR * center, products + PRIOR * (cov + np.outer(center, center))
            mean = total / n
            noise = np.array(r.noise, float)
            out.append(settled(r.g, r.start, mean, floored(factor * (products / n - np.outer(mean, mean)), noise), noise, r.det))
        yield pd.DataFrame(out, columns=PARAMS.names)


def distance() -> Column:
    """Squared Mahalanobis distance from the columns x*, center and whiten."""
    c = [F.col(f"x{k}") / F.lit(float(UNIT)) - F.get("center", F.lit(k)) for k in range(D)]
    rows = [sum((F.get("whiten", F.lit(i * (i + 1) // 2 + j)) * c[j] for j in range(1, i + 1)), F.get("whiten", F.lit(i * (i + 1) // 2)) * c[0]) for i in range(D)]
    return sum((r * r for r in rows[1:]), rows[0] * rows[0])


def starts(members: DataFrame) -> DataFrame:
    """PARAMS of three starts for each group g of the members."""
    each = lambda make: [make(i) for i in range(D)]
    quartiles = members.groupBy("g").agg(*each(lambda i: F.percentile(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"p{i}")), *each(lambda i: F.avg(f"v{i}").alias(f"a{i}")))
    noise = [F.col(f"a{i}") / NOISE_UNIT for i in range(D)]
    spread = [F.greatest((F.get(f"p{i}", F.lit(2)) - F.get(f"p{i}", F.lit(0))) / (1.349 * UNIT), F.sqrt(noise[i])) for i in range(D)]
    middle = cut(quartiles.select("g", F.array(*(F.get(f"p{i}", F.lit(1)) / UNIT for i in range(D))).alias("middle"), F.array(*spread).alias("spread"), F.array(*noise).alias("noise")), "middle")
    z = [(F.col(f"x{i}") / UNIT - F.get("middle", F.lit(i))) / F.get("spread", F.lit(i)) for i in range(D)]
    placed = members.join(sized(middle), "g").select("g", *(v.alias(f"z{i}") for i, v in enumerate(z)))
    length = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, D)), F.col("z0") * F.col("z0")))
    made = {f"tanh{i}": F.round(1024 * F.tanh(f"z{i}")).cast("long") for i in range(D)} | {f"sign{i}": F.coalesce(F.round(1024 * F.try_divide(F.col(f"z{i}"), length)).cast("long"), F.lit(0)) for i in range(D)}
    products = placed.withColumns(made).groupBy("g").agg(*(F.sum(F.col(f"{k}{i}") * F.col(f"{k}{j}")).alias(f"{k}{i}_{j}") for k in ("tanh", "sign") for i, j in PAIRS))
    return cut(products.join(middle, "g").mapInPandas(_starts, PARAMS), "start")


def step(members: DataFrame, params: DataFrame, above: DataFrame) -> DataFrame:
    """One concentration step of every (g, start) of the params; above has g, above_center and above_cov."""
    near = F.floor(8 * F.log2(distance() + 0.01)).cast("int")
    binned = members.join(sized(params.select("g", "start", "center", "whiten")), "g").groupBy("g", "start", near.alias("bin")).agg(*_sums(lambda i: F.col(f"x{i}")))
    own = Window.partitionBy("g", "start")  # some hundred bins a group
    needed = SHARE * F.sum("n").over(own) - (F.sum("n").over(own.orderBy("bin")) - F.col("n"))
    closest = binned.withColumn("part", F.greatest(F.least(needed / F.col("n"), F.lit(1.0)), F.lit(0.0))).groupBy("g", "start").agg(*(F.sum(F.col(c) * F.col("part")).alias(c) for c in SUMS))
    known = params.select("g", "start", "noise", "det").join(above, "g")
    return cut(closest.join(known, ["g", "start"]).mapInPandas(_estimates, PARAMS), "step")


def estimates(members: DataFrame, begun: DataFrame, above: DataFrame) -> DataFrame:
    """(g, center, whiten, cov): the estimate of least determinant of each group of the members."""
    params = begun
    for _ in range(FIRST_STEPS):
        params = step(members, params, above)
    best = params.groupBy("g").agg(F.min_by(F.struct(*PARAMS.names[1:]), F.struct("det", "start")).alias("x")).select("g", "x.*")
    params, done = cut(best, "best"), None
    for _ in range(MOST_STEPS):
        still = params.filter("moves = 1")
        if not still.limit(1).count():
            break
        rest = params.filter("moves = 0")
        done = rest if done is None else done.unionByName(rest)
        params = step(members.join(sized(still.select("g")), "g", "left_semi"), still, above)
    params = params if done is None else cut(done.unionByName(params), "estimates")
    return params.select("g", "center", "whiten", "cov")


def verdicts(stats: DataFrame, chance: float = CHANCE) -> DataFrame:
    """stats with `distance` and `outlier`. stats has lang, source and the columns of STATS."""
    language = F.coalesce(F.concat(F.lit("l"), F.col("lang")), F.lit("?"))
    source = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("?"))
    names = [F.lit("all"), F.to_json(F.struct(language.alias("l"))), F.to_json(F.struct(language.alias("l"), source.alias("s")))]
    rows = cut(stats.withColumns({f"g{k}": n for k, n in enumerate(names)}).select("*", *vector()), "statistics")
    groups = cut(rows.select("g0", "g1", "g2").distinct(), "groups")
    above = None
    for k in range(3):
        members = rows.select(F.col(f"g{k}").alias("g"), *X, *V)
        begun = starts(members)
        if above is None:  # nothing is above all rows but their medians and the spreads that are taken for granted
            above = begun.filter("start = 0").select("g", F.col("center").alias("above_center"), F.array(*(F.lit(w * w if i == j else 0.0) for i, w in enumerate(WIDE) for j in range(D))).alias("above_cov"))
        else:
            upper = above.withColumnRenamed("g", f"g{k - 1}")
            above = groups.select(f"g{k - 1}", F.col(f"g{k}").alias("g")).distinct().join(sized(upper), f"g{k - 1}").select("g", "above_center", "above_cov")
        found = estimates(members, begun, above)
        above = found.select("g", F.col("center").alias("above_center"), F.col("cov").alias("above_cov"))
    judged = rows.join(sized(found.select(F.col("g").alias("g2"), "center", "whiten")), "g2", "left").withColumn("distance", distance())
    return judged.select(*stats.columns, "distance", F.coalesce(F.col("distance") > quantile(1 - chance, D), F.lit(False)).alias("outlier"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def quality(docs: DataFrame, **options: float) -> DataFrame:
    """doc_id, the statistics, base_failed, distance and kept."""
    stats = map_docs(docs, statistics, STATS, ["doc_id", "lang", "source"])
    judged = verdicts(stats, **options)
    return judged.select("doc_id", *STATS.names, base_failed().alias("base_failed"), "distance", (~base_failed() & ~F.col("outlier")).alias("kept"))


def keep_quality(docs: DataFrame, **options: float) -> DataFrame:
    """The documents that pass, judged row by row; columns as they are. A row is known by its doc_id, language,
    source and the hash of its text, so rows that share an id, or have none, do not answer for each other."""
    (own,) = unused(docs, "_th")
    marked = docs.withColumn(own, F.xxhash64("text"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "lang", "source", "text")
    judged = verdicts(map_docs(rows, statistics, STATS, ["doc_id", "th", "lang", "source"]), **options)
    bad = judged.filter(base_failed() | F.col("outlier")).select("doc_id", "th", "lang", "source").distinct()
    names = dict(zip(bad.columns, unused(marked, "_id", "_t", "_lang", "_source"), strict=True))
    same = [marked[own if c == "th" else c].eqNullSafe(F.col(n)) for c, n in names.items()]
    return marked.join(bad.withColumnsRenamed(names), same, "left_anti").drop(own)
