"""Secret scans: fixed credential patterns plus a battery of randomness tests with false-discovery control.

The battery asks of a long token, and of its parts between separators, whether its characters could be drawn at
random from the encoding that they are of. Four tests (chi-squared of the characters and of their classes, runs,
serial correlation) are not independent, since they look at the same characters, so they are combined by Cauchy's
method, which allows that.

What is controlled is the share of language among the tokens reported. Its null distribution is taken from the words
and numbers of all texts, of any script: they are counted, and each word is drawn in proportion to a power of its
count (so rare words, which look more random, weigh more than in the texts), numbers as other digits of their length.
Draws in random order, joined in the ways in which identifiers are written (hyphens, run together, capitals at the
heads, all capitals, numbers alone; in every other group with counters after some words), make tokens of each length that go through the same battery. Letters of other
alphabets count as Latin letters by rule, signs of scripts without an alphabet as syllables: what a token of letters
looks like depends on their frequencies, not on their shapes. The p-value of a candidate is the share of such tokens
of its length that have its encoding and look at least as random. Benjamini-Hochberg over all candidates at `rate`
says from which p-value on a candidate is reported.

Everything is DataFrame functions. A document's spans are found once and written as a narrow table; the
thresholds come from two histograms (encodings x lengths x bins, a fixed number of rows). Places are running sums in
chunks, so the cost of a text grows with its length, however many matches it has.

Defined cases: a null text is an empty one; very long texts are scanned whole; null or repeated doc_ids pass through
row by row; where the words of all texts make fewer tokens of a length than 1 / `rate`, language cannot be told from
chance: no candidate of that length is reported, and `unjudged` counts those of the row; spans that begin together are listed in the order of KINDS, then by end; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

#: Fixed patterns of the base kinds, in the order in which ties at one start are listed.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"  # maximal runs, so the same as all runs of which those of 32 or more stay
KINDS = ("assign", "access", "hex", "random")
#: What the battery looks at: runs of an encoding's characters, long enough for the tests to have power.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Its parts, as long: after a name and '=', in a path, after a prefix, between any of the separators.
PARTS = (r"[A-Za-z0-9+/_-]{20,}", r"[A-Za-z0-9+_-]{20,}", r"[A-Za-z0-9+/]{20,}", r"[A-Za-z0-9+]{20,}")
#: Encodings that are inferred, in order of preference: pattern and alphabet.
ENCODINGS = (
    (r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    (r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    (r"^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789"),
    (r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    (r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
#: What is not of a class: digits, small letters, capitals, signs.
CLASSES = ("[^0-9]+", "[^a-z]+", "[^A-Z]+", "[0-9A-Za-z]+")
#: Lengths from which a stratum begins: short tokens are hard to tell from random ones.
LENGTHS = (20, 24, 32, 48, 80)
#: What language is made of: runs of letters or digits. Texts without spaces give pieces of this length.
WORD = r"\p{L}{1,24}|[0-9]{1,8}"
#: A word of n occurrences is drawn DRAWS times n to this power, and GROUP draws, about, are joined at a time.
DRAWS, POWER, GROUP = 2, 0.75, 64
#: Draws that a task joins to tokens, about: their number of tasks grows with the words, not the task.
TASK_DRAWS = 250_000
#: One word in so many has a counter of one to four digits after it, in every other group: versions, years, copies.
COUNTERS = 12
#: Ways in which the words of a group are joined.
WAYS = 5
P_BINS = 200
CHUNK = 256
NO_SPANS = "array<struct<start:int,end:int,match:string>>"


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each of the values, op over all before it, from 0: in chunks, so that no long array is copied for each."""
    zero, empty = F.lit(0), F.array().cast("array<int>")
    step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    start = lambda at: F.struct(at.alias("at"), empty.alias("out"))
    cut_up = lambda v: F.transform(F.sequence(zero, F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda k: F.slice(v, k * CHUNK + 1, F.lit(CHUNK)))
    heads = lambda chunks: F.aggregate(F.transform(chunks, lambda c: F.aggregate(c, zero, op)), start(zero), step, lambda acc: acc["out"])
    within = lambda chunks: F.flatten(F.zip_with(chunks, heads(chunks), lambda c, h: F.aggregate(c, start(h), step, lambda acc: acc["out"])))
    return let(values, lambda v: F.when(F.size(v) > 0, let(cut_up(v), within)).otherwise(empty))


def spans(text: Column, pattern: str) -> Column:
    """Matches of a pattern, leftmost and non-overlapping, as (start, end, match) in code points.

    The pieces between matches and the matches themselves tile the text, so their lengths give the places.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.zip_with(pieces, found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("n"), m.alias("match")))
    placed = lambda tiles: F.zip_with(tiles, running(F.transform(tiles, lambda x: x["gap"] + x["n"]), lambda a, b: a + b), lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["n"]).alias("end"), x["match"].alias("match")))
    return F.when(text.rlike(pattern), let(F.filter(sized, lambda x: x["n"].isNotNull()), placed)).otherwise(F.array().cast(NO_SPANS))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def log_tail(z: Column, sides: int = 1) -> Column:
    """Logarithm of the upper tail (or both) of the normal distribution, by a polynomial good to 1e-7
    (Abramowitz and Stegun 26.2.17)."""
    powers = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = lambda z, t: F.exp(-z * z / 2) / 2.5066282746310002 * powers(t)
    both = lambda z, q: F.log(F.greatest(F.least(sides * F.when(z >= 0, q).otherwise(1 - q), F.lit(1.0)), F.lit(1e-300)))
    return let(z, lambda z: let(1 / (1 + 0.2316419 * F.abs(z)), lambda t: let(upper(z, t), lambda q: both(z, q))))


def encoding_of(token: Column) -> Column:
    return F.coalesce(*(F.when(token.rlike(p), F.lit(k)) for k, (p, _) in enumerate(ENCODINGS)))


def plain(token: Column, encoding: Column) -> Column:
    """The token in its alphabet's characters."""
    return F.translate(F.regexp_replace(F.when(encoding == 0, F.lower(token)).otherwise(token), "=+$", ""), "-_=", "+/+")


def class_z(s: Column, encoding: Column) -> Column:
    """Chi-squared of the numbers of digits, small letters, capitals and signs, as a normal value (Wilson and Hilferty)."""
    n = F.length(s).cast("double")
    seen = [F.length(F.regexp_replace(s, p, "")) for p in CLASSES]
    shares = [[len(re.sub(p, "", abc)) / len(abc) for p in CLASSES] for _, abc in ENCODINGS]
    expected = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in shares)), encoding + 1)
    odd = sum((F.when(expected(k) > 0, F.pow(seen[k] - n * expected(k), 2) / (n * expected(k))).otherwise(0.0) for k in range(len(CLASSES))), F.lit(0.0))
    free = F.element_at(F.array(*(F.lit(float(max(1, sum(e > 0 for e in x) - 1))) for x in shares)), encoding + 1)
    return (F.pow(odd / free, 1 / 3) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))


def battery(s: Column, encoding: Column, z_class: Column) -> Column:
    """p: the chance that characters drawn uniformly from the inferred alphabet look at least as odd. Chi-squared of
    the characters, chi-squared of the classes, runs above the middle, serial correlation."""
    alphabets = F.array(*(F.lit(a) for _, a in ENCODINGS))
    x = F.struct(encoding.alias("encoding"), F.element_at(alphabets, encoding + 1).alias("abc"), s.alias("s"), z_class.alias("z_class"))
    return let(let(let(let(x, _counted), _moments), _scores), _combined)


def _counted(x: Column) -> Column:
    """Numbers of the alphabet's characters and the places of the token's characters in it."""
    letters = F.filter(F.split(x["abc"], ""), lambda c: c != "")
    count = lambda c: (F.length(x["s"]) - F.length(F.replace(x["s"], c, F.lit("")))).cast("double")
    places = F.transform(F.split(x["s"], ""), lambda c: F.instr(x["abc"], c).cast("double") - 1)
    return F.struct(
        x["z_class"].alias("z_class"), F.length(x["s"]).cast("double").alias("n"), F.length(x["abc"]).cast("double").alias("k"),
        F.transform(letters, count).alias("counts"), F.filter(places, lambda v: v >= 0).alias("v"),
    )


def total(values: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, y: a + of(y))


def _moments(x: Column) -> Column:
    v, m = x["v"], F.size(x["v"])
    squares = total(x["counts"], lambda c: c * c)
    pairs = F.zip_with(F.slice(v, 1, m - 1), F.slice(v, 2, m - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.struct(
        x["z_class"].alias("z_class"), x["n"].alias("n"), x["k"].alias("k"), v.alias("v"), pairs.alias("pairs"), (x["k"] / x["n"] * squares - x["n"]).alias("chi"),
        (total(v, lambda y: y) / m).alias("mean"), total(v, lambda y: F.when(y >= x["k"] / 2, 1.0).otherwise(0.0)).alias("high"), m.cast("double").alias("m"),
    )


def _scores(x: Column) -> Column:
    n, m, high = x["n"], x["m"], x["high"]
    expected = 2 * high * (m - high) / m + 1
    runs = 1 + total(x["pairs"], lambda y: F.when((y["a"] >= x["k"] / 2) != (y["b"] >= x["k"] / 2), 1.0).otherwise(0.0))
    return F.struct(
        x["z_class"].alias("z_class"), m.alias("m"), expected.alias("expected"), runs.alias("runs"), ((expected - 1) * (expected - 2) / (m - 1)).alias("spread"),
        ((x["chi"] - (x["k"] - 1)) / F.sqrt(2 * (x["k"] - 1) * (1 - 1 / n))).alias("z_chi"),
        total(x["v"], lambda y: (y - x["mean"]) * (y - x["mean"])).alias("var"), total(x["pairs"], lambda y: (y["a"] - x["mean"]) * (y["b"] - x["mean"])).alias("serial"),
    )


def _combined(x: Column) -> Column:
    """Cauchy's combination of the tests' p-values, which need not be independent."""
    z_runs = F.when(x["spread"] > 1e-9, F.abs(x["runs"] - x["expected"]) / F.sqrt(x["spread"])).otherwise(10.0)
    z_serial = F.when(x["var"] > 1e-9, F.abs(x["serial"] / x["var"] + 1 / x["m"]) * F.sqrt(x["m"])).otherwise(10.0)
    logs = F.array(log_tail(x["z_chi"]), log_tail(x["z_class"]), log_tail(z_runs, 2), log_tail(z_serial, 2))
    # tan(pi (1/2 - p)) is 1 / (pi p) for small p; a p of nearly 1 must not outweigh a small one
    tails = F.transform(logs, lambda q: let(F.least(F.exp(q), F.lit(0.99)), lambda p: F.when(p < 1e-8, 1 / (math.pi * F.greatest(p, F.lit(1e-60)))).otherwise(F.tan((0.5 - p) * math.pi))))
    return let(total(tails, lambda t: t) / 4, lambda t: F.when(t > 1e7, 1 / (math.pi * t)).otherwise(0.5 - F.atan(t) / math.pi))


def stratum(token: Column, encoding: Column) -> Column:
    return (sum((F.when(F.length(token) >= n, 1).otherwise(0) for n in LENGTHS), F.lit(0)) * 8 + encoding).cast("int")


def bin_of(s: Column, encoding: Column, z_class: Column, floor: float) -> Column:
    """Ten bins for each power of ten of p. The class test alone, where it gives a fifth of the floor or less, puts p
    below the floor, whatever the other three say (each adds -32 at least to Cauchy's sum); such tokens have the last bin."""
    p = lambda q: F.least(F.floor(-F.log10(q) * 10).cast("int"), F.lit(P_BINS))
    return F.when(log_tail(z_class) <= math.log(floor / 5), P_BINS).otherwise(let(battery(s, encoding, z_class), p))


def cell(token: Column, floor: float) -> Column:
    """(stratum, bin) of a token."""
    classed = lambda e: let(plain(token, e), lambda s: let(class_z(s, e), lambda z: bin_of(s, e, z, floor)))
    return let(encoding_of(token), lambda e: F.struct(stratum(token, e).alias("stratum"), classed(e).alias("bin")))


def candidates(text: Column) -> Column:
    """The runs of TOKEN and the parts of each, once: arrays of (start, end, match), a run's first."""
    moved = lambda x, at: F.struct((at + x["start"]).alias("start"), (at + x["end"]).alias("end"), x["match"].alias("match"))
    split = lambda x: F.filter(F.concat(*(spans(x["match"], p) for p in PARTS)), lambda y: F.length(y["match"]) < F.length(x["match"]))
    parts = lambda x: F.when(x["match"].rlike("[/=_-]"), F.array_distinct(split(x))).otherwise(F.array().cast(NO_SPANS))
    return F.transform(spans(text, TOKEN), lambda x: F.concat(F.array(x), F.transform(parts(x), lambda y: moved(y, x["start"]))))


def latin(word: Column) -> Column:
    """The word in Latin letters, by a rule on code points: another alphabet's letters become letters, signs of scripts
    without an alphabet a consonant and a vowel; capitals stay capitals."""
    pick = lambda letters, at: F.substring(F.lit(letters), at.cast("int") % len(letters) + 1, F.lit(1))
    syllable = lambda c: F.concat(pick("bcdfghjklmnpqrstvwxyz", c), pick("aeiou", c / 21))
    written = lambda c: F.when(c < 128, F.char(c)).when(c < 0x2E80, pick("abcdefghijklmnopqrstuvwxyz", c)).otherwise(syllable(c))
    sign = lambda c: let(written(F.ascii(F.lower(c))), lambda x: F.when(c == F.lower(c), x).otherwise(F.upper(x)))
    return F.when(word.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.filter(F.split(word, ""), lambda c: c != ""), sign), "")).otherwise(word)


def vocabulary(texts: DataFrame) -> DataFrame:
    """(w, n): the words of the texts (column t) outside of long tokens with their numbers; all digits count as 0."""
    words = texts.select(F.explode(F.regexp_extract_all(F.regexp_replace("t", TOKEN, " "), F.lit(WORD), F.lit(0))).alias("w"))
    return words.select(F.when(F.col("w") < ":", F.translate("w", "123456789", "0" * 9)).otherwise(F.col("w")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


def language(texts: DataFrame) -> DataFrame:
    """Tokens (column x) of the lengths of the strata, made of the words of the texts (column t). A group of draws is
    written in one way, which its number gives, and cut into tokens of one length after the other."""
    words = cut(vocabulary(texts), "words").withColumn("times", (DRAWS * F.ceil(F.pow("n", F.lit(POWER)))).cast("long"))
    n_draws = words.agg(F.sum("times").alias("n")).first().n or 0
    n_groups, n_parts = max(1, n_draws // GROUP), n_draws // TASK_DRAWS + 1
    group = F.pmod(F.xxhash64("k", "w", F.lit("group")), F.lit(n_groups))
    # only the word and the draw's number are shuffled, once: all else of a draw follows from them on the other side
    dealt = words.select("w", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("k")).withColumn("part", F.pmod(group, F.lit(n_parts)).cast("int"))
    drawn = dealt.repartitionById(n_parts, "part").withColumns({"at": F.xxhash64("w", "k"), "g": group})
    digits = F.left(F.lpad(F.pmod("at", F.lit(10**8)).cast("string"), 8, "0"), F.length("w"))
    number = F.col("w").startswith("0")
    draws = drawn.select("part", "g", "at", number.alias("number"), F.when(number, digits).otherwise(latin(F.col("w"))).alias("x"))
    counter = F.right(F.abs("at").cast("string"), F.pmod(F.shiftright("at", 8), F.lit(4)).cast("int") + 1)
    counted = ~F.col("number") & (F.floor(F.col("g") / WAYS) % 2 == 1) & (F.pmod("at", F.lit(COUNTERS)) == 0)
    draws = draws.withColumn("x", F.when(counted, F.concat("x", counter)).otherwise(F.col("x")))
    groups = draws.groupBy("part", "g").agg(F.array_sort(F.collect_list(F.struct("at", "number", "x"))).alias("xs"))
    words_of = lambda xs: F.transform(xs, lambda x: x["x"])
    heads = F.transform("xs", lambda x: F.concat(F.upper(F.left(x["x"], F.lit(1))), F.substring(x["x"], F.lit(2), F.length(x["x"]))))
    together = F.array_join(words_of(F.col("xs")), "")
    numbers = F.array_join(words_of(F.filter("xs", lambda x: x["number"])), "")
    ways = [F.array_join(words_of(F.col("xs")), "-"), together, F.array_join(heads, ""), F.upper(together), numbers]
    joined = groups.select(F.element_at(F.array(*ways), (F.col("g") % WAYS + 1).cast("int")).alias("s"))
    # a group's text is cut again and again by the lengths in turn, so that long groups give more tokens
    rounds = F.sequence(F.lit(0), F.floor(F.length("s") / sum(LENGTHS)).cast("int"))
    heads_at = [sum(LENGTHS[:i]) for i in range(len(LENGTHS))]
    made = F.transform(rounds, lambda r: F.array(*(F.substring(F.col("s"), r * sum(LENGTHS) + at + 1, F.lit(n)) for at, n in zip(heads_at, LENGTHS, strict=True))))
    return joined.select(F.explode(F.flatten(made)).alias("x")).filter(F.length("x").isin(*LENGTHS))


def histogram(tokens: DataFrame, floor: float) -> DataFrame:
    """(stratum, bin, count) of the tokens (column x), worked out by columns, as there are many."""
    x, e, s, z = (F.col(c) for c in "xesz")
    classed = tokens.withColumn("e", encoding_of(x)).withColumn("s", plain(x, e)).withColumn("z", class_z(s, e))
    return classed.select(stratum(x, e).alias("stratum"), bin_of(s, e, z, floor).alias("bin")).groupBy("stratum", "bin").count()


def limits(seen: DataFrame, null: DataFrame, rate: float) -> DataFrame:
    """The greatest bin that is reported of each stratum, from the histograms (stratum, bin, count) of the candidates
    and of language. p is the share of a length's language tokens with that encoding and at most that bin."""
    length = F.floor(F.col("stratum") / 8)
    cells = seen.withColumn("kind", F.lit(1)).unionByName(null.withColumn("kind", F.lit(0)))
    of_length, as_random = Window.partitionBy(length), Window.partitionBy("stratum").orderBy("bin").rangeBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("kind") == 0, F.col("count")).otherwise(0)
    p = (1 + F.sum(own).over(as_random)) / (1 + F.sum(own).over(of_length))
    # some thousand rows at most, whatever the input: one window over all of them
    ranked = cells.withColumn("p", p).filter("kind = 1").withColumns({"rank": F.sum("count").over(Window.orderBy("p").rangeBetween(Window.unboundedPreceding, 0)), "m": F.sum("count").over(Window.partitionBy())})
    last = ranked.withColumn("last", F.max(F.when(F.col("p") <= rate * F.col("rank") / F.col("m"), F.col("p"))).over(Window.partitionBy()))
    return last.filter(F.col("p") <= F.col("last")).groupBy("stratum").agg(F.max("bin").alias("upto"))


def outermost(found: Column) -> Column:
    """Of (start, end, match) those that lie in no other."""
    ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("less"), x["match"].alias("match"))))
    reach = lambda xs: F.zip_with(xs, running(F.transform(xs, lambda x: -x["less"]), lambda a, b: F.greatest(a, b)), lambda x, upto: F.struct(x["start"].alias("start"), (-x["less"]).alias("end"), x["match"].alias("match"), upto.alias("upto")))
    outer = lambda xs: F.filter(reach(xs), lambda x: x["end"] > x["upto"])
    return F.transform(let(ordered, outer), lambda x: F.struct(x["start"], x["end"], x["match"]))


def find_secrets(docs: DataFrame, rate: float = 0.01, floor: float = 1e-3) -> DataFrame:
    """doc_id, spans: array of (start, kind, end, match), kind an index of KINDS, and unjudged: candidates of a length
    of which language has too few tokens to tell.

    Of the tokens reported as random, the expected share of language is at most `rate`; none is reported whose
    battery says that a random token looks so with a chance of at most `floor`. A part of what is reported is not
    reported again.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kind = lambda found, k: F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), x["match"].alias("match")))
    assign = F.filter(spans(F.col("t"), ASSIGN), lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= 8)
    access = F.filter(spans(F.col("t"), ACCESS), lambda x: F.length(x["match"]) >= 16)
    tokens = F.transform(candidates(F.col("t")), lambda run: F.transform(run, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"), cell(x["match"], floor).alias("cell"))))
    texts = docs.select("doc_id", text.alias("t"))
    found = cut(texts.select("doc_id", F.concat(kind(assign, 0), kind(access, 1), kind(spans(F.col("t"), HEX), 2)).alias("base"), F.flatten(tokens).alias("tokens")), "secrets")
    seen = found.select(F.explode("tokens").alias("x")).groupBy("x.cell.stratum", "x.cell.bin").count()
    null = cut(histogram(language(texts), floor), "language")
    # a row for each stratum that has a limit: at most encodings times lengths, whatever the input
    upto = F.array(*(F.struct(F.lit(r.stratum).alias("stratum"), F.lit(r.upto).alias("upto")) for r in limits(cut(seen, "seen"), null, rate).collect())).cast("array<struct<stratum:int,upto:int>>")
    enough = [r.length for r in null.groupBy(F.floor(F.col("stratum") / 8).alias("length")).agg(F.sum("count").alias("n")).filter(F.col("n") >= 1 / rate).collect()]
    most = int(-10 * math.log10(floor))
    random = F.filter("tokens", lambda x: (x["cell"]["bin"] < most) & F.exists(upto, lambda y: (y["stratum"] == x["cell"]["stratum"]) & (x["cell"]["bin"] <= y["upto"])))
    unjudged = F.filter("tokens", lambda x: (x["cell"]["bin"] < most) & ~F.floor(x["cell"]["stratum"] / 8).isin(enough))
    return found.select("doc_id", F.array_sort(F.concat("base", kind(outermost(random), 3))).alias("spans"), F.size(unjudged).cast("long").alias("unjudged"))


def digest(found: DataFrame) -> DataFrame:
    """The query's columns: counts, digest of the base spans, all spans as text."""
    names = F.array(*(F.lit(k) for k in KINDS))
    written = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)),
        F.sha2(written(F.filter("spans", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        F.col("unjudged").alias("n_unjudged"),
    )
