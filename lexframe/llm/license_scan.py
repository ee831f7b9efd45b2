"""License scans: fuzzy search for short notices. Each notice is split into one more piece than the edits it may
have, so at least one piece occurs exactly (pigeonhole); the pieces are found in one Aho-Corasick pass, and the
regex library's bounded-error matching verifies the surroundings of each and reports span and edits.

What tells a license from another (a version, a short name) stands in brackets in its notice and must occur as it is,
and edits bring in letters and spaces only: "version 1 2" or "the mpl license" is no near match.

Per row, in Arrow batches; no shuffle, no state. Each piece that occurs is verified on its own surroundings, whose
length is bounded, so the cost grows with the text. Defined cases: a null text is an empty one; null or repeated
doc_ids pass through row by row; very long texts are scanned whole; matches at one start are listed by end, then in
the order of the notices; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import columns, map_docs

#: Fixed: base phrases and their labels; then the notices of the method's own, with theirs.
BASE = (("under the [mit] license", "mit"), ("apache license version [2]", "apache-2"), ("cc by nc", "cc-by-nc"))
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version [2 0]", "apache-2"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("gnu general public license version [3]", "gpl-3"),
    ("gnu general public license version [2]", "gpl-2"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("gnu general public license [v3]", "gpl-3"),
    ("gnu general public license [v2]", "gpl-2"),
    ("gnu general public license as published by the free software foundation either version [3]", "gpl-3"),
    ("gnu general public license as published by the free software foundation either version [2]", "gpl-2"),
    ("mozilla public license version [2 0]", "mpl-2"),
    ("mozilla public license v [2 0]", "mpl-2"),
    ("apache license v [2 0]", "apache-2"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
)
LABELS = tuple(label for _, label in BASE + NOTICES)
PHRASES = tuple(re.sub(r"[\[\]]", "", notice) for notice, _ in BASE + NOTICES)
#: Edits a notice may have: one for each so many characters, up to the most.
CHARS_AN_EDIT, MOST_EDITS = 10, 4
#: Bytes to a space or to lower case: what is left between spaces are the words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def edits(phrase: str) -> int:
    return min(MOST_EDITS, len(phrase) // CHARS_AN_EDIT)


def pieces(phrase: str) -> list[tuple[int, str]]:
    """The phrase cut into edits + 1 pieces: (place in the phrase, piece)."""
    n, k = len(phrase), edits(phrase) + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@functools.cache
def automaton() -> ahocorasick.Automaton:
    seeds: dict[str, list[tuple[int, int]]] = {}
    for i, phrase in enumerate(PHRASES):
        for at, piece in pieces(phrase):
            seeds.setdefault(piece, []).append((i, at))
    found = ahocorasick.Automaton()
    for piece, where in seeds.items():
        found.add_word(piece, (len(piece), where))
    found.make_automaton()
    return found


@functools.cache
def verifier(i: int) -> regex.Pattern:
    k, parts = edits(PHRASES[i]), re.split(r"[\[\]]", (BASE + NOTICES)[i][0])
    free = lambda x: f"(?:{regex.escape(x, literal_spaces=True)}){{e<={k}:[a-z ]}}"
    body = "".join(part if n % 2 else free(part) for n, part in enumerate(parts) if part)
    return regex.compile(rf"(?b)(?<= ){body}(?= )")


@functools.lru_cache(maxsize=4096)
def verified(i: int, zone: str) -> tuple[tuple[int, int, int], ...]:
    """(start, end, edits) of a notice's matches in the surroundings of a piece."""
    if PHRASES[i] not in zone and not edits(PHRASES[i]):
        return ()
    found = ((m.start(), m.end(), sum(m.fuzzy_counts)) for m in verifier(i).finditer(zone))
    return tuple(x for x in found if x[2] <= edits(PHRASES[i]) and x[1] > x[0])


def find(norm: str) -> list[tuple[int, int, int, int]]:
    """(start, end, notice, edits) in a text of words that each have one space on either side: all exact places, and
    near ones that overlap no better one of their notice."""
    exact, near = set(), set()
    for last, (width, where) in automaton().iter(norm):
        for i, at in where:
            start, n, k = last + 1 - width - at, len(PHRASES[i]), edits(PHRASES[i])
            if start > 0 and norm.startswith(f" {PHRASES[i]} ", start - 1):
                exact.add((i, start, start + n))
                continue
            a = max(0, start - k - 1)
            for x, y, errors in verified(i, norm[a : start + n + k + 1]):
                if errors:
                    near.add((i, a + x, a + y, errors))
    out = [(a, b, i, 0) for i, a, b in exact]
    taken = sorted(exact)
    starts: dict[int, tuple[list[int], int]] = {}
    for i in {x[0] for x in taken}:
        starts[i] = ([a for j, a, _ in taken if j == i], len(PHRASES[i]))
    kept: list[tuple[int, int, int, int]] = []
    for i, a, b, errors in sorted(near):
        if i in starts:
            at, n = starts[i]
            k = int(np.searchsorted(at, b))
            if k and at[k - 1] + n > a:
                continue
        if kept and kept[-1][2] == i and kept[-1][1] > a:  # the better of two that overlap, the first of two alike
            if errors < kept[-1][3]:
                kept[-1] = (a, b, i, errors)
            continue
        kept.append((a, b, i, errors))
    return sorted(out + kept)


SCHEMA = columns("n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, matches string")


def _scan(raw: bytes) -> list[tuple]:
    words = raw.translate(_TABLE).split()
    norm = f" {b' '.join(words).decode()} " if words else ""
    found = find(norm)
    if not found:
        return [(len(words), 0, None, None, "", "", 0.0, "")]
    spaces = np.flatnonzero(np.frombuffer(norm.encode("utf-32-le"), np.uint32) == 32)
    first = (np.searchsorted(spaces, [x[0] for x in found]) - 1).tolist()
    end = np.searchsorted(spaces, [x[1] for x in found]).tolist()
    base = [(p, LABELS[i]) for p, (_, _, i, errors) in zip(first, found, strict=True) if i < len(BASE) and not errors]
    return [
        (
            len(words),
            len(base),
            base[0][0] if base else None,
            base[-1][0] if base else None,
            ",".join(sorted({x for _, x in base})),
            ",".join(sorted({LABELS[x[2]] for x in found})),
            max(1 - errors / len(PHRASES[i]) for _, _, i, errors in found),
            ",".join(f"{LABELS[x[2]]}:{p}:{q}:{x[3]}" for x, p, q in zip(found, first, end, strict=True)),
        )
    ]


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base (places of base phrases), first_word and last_word (their least and greatest
    start), base_labels, labels (with the method's), score (1 less edits per character of the best match) and
    matches (label:first word:end word:edits of each)."""
    return map_docs(docs, _scan, SCHEMA, ["doc_id"])
def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base (places of base phrases), first_word and last_word (their least and greatest
    start), base_labels, labels (with the method's), score (1 less edits per character of the best match) and
    matches (label:first word:end word:edits of each)."""
    return map_docs(docs, _scan, SCHEMA, ["doc_id"])
