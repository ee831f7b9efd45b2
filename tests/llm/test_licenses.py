"""License scans against an edit-distance table in plain Python, and their cost on long texts."""

import random
import re
import time

from lexframe.llm import license_scan

SCHEMA = "doc_id long, text string"


def distance(notice, text):
    """The least edits that make the notice of a part of the text between spaces: what is in brackets is exact, and
    edits bring in letters and spaces only."""
    chars, fixed, inside = [], [], False
    for c in notice:
        if c in "[]":
            inside = c == "["
        else:
            chars.append(c)
            fixed.append(inside)
    far, best = 10**6, 10**6
    may = lambda c: "a" <= c <= "z" or c == " "
    for at in [k + 1 for k, c in enumerate(text[:-1]) if c == " "]:
        row = [0]
        for i in range(len(chars)):
            row.append(row[-1] + (far if fixed[i] else 1))
        for j in range(at, min(len(text), at + len(chars) + 8)):
            new = [row[0] + (1 if may(text[j]) and not fixed[0] else far)]
            for i in range(len(chars)):
                between = i + 1 < len(chars) and fixed[i] and fixed[i + 1] or i + 1 == len(chars) and fixed[i]
                same = row[i] + (0 if chars[i] == text[j] else 1 if not fixed[i] and may(text[j]) else far)
                added = row[i + 1] + (1 if may(text[j]) and not between else far)
                new.append(min(same, added, new[i] + (far if fixed[i] else 1)))
            row = new
            if j + 1 < len(text) and text[j + 1] == " ":
                best = min(best, row[-1])
    return best


def test_against_edit_distance():
    rng = random.Random(13)
    notices = license_scan.BASE + license_scan.NOTICES
    for _ in range(250):
        i = rng.randrange(len(notices))
        text = list(license_scan.PHRASES[i])
        for _ in range(rng.randrange(6)):
            k, kind = rng.randrange(len(text)), rng.randrange(3)
            text[k : k + 1] = {0: [], 1: [rng.choice("abcxyz 123")], 2: [text[k], rng.choice("abcxyz 123")]}[kind]
        words = ["some", "text", *"".join(text).split(), "and", "more"]
        norm = f" {' '.join(words)} "
        found = license_scan.find(norm)
        for j, (notice, _) in enumerate(notices):
            least = distance(notice, norm)
            got = [x[3] for x in found if x[2] == j]
            assert bool(got) == (least <= license_scan.edits(license_scan.PHRASES[j])), (norm, notice, least, got)
            assert not got or min(got) == least, (norm, notice, least, got)


def test_versions_are_exact():
    labels = lambda t: license_scan._scan(t.encode())[0][5]
    assert labels("Apache License, Version 1.1") == labels("apache license version 1 2") == labels("Apache License, Version 20") == ""
    assert labels("Apache Licence, Version 2.0") == "apache-2"
    assert [labels(f"GNU General Public Licence version {k}") for k in "123"] == ["", "gpl-2", "gpl-3"]
    assert labels("under the mpl license") == labels("under the mixt license") == "" and labels("under the mit licens") == "mit"


def test_two_notices_side_by_side():
    got = license_scan.find(" licensed under the apache licence version 2 0 licensed under the apache license version 2 0 ")
    own = [(a, e) for a, _, i, e in got if license_scan.PHRASES[i].startswith("licensed")]
    assert own == [(1, 1), (47, 0)]


def test_cost_grows_with_the_text():
    rng = random.Random(3)
    varied = " ".join(f"under the {''.join(rng.choice('mitx') for _ in range(3))} license {''.join(rng.choice('abc') for _ in range(6))}" for _ in range(30_000))
    for text in ("under the mix license and " * 40_000, "all right reserved " * 50_000, "under the mit license " * 45_000, varied):
        began = time.process_time()
        license_scan._scan(text.encode())
        assert time.process_time() - began < 10, text[:30]


def test_cases(spark):
    """Null, empty and repeated rows, a very long text, clashing columns, an empty table."""
    long = "word " * 200_000 + "Released under the MIT License"
    rows = [(1, "CC-BY-NC"), (1, "CC-BY-NC"), (None, "cc by nc"), (None, None), (2, ""), (3, long)]
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, labels string, n_words long")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_base, r.first_word, r.labels) for r in license_scan.scan_licenses(docs).collect())
    assert got == sorted([(1, 3, 1, 0, "cc-by-nc")] * 2 + [(-1, 3, 1, 0, "cc-by-nc"), (-1, 0, 0, None, ""), (2, 0, 0, None, ""), (3, 200_005, 1, 200_001, "mit")], key=lambda x: (x[0], x[1]))
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0
    assert all(re.fullmatch(r"[a-z0-9 \[\]]+", notice) for notice, _ in license_scan.BASE + license_scan.NOTICES)
