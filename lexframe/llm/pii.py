"""PII by anchor expansion: one Aho-Corasick pass finds at-signs, schemes, digits and identifier cues; local
parsers expand each anchor to its boundaries and validate it.

Anchors come in order of place, and each parser begins where the last span of its kind ends, so the cost grows with the
text, and no two spans of a kind overlap. Cues are found in any case.

Per row, in Arrow batches; no shuffle, no state. Addresses are those of mail, hosts and URLs with credentials; postal
addresses have no anchor and are not looked for. Defined cases: a null text is an empty one; very long texts are
scanned whole; null or repeated doc_ids pass through row by row; spans that begin together are listed in the order of
KINDS; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame, types as T

from .common import columns, map_docs

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "account", "url")
#: Fixed forms of the base kinds; a match lies in a run of the characters that its kind may have.
EMAIL_AFTER = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match of IP begins a run of digits: where it fails there, it fails further on in the run too.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMERIC = frozenset("0123456789 .()+-")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NOT_DIGIT = re.compile("[^0-9]+")
#: The method's own kinds: what may follow a cue.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?=(?:\x20?[A-Za-z0-9]){11})")
#: Characters that each country's IBANs have.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
COUNTRIES = {c: n for n, some in IBAN_LENGTHS.items() for c in some.split()}
SSN = re.compile(r"[\x20:#=]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
ACCOUNT = re.compile(r"(?:\x20?(?i:number|no\.?|nr\.?|#))?[\x20:#=]{1,3}([0-9][0-9-]{5,18}[0-9])(?![0-9-])")
URL = re.compile(r"://[^\s/@:]+:[^\s/@]+@[^\s]+")
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account"}
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@functools.cache
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("email", 1))
    found.add_word("://", ("url", 3))
    for cue, kind in CUES.items():
        found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def iban_end(text: str, start: int) -> int:
    """The end of the valid IBAN at start, or 0: so many letters and digits as its country has, with single spaces
    between them, up to the end of a word. Letters may be small."""
    left, at = COUNTRIES.get(text[start : start + 2].upper(), 0), start
    while left and at < len(text):
        c = text[at]
        if c.isascii() and c.isalnum():
            left -= 1
        elif c != " " or text[at - 1] == " ":
            return 0
        at += 1
    whole = not left and at > start and not (at < len(text) and text[at].isascii() and text[at].isalnum())
    return at if whole and iban_valid(text[start:at]) else 0


def ibans(text: str, at: int) -> list[tuple[int, int, int]]:
    """The valid IBANs from a place on, leftmost and not overlapping."""
    out = []
    while m := IBAN.search(text, at):
        at = iban_end(text, m.start())
        if at:
            out.append((m.start(), 4, at))
        else:
            at = m.start() + 1
    return out


def numbers(zone: str, at: int) -> list[tuple[int, int, int]]:
    """Base kinds within a maximal run of digits and what may stand between them."""
    out = []
    if zone.count(".") >= 3:
        out += [(at + m.start(), 1, at + m.end()) for m in IP.finditer(zone) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    if len(zone) >= 10:
        for m in CARD.finditer(zone):
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((at + m.start(), 2, at + m.end()))
        if "+" in zone:
            out += [(at + m.start(), 3, at + m.end()) for m in PHONE.finditer(zone) if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind. Anchors come in order of place, so the end of the last run or
    address bounds the next from the left: matches are leftmost and do not overlap."""
    out: list[tuple[int, int, int]] = []
    email_end = zone_end = url_end = 0
    ibans_found = False
    n = len(text)
    for last, (kind, width) in anchors().iter(text.encode().translate(_LOWER).decode()):
        start = last + 1 - width
        if kind == "digit":
            if start < zone_end:
                continue
            a, b = start, start + 1
            while a > zone_end and text[a - 1] in NUMERIC:
                a -= 1
            while b < n and text[b] in NUMERIC:
                b += 1
            zone_end = b
            if b - a >= 7:
                out += numbers(text[a:b], a)
        elif kind == "email":
            if start < email_end:
                continue
            a = start
            while a > email_end and text[a - 1] in LOCAL:
                a -= 1
            if a < start and (m := EMAIL_AFTER.match(text, start)):
                out.append((a, 0, m.end()))
                email_end = m.end()
        elif kind == "url":
            if start < url_end:
                continue
            a = start
            while a > url_end and text[a - 1].isascii() and text[a - 1].isalpha():
                a -= 1
            if a < start and (m := URL.match(text, start)):
                out.append((a, 7, m.end()))
                url_end = m.end()
        elif kind == "iban":
            if not ibans_found:  # all that follow the first cue, however far
                out += ibans(text, last + 1)
                ibans_found = True
        elif kind == "ssn":
            m = SSN.match(text, last + 1)
            if m and m[1][:3] not in ("000", "666") and m[1][0] != "9" and m[1][4:6] != "00" and m[1][7:] != "0000":
                out.append((m.start(1), 5, m.end(1)))
        elif m := ACCOUNT.match(text, last + 1):
            out.append((m.start(1), 6, m.end(1)))
    return sorted(set(out))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType())])
SPANS = T.StructType([T.StructField("spans", T.ArrayType(SPAN))])
DIGEST = columns("n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (start, kind, end), in code points, end exclusive."""
    return map_docs(docs, lambda raw: [([{"start": a, "kind": KINDS[k], "end": b} for a, k, b in find(raw.decode())],)], SPANS, ["doc_id"])


def _digest(raw: bytes) -> list[tuple]:
    spans = find(raw.decode())
    base = [x for x in spans if x[1] < 4]
    return [(*(sum(x[1] == k for x in base) for k in range(4)), hashlib.sha256(written(base).encode()).hexdigest(), written(spans))]


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: counts, digest of the base spans, all spans as text."""
    return map_docs(docs, _digest, DIGEST, ["doc_id"])
