"""Personal data in long texts without spaces, and cues in any case."""

import random
import time

import pytest

from lexframe.llm import pii


def found(text, *kinds):
    return [(pii.KINDS[k], text[a:b]) for a, k, b in pii.find(text) if not kinds or pii.KINDS[k] in kinds]


@pytest.mark.parametrize("unit", ["http://a:b@", "http://a:b@c ", "a@b.c@", "a@", "@", "://", "x://y:", "1.1", "+1", "1 ", "....1", "IBAN", "IBAN DE89", "DE89", "account 1", "ssn ", "1", "é@é", "a.b-c@d-e.f+"])
def test_a_megabyte_takes_seconds(unit):
    text = unit * (1_000_000 // len(unit))
    began = time.time()
    pii.find(text)
    assert time.time() - began < 12  # a quadratic search would take minutes


def test_spans_of_a_kind_are_disjoint():
    rng = random.Random(8)
    units = ["http://", "a:b@", "ftp://u:p@h/x", "me@x.org", "@", "1.2.3.4", "+1 555 010 9999", "4111 1111 1111 1111", "IBAN GB82WEST12345698765432", "ssn 123-45-6789", "acct 00123-4567", " ", "é", "\n", ":", "/"]
    for _ in range(300):
        text = "".join(rng.choices(units, k=rng.randint(1, 30)))
        last = {}
        for a, k, b in pii.find(text):
            assert a >= last.get(k, 0) and b > a, text
            last[k] = b
    assert found("http://a:b@http://c:d@e f", "url") == [("url", "http://a:b@http://c:d@e")]
    assert found("http://a:b@x ftp://c:d@y", "url") == [("url", "http://a:b@x"), ("url", "ftp://c:d@y")]


def test_cues_in_any_case():
    assert found("ACCT 1234567") == [("account", "1234567")] and found("Account NUMBER 1234567") == [("account", "1234567")]
    assert found("SOCIAL SECURITY 123-45-6789") == [("ssn", "123-45-6789")]
    assert found("iBaN DE89370400440532013000") == [("iban", "DE89370400440532013000")]
    assert found("IBAN xDE89370400440532013000") == []  # in the middle of a word
    assert found("ÀÉ ACCT 1234567") == [("account", "1234567")]  # places are code points of the text as it is
    assert pii.COUNTRIES["SO"] == 23
