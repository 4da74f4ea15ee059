"""Scanners against the patterns whose matches they find, and their time on texts that are made to be slow."""

import random
import re
import time

import pytest

from callmill.functions import redaction as r
from callmill.functions import scan

CASES = {
    "emails": (scan.emails, re.compile(r.EMAIL_PATTERN), 0, ["a", "b1", ".", "-", "_", "@", "@", "co", "x.io", " ", "%", "é", "9", "A"]),
    "pairs": (scan.keyword_pairs, re.compile(r.KEYWORD_PATTERN, re.I), 0, ["a=", "b_1=", "c", "=", " ", " ", "\n", '"', "'", '"x y"', "1", "k=v", "Z=9", "-", "_=", " é", "a=1 ", "b=2 ", " c=3"]),
    "fields": (scan.semicolon_fields, re.compile(r.SEMICOLON_PATTERN, re.I), 0, ["a=", "b c=", "x", "=", ";", ";", " ", "{", "}", "{x;y}", '"', '"q;r"', "1", "k=v", ";k=v", "-", "_", "\n", "é"]),
    "assigned": (lambda t: scan.assignments(t, r.DATABASES), re.compile(r.ASSIGNED_PATTERN, re.I), 2, ["db", "pg", "redis", "mongodb", "_", "-", "password", "pwd", "PASSWD", "=", "=", " ", "x", "9", '"', "'", '"v w"', ",", ";", "é", "\n", "my"]),
}


@pytest.mark.parametrize("name", CASES)
def test_same_spans_as_the_pattern(name):
    find, pattern, group, parts = CASES[name]
    rng, hits = random.Random(name), 0
    for _ in range(60_000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        want = [m.span(group) for m in pattern.finditer(text)]
        assert list(find(text)) == want, text
        hits += bool(want)
    assert hits > 300


@pytest.mark.parametrize(("piece", "end"), [
    ("a b c d e f ", "=x;"), ("a.", "@"), ("a=", ""), ("a={", ""), ("a=b;", ""), ("a={;", "}"), ("a=b ", ""), ('a="', ""), ("db_", "password=x"), ("db_", ""), ("pgpassword=", ""), ("db password = ", ""), ("a@b.", ""), ("a@", "b.co"), ("x_", "="), ("= ", ""),
    ("a='", ""), ("a=b;c=d;", ""), ("a=\n", ""), ("host=h user=u ", ""), ("server=h;uid=u;", "password=p"), ("@a.", "com"), ("a1.", "com@x"),
])
def test_a_megabyte_takes_seconds(piece, end):
    text = piece * (1_000_000 // len(piece)) + end
    began = time.process_time()
    r.spans_of(text, (r.EMAIL, r.PHONE))
    assert time.process_time() - began < 8
