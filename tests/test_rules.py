import random
import re
import time

import pytest

from callmill.functions import redaction as r
from callmill.functions import rules
from callmill.functions.rules import Rule

SECRET = "0a1b2c3d4e5f60718293" + "a4b5c6d7e8f901223344"


def brute(text, table):
    """All rules over the text, then all places of what they find."""
    found = set()
    for rule in table:
        for m in re.finditer(rule.pattern, text):
            s = m.group(rule.group)
            if s and (not rule.entropy or rules.bits(s) > rule.entropy) and not any(re.search(a, s) for a in rule.allow):
                found.add(s)
    return sorted({(i, i + len(s)) for s in found for i in range(len(text)) if text.startswith(s, i)})


def test_same_spans_as_all_rules():
    rng = random.Random(2)
    parts = ["token", "api_key", "API-KEY", "secret", "=", " = ", '"', "'", SECRET, "aaaaaaaaaaaaaaaaaaaa", "abc12345def67890xyz", "npm_" + "a1" * 18, "glpat-" + "b2" * 10, "GHP_", "ghp_" + "c3" * 18, " ", "\n", "word", "1234567890123456", "AKIA" + "Q" * 16, "é"]
    hits = 0
    for _ in range(10_000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 10)))
        got = sorted(set(rules.engine(r.VENDOR_RULES).spans(text)))
        assert got == brute(text, r.VENDOR_RULES), text
        hits += bool(got)
    assert hits > 1000


def test_many_rules_take_no_longer():
    text = "some words of a long text, " * 4000 + f'token = "{SECRET}"'
    took = []
    for n in (10, 2000):
        table = tuple(Rule(f"r{i}", rf"mark{i}x[0-9]+", (f"mark{i}x",)) for i in range(n)) + r.VENDOR_RULES
        made = rules.Engine(table)
        began = time.process_time()
        for _ in range(5):
            assert list(made.spans(text)) == [(len(text) - 41, len(text) - 1)]
        took.append(time.process_time() - began)
    assert took[1] < 5 * took[0] + 0.2


@pytest.mark.parametrize(("text", "want"), [
    (f'token = "{SECRET}"', 'token = "REDACTED"'), (f"and {SECRET} before my_api_key={SECRET};", "and REDACTED before my_api_key=REDACTED;"), ('token = "aaaaaaaaaaaaaaaaaaaa1"', 'token = "aaaaaaaaaaaaaaaaaaaa1"'),
    ("token = some-words-of-a-name", "token = some-words-of-a-name"), (f"sha1 {SECRET[:20]}", f"sha1 {SECRET[:20]}"),
])
def test_assigned_credentials(text, want):
    assert r.mask_text(text) == want


def test_rules_of_the_caller(spark):
    table = (Rule("order number", r"order ([A-Z]{3}-[0-9]{4})", ("order",), 0.0, ("^TST",), 1),)
    assert r.mask_text("order ABC-1234, again ABC-1234; order TST-0001", (), table) == "order REDACTED, again REDACTED; order TST-0001"
    df = spark.createDataFrame([("order ABC-1234",), (None,), ('{"a":"order XYZ-0001"}',)], "t string")
    assert [x[0] for x in df.select(r.mask_records("t", (), table)).collect()] == ["order REDACTED", None, '{"a":"order REDACTED"}']
    assert list(rules.Engine(()).spans("x")) == [] and list(rules.Engine((Rule("all", "x+"),)).spans("axxb")) == [(1, 3)]
