import json
import random

import pytest
from pyspark.sql import functions as F

from callmill.functions import redaction as r

BOTH = (r.EMAIL, r.PHONE)
# made-up secrets, put together here so that nothing looks like a real one
HIGH = "kQ7" + "zR2mX9pL4vT8wB3nY6cJ1hF5dS0gA"
SB, SBP = "sb_" + "secret_", "sb" + "p_"


@pytest.mark.parametrize("mark", ["gho" + "_", "ghs" + "_", "npm" + "_"])
def test_vendor_marks(mark):
    assert r.mask_text(f"a {mark}{'a1' * 18} b") == "a REDACTED b"
    assert r.mask_text(f"a {mark}{'a1' * 17} b") == f"a {mark}{'a1' * 17} b"


@pytest.mark.parametrize("text", ["glpat" + "-" + "a1" * 10, "AI" + "za" + "a1-_x" * 7, "sk" + "_live_" + "a1" * 12, "xox" + "b-" + "1" * 11 + "-" + "2" * 11 + "-" + "ab" * 12, "hf" + "_" + "ab" * 17, "github" + "_pat_" + "a_" * 41])
def test_vendor_formats(text):
    assert r.mask_text(f"({text})") == "(REDACTED)"


def test_texts_that_skip_every_layer_hold_nothing():
    """What the trigger lets pass is masked by no layer, whatever the text."""
    rng = random.Random(5)
    parts = ["aB3", "kQ7zR2mX9pL4vT8wB3nY6cJ1hF5dS0gA", " ", "@", "=", "123", "-4567", "password", "PWD", "://", "AKIA", "Q" * 16, "a.io", ";", "\\u0040", '"', "{", "}", "host", "+1", "(212)", "x" * 22]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 6)))
        if not r._TRIGGER.search(text):
            assert r.merged([*r.secret_spans(text), *r.personal_spans(text, BOTH)]) == []


@pytest.mark.parametrize(("text", "want"), [
    ("plain words stay", "plain words stay"),
    (f"token {HIGH} end", "token REDACTED end"),
    (f"key={HIGH}", "REDACTED"),
    ("\\nmodel_controller_go", "\\nmodel_controller_go"),
    (SB + "a" * 19, SB + "a" * 19),
    (SB + "a" * 20, "REDACTED"),
    ("x" + SBP + "a" * 20, "xREDACTED"),
    ("sb_publishable_" + "a" * 30, "sb_publishable_" + "a" * 30),
    ("see postgres://u:pw@h/db now", "see REDACTED now"),
    ("redis://:pw@h/0", "REDACTED"),
    ("https://example.com/a:b", "https://example.com/a:b"),
    ("jdbc:mysql://h/db?user=u&password=s3;", "REDACTED;"),
    ("jdbc:mysql://h/db?user=u&password=changeme", "jdbc:mysql://h/db?user=u&password=changeme"),
    ("host=h user=u password=s3cr dbname=d", "REDACTED"),
    ("host=h user=u dbname=d", "host=h user=u dbname=d"),
    ("Server=h;User Id=u;Password=s3cr.", "REDACTED."),
    ("APP_DB_PASSWORD='s3cr' x", "APP_DB_PASSWORD='REDACTED' x"),
    ("mydbpassword=s3cr", "mydbpassword=s3cr"),
    ("PGPASSWORD=<db-password>", "PGPASSWORD=<db-password>"),
    ("mail a.b@x.example.com!", "mail [REDACTED_EMAIL]!"),
    ("éfoo@x.com", "é[REDACTED_EMAIL]"),
    ("noreply@x.com and NoReply@y.com", "noreply@x.com and NoReply@y.com"),
    ("call +1 (555) 010-1234, (555) 010-1234, 555-010-1234", "call [REDACTED_PHONE], [REDACTED_PHONE], [REDACTED_PHONE]"),
    ("version 1.234.567.8901", "version 1.234.567.8901"),
    (f"{SB}{'a' * 20}{SB}{'b' * 20}", "REDACTED"),
])
def test_text(text, want):
    assert r.mask_text(text, BOTH) == want


def test_personal_data_is_off_by_default():
    assert r.mask_text("a@b.example.com") == "a@b.example.com"


@pytest.mark.parametrize("value", ["", "  ", "changeme", "<db-password>", "${X}", "***", "xxx", "XXX", "'redacted'", "[REDACTED]"])
def test_placeholders(value):
    assert r.is_placeholder(value)


@pytest.mark.parametrize("value", ["xx", "<A>", "<ab>", "hunter2", "x.x"])
def test_not_placeholders(value):
    assert not r.is_placeholder(value)


def masked(value):
    return json.loads(r.mask_record(json.dumps(value)))


def test_json_fields():
    assert masked({"host": "h", "user": "u", "password": "pw", "other": {"pwd": "pw2"}}) == {"host": "h", "user": "u", "password": "REDACTED", "other": {"pwd": "REDACTED"}}
    assert masked({"password": "pw"}) == {"password": "pw"}
    assert masked({"db-password": "two words"}) == {"db-password": "REDACTED"}
    assert masked({"session_id": HIGH, "signature": HIGH, "cwd": HIGH, "ids": [HIGH, [HIGH]], "note": HIGH}) == {"session_id": HIGH, "signature": HIGH, "cwd": HIGH, "ids": [HIGH, [HIGH]], "note": "REDACTED"}
    assert masked({"id": {"note": HIGH}}) == {"id": {"note": "REDACTED"}}
    assert masked({"type": "image", "data": HIGH}) == {"type": "image", "data": HIGH}
    assert masked({"type": "images", "data": HIGH}) == {"type": "images", "data": "REDACTED"}
    assert masked({HIGH: "x", "a": [HIGH]}) == {HIGH: "x", "a": ["REDACTED"]}
    # a value found somewhere is masked under the same key everywhere
    assert masked([{"host": "h", "user": "u", "password": "pw"}, {"password": "pw"}]) == [{"host": "h", "user": "u", "password": "REDACTED"}, {"password": "REDACTED"}]


def test_bytes_are_kept():
    text = '{ "n" : 1.10, "big":9007199254740993 ,"e":1e5, "t":"a\\u00e9\\/b", "m":"x@y.example.com" }'
    assert r.mask_record(text) == text.replace("x@y.example.com", "[REDACTED_EMAIL]")
    clean = '{"a":[1, 2,\n 3]}'
    assert r.mask_record(clean) == clean
    escaped = '{"m":"x\\u0040y.example.com"}'
    assert r.mask_record(escaped) == '{"m":"[REDACTED_EMAIL]"}'


def test_lines():
    text = f'{{"id":"{HIGH}"}}\n\nnot json {HIGH}\n{{"n":"{HIGH}"}}\n'
    assert r.mask_record(text) == f'{{"id":"{HIGH}"}}\n\nnot json REDACTED\n{{"n":"REDACTED"}}\n'


def test_masking_twice_changes_nothing():
    rng = random.Random(4)
    parts = [HIGH, "a@b.example.com", "DB_PASSWORD=zz9", "word", "host=h user=u password=q1", "[", '"', "\\", "é", "=", ";", "+1 555 010 1234"]
    for _ in range(300):
        once = r.mask_record(" ".join(rng.choices(parts, k=8)))
        assert r.mask_record(once) == once


def test_long_inputs_are_fast():
    r.mask_text("word here " * 20_000 + "; a=b")
    r.mask_text("k=v " * 20_000)


def test_columns(spark):
    df = spark.createDataFrame([("mail a@b.example.com",), (None,), ("",)], "t string")
    got = [x[0] for x in df.select(r.mask_records(F.col("t"))).collect()]
    assert got == ["mail [REDACTED_EMAIL]", None, ""]
    spans = df.select(r.text_spans(F.col("t")).alias("s")).first()["s"]
    assert [(s["start"], s["end"], s["label"]) for s in spans] == [(5, 20, "EMAIL")]
