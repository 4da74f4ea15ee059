"""Masking of secrets and personal data, in text and in JSON.

Detection layers give spans of the original string; spans that overlap or
touch are merged, and each is replaced by one token.  JSON is masked inside
its string values alone: the rest of the text keeps its bytes.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import json_text, scan
from .rules import Engine, Rule, engine

# ---- Fixed values: these have to equal what other readers of the data expect.
SECRET_TOKEN = "REDACTED"
EMAIL, PHONE = "EMAIL", "PHONE"
ENTROPY_ABOVE = 4.5
PLACEHOLDERS = [
    "redacted", "[redacted]", "<redacted>", "changeme", "example", "placeholder",
    "your_password", "your_db_password", "your_secret", "secret_here",
]
ALLOWED_EMAIL_PREFIXES = ["noreply@", "actions@"]
ALLOWED_EMAIL_SUFFIXES = ["@users.noreply.github.com", "@noreply.github.com"]
HOST_KEYS = {"host", "hostname", "server", "addr", "address", "datasource", "data_source"}
USER_KEYS = {"user", "username", "userid", "user_id", "uid"}
PATH_KEYS = {"filepath", "file_path", "cwd", "root", "directory", "dir", "path"}
PAYLOAD_TYPES = {"image", "image_url", "base64"}
# White space and word boundaries are ASCII, in both regular expression engines.
_S = r"[\t\n\f\r ]"
_NOT_S = r"[^\t\n\f\r "
_EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
RUN_PATTERN = r"[A-Za-z0-9+_=-]{10,}"
EMAIL_PATTERN = rf"{_EDGE}[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{{2,}}{_EDGE}"
PHONE_PATTERN = (
    rf"(?:\+1(?:[-.]|{_S})?\(?[0-9]{{3}}\)?(?:[-.]|{_S})?[0-9]{{3}}(?:[-.]|{_S})?[0-9]{{4}}"
    rf"|(?:1(?:-|{_S}))?\([0-9]{{3}}\){_S}?[0-9]{{3}}(?:[-.]|{_S})?[0-9]{{4}}"
    rf"|(?:1(?:-|{_S}))?[0-9]{{3}}(?:-|{_S})[0-9]{{3}}(?:-|{_S})[0-9]{{4}})"
)
PROVIDER_MARKS = ["sb_secret_", "sbp_"]
PROVIDER_PATTERNS = [PROVIDER_MARKS[0] + "[A-Za-z0-9_-]{20,}", PROVIDER_MARKS[1] + "[a-z0-9_-]{20,}"]
URI_PATTERN = rf"{_EDGE}[a-z][a-z0-9+.-]{{1,31}}://{_NOT_S}/?#@\"'`<>:]*:{_NOT_S}/?#@\"'`<>]+@{_NOT_S}\"'`<>]+"
DATABASES = "db|database|pg|postgres|postgresql|mysql|mariadb|redis|mongo|mongodb|sqlserver|mssql|jdbc"
KEY_PATTERN = rf"(?:{DATABASES})(?:[_-]+[a-z0-9]+)*[_-]*(?:password|passwd|pwd)"
_QUOTED = "\"[^\"]*\"|'[^']*'"
JDBC_PATTERN = rf"{_EDGE}jdbc:{_NOT_S}\"'<>`]+"
DATABASE_URL_PATTERN = rf"{_EDGE}(?:postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|redis)://{_NOT_S}\"'<>`]+"
_PAIR = rf"[a-z_][a-z0-9_]*=(?:{_QUOTED}|{_NOT_S}\"']+)"
KEYWORD_PATTERN = rf"{_EDGE}{_PAIR}(?:{_S}+{_PAIR}){{2,}}"
_FIELD = rf"[a-z][a-z0-9 _-]*=(?:\{{[^}}]*\}}|{_QUOTED}|[^=;\"'\t\n\f\r ]+)"
SEMICOLON_PATTERN = rf"{_EDGE}{_FIELD}(?:;{_FIELD}){{2,}}"
ASSIGNED_PATTERN = rf"(?:^|[^A-Za-z0-9])({KEY_PATTERN}){_S}*={_S}*({_QUOTED}|{_NOT_S},;&]+)"
PASSWORD_PATTERN = rf"(?:^|[?&;]|{_S})(?:password|pwd)=({_QUOTED}|{_NOT_S}&;\"']+)"
HOST_PATTERN, USER_PATTERN = rf"(?:^|{_S})host=", rf"(?:^|{_S})user="
SERVER_PATTERN = rf"(?:^|;){_S}*(?:server|data source|datasource|addr|address|network address){_S}*="
LOGIN_PATTERN = rf"(?:^|;){_S}*(?:user id|userid|user|uid){_S}*="
#: Formats of keys that their vendors have published, and values that are assigned to names of credentials; a small part of what scanners know.
_NAMES = r"(?i:api[_.-]?key|access[_.-]?key|auth[_.-]?token|client[_.-]?secret|credential|secret|token)"
VENDOR_RULES = (
    Rule("cloud access key", r"(?<![A-Za-z0-9])AKIA[A-Z2-7]{16}(?![A-Za-z0-9])", ("akia",)),
    Rule("code host token", r"gh[oprsu]_[0-9a-zA-Z]{36}", ("gho_", "ghp_", "ghr_", "ghs_", "ghu_")),
    Rule("code host fine-grained token", r"github_pat_[0-9a-zA-Z_]{82}", ("github_pat_",)),
    Rule("code host access token", r"glpat-[0-9a-zA-Z_-]{20}", ("glpat-",)),
    Rule("cloud interface key", r"(?<![A-Za-z0-9])AIza[0-9a-zA-Z_-]{35}", ("aiza",)),
    Rule("payment key", r"(?<![A-Za-z0-9])[rs]k_(?:live|test)_[0-9a-zA-Z]{24,99}", ("k_live_", "k_test_")),
    Rule("chat token", r"(?<![A-Za-z0-9])xox[bp]-[0-9]{10,13}-[0-9]{10,13}-[0-9a-zA-Z-]{20,40}", ("xoxb-", "xoxp-")),
    Rule("package registry token", r"(?<![A-Za-z0-9])npm_[0-9a-zA-Z]{36}", ("npm_",)),
    Rule("model hub token", r"(?<![A-Za-z0-9])hf_[a-zA-Z]{34}", ("hf_",)),
    Rule("private key", r"-----BEGIN[ A-Z0-9_-]{0,100}PRIVATE KEY(?: BLOCK)?-----[\s\S]{16,}?-----END[ A-Z0-9_-]{0,100}PRIVATE KEY(?: BLOCK)?-----", ("private key",)),
    Rule("assigned credential", _NAMES + r"[0-9A-Za-z_.-]{0,20}[\"']?[\t ]{0,3}=[\t ]{0,3}[\"']?([0-9A-Za-z_.=-]{16,150})(?![0-9A-Za-z_.=-])", ("key", "token", "secret", "credential"), 3.0, (r"^[^0-9]+$", r"^[0-9.]+$"), 1),
)
# ---- end of the fixed values

#: What a text needs for any layer to find something: a run that is long enough for its entropy (more than 22 different
#: bytes), an address or assignment, the last digits of a telephone, a vendor's mark, the name of a credential, or an escape.
TRIGGER_PATTERN = r"[A-Za-z0-9+_=-]{23}|[@=\\]|[0-9]{4}|AKIA|PRIVATE KEY|[Pp][Aa][Ss][Ss][Ww]|[Pp][Ww][Dd]"

Span = tuple[int, int, str]
#: A table of rules; None stands for ``VENDOR_RULES``.
Rules = tuple[Rule, ...]
_VENDOR = Engine(VENDOR_RULES)
_any_case = lambda p: re.compile(p, re.I)
#: Runs of any length from 10 on count, but only long ones have the entropy.
_RUN, _PHONE, _URI = re.compile(r"[A-Za-z0-9+_=-]{23,}"), re.compile(PHONE_PATTERN), _any_case(URI_PATTERN)
_PASSWORD = _any_case(PASSWORD_PATTERN)
_JSON_KEY = re.compile(f"^(?:{KEY_PATTERN})$")
_TRIGGER = re.compile(TRIGGER_PATTERN)
_PLAIN = [re.compile(p) for p in PROVIDER_PATTERNS]


def entropy(text: str) -> float:
    """Bits per byte."""
    data = text.encode("utf-8", "surrogatepass")
    return -sum(n / len(data) * math.log2(n / len(data)) for n in Counter(data).values())


def is_placeholder(value: str) -> bool:
    v = value.strip().strip("\"'")
    low = v.lower()
    shapes = (r"<[a-z][a-z_-]{2,}>", r"\*{3,}|\.{3,}|-{3,}")
    return not v or low in PLACEHOLDERS or (low.startswith("${") and low.endswith("}")) or any(re.fullmatch(p, v) for p in shapes) or re.fullmatch("x{3,}", low) is not None


def unquoted(text: str, a: int, b: int) -> tuple[int, int]:
    return (a + 1, b - 1) if b - a >= 2 and text[a] == text[b - 1] and text[a] in "\"'" else (a, b)


def has_password(text: str) -> bool:
    values = (text[slice(*unquoted(text, *m.span(1)))] for m in _PASSWORD.finditer(text))
    return any(v and not is_placeholder(v) for v in values)


def _with(*patterns: str) -> Callable[[str], bool]:
    needed = [_any_case(p) for p in patterns]
    return lambda s: all(p.search(s) for p in needed) and has_password(s)


def _found_by(pattern: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    compiled = _any_case(pattern)
    return lambda text: (m.span() for m in compiled.finditer(text))


#: Connection strings: how they are found, what a text needs for a match, and the test of a match without its trailing marks.
_CONNECTIONS = [
    (_found_by(JDBC_PATTERN), ":", has_password),
    (_found_by(DATABASE_URL_PATTERN), "://", has_password),
    (scan.keyword_pairs, "=", _with(HOST_PATTERN, USER_PATTERN)),
    (scan.semicolon_fields, ";", _with(SERVER_PATTERN, LOGIN_PATTERN)),
]


def _run_spans(text: str) -> Iterator[Span]:
    for m in _RUN.finditer(text):
        a, b = m.span()
        if a and text[a - 1] == "\\" and text[a] in "ntrbfu":
            a += 1
        if entropy(text[a:b]) > ENTROPY_ABOVE:
            yield a, b, ""


def secret_spans(text: str, rules: Rules | None = None) -> Iterator[Span]:
    yield from _run_spans(text)
    yield from ((a, b, "") for a, b in (_VENDOR if rules is None else engine(rules)).spans(text))
    for pattern in _PLAIN:
        yield from ((*m.span(), "") for m in pattern.finditer(text))
    if "://" in text and "@" in text:
        yield from ((*m.span(), "") for m in _URI.finditer(text))
    if "=" not in text:
        return
    for find, needs, test in _CONNECTIONS:
        for a, b in find(text) if needs in text else ():
            found = text[a:b].rstrip(".,;:!?)]")
            if found and test(found):
                yield a, a + len(found), ""
    for a, b in scan.assignments(text, DATABASES):
        a, b = unquoted(text, a, b)
        if a < b and not is_placeholder(text[a:b]):
            yield a, b, ""


def is_allowed_email(email: str) -> bool:
    low = email.lower()
    return low.startswith(tuple(ALLOWED_EMAIL_PREFIXES)) or low.endswith(tuple(ALLOWED_EMAIL_SUFFIXES))


def personal_spans(text: str, categories: tuple[str, ...]) -> Iterator[Span]:
    if EMAIL in categories and "@" in text:
        yield from ((a, b, EMAIL) for a, b in scan.emails(text) if not is_allowed_email(text[a:b]))
    if PHONE in categories:
        yield from ((*m.span(), PHONE) for m in _PHONE.finditer(text))


def merged(spans: list[Span]) -> list[Span]:
    """Spans in order; those that overlap or touch become one, with the label of the first (the longer of two that begin together)."""
    out: list[Span] = []
    for a, b, label in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2])
        else:
            out.append((a, b, label))
    return out


def spans_of(text: str, categories: tuple[str, ...] = (), rules: Rules | None = None) -> list[Span]:
    return merged([*secret_spans(text, rules), *personal_spans(text, categories)])


def mask_text(text: str, categories: tuple[str, ...] = (), rules: Rules | None = None) -> str:
    if rules is None and not _TRIGGER.search(text):
        return text
    out, at = [], 0
    for a, b, label in spans_of(text, categories, rules):
        out += [text[at:a], f"[{SECRET_TOKEN}_{label}]" if label else SECRET_TOKEN]
        at = b
    return "".join([*out, text[at:]]) if out else text


# ---- JSON

@functools.lru_cache(4096)
def is_protected_key(key: str) -> bool:
    low = key.lower()
    return low.endswith(("signature", "id", "ids")) or low in PATH_KEYS


@functools.lru_cache(4096)
def _key_form(key: str) -> str:
    return re.sub(r"[-. ]", "_", key.strip().lower())


@functools.lru_cache(4096)
def is_credential_key(key: str, in_context: bool) -> bool:
    form = _key_form(key)
    return bool(_JSON_KEY.match(form)) or (in_context and form in ("password", "passwd", "pwd"))


def _names_login(obj: dict) -> bool:
    forms = {_key_form(k) for k in obj}
    return bool(forms & HOST_KEYS and forms & USER_KEYS)


def replacements(value, categories: tuple[str, ...], rules: Rules | None = None) -> dict[tuple[str, str], str]:
    """(key, string) → masked string, for the string values that change.  Elements of arrays have the key ''."""
    found: dict[tuple[str, str], str] = {}
    masked = functools.cache(lambda v: mask_text(v, categories, rules))  # a record says the same in several places
    todo = [("", False, value)]
    while todo:
        key, context, v = todo.pop()
        if isinstance(v, dict):
            hidden = ("data", "url") if v.get("type") in PAYLOAD_TYPES and not isinstance(v["type"], json_text.Number) else ()
            inside = context or _names_login(v)
            todo += [(k, inside, x) for k, x in v.items() if k not in hidden]
        elif isinstance(v, list):
            todo += [("", context, x) for x in v]
        elif isinstance(v, str) and not isinstance(v, json_text.Number):
            new = SECRET_TOKEN if is_credential_key(key, context) and v and not is_placeholder(v) else masked(v)
            if new != v:
                found[key, v] = new
    return found


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],]', re.S)


def mask_json(text: str, value, categories: tuple[str, ...], rules: Rules | None = None) -> str:
    """The text of a JSON value with its string values masked, every other byte as it was."""
    changes = replacements(value, categories, rules)
    if not changes:
        return text
    loose = {v: new for (k, v), new in changes.items() if k == ""}
    out, at = [], 0
    # a frame: kind of container, key of the current member, whether a protected key owns it
    frames: list[list] = []
    expect_key = False
    for m in _TOKEN.finditer(text):
        token = m.group()
        if token in "{[":
            key, owned = (frames[-1][1], frames[-1][2]) if frames else ("", False)
            in_list = bool(frames) and frames[-1][0] == "["
            # an array under a protected key is protected with it; an object is looked into again
            owned = token == "[" and ((owned and in_list) or (not in_list and is_protected_key(key)))
            frames.append([token, "", owned])
            expect_key = token == "{"
        elif token in "}]":
            frames.pop()
            expect_key = False
        elif token == ",":
            expect_key = bool(frames) and frames[-1][0] == "{"
        elif expect_key:
            frames[-1][1] = json_text.decode(token)
            expect_key = False
        else:
            kind, key, owned = frames[-1] if frames else ("[", "", False)
            if owned or (kind == "{" and is_protected_key(key)):
                continue
            plain = json_text.decode(token) if "\\" in token else token[1:-1]
            new = changes.get((key if kind == "{" else "", plain), loose.get(plain))
            if new is not None:
                out += [text[at : m.start()], json_text.quote(new, html=False)]
                at = m.end()
    return "".join([*out, text[at:]])


def mask_record(text: str | None, categories: tuple[str, ...] = (EMAIL, PHONE), rules: Rules | None = None) -> str | None:
    """Mask a text that may be one JSON value, or JSON lines, or neither."""
    if not text:
        return text
    try:
        return mask_json(text, json_text.decode(text), categories, rules)
    except ValueError:
        pass
    lines = []
    for line in text.split("\n"):
        try:
            lines.append(mask_json(line, json_text.decode(line), categories, rules) if line.strip() else line)
        except ValueError:
            lines.append(mask_text(line, categories, rules))
    return "\n".join(lines)


# ---- Columns

def mask_records(text: Column | str, categories: tuple[str, ...] = (EMAIL, PHONE), rules: Rules | None = None) -> Column:
    """``mask_record`` of a column, in Arrow batches; under the rules given here only texts in which something may be found go to Python."""
    text = F.col(text) if isinstance(text, str) else text

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: mask_record(t, categories, rules), na_action="ignore")

    return F.coalesce(run(F.when(text.rlike(TRIGGER_PATTERN), text) if rules is None else text), text)


def text_spans(text: Column | str, categories: tuple[str, ...] = (EMAIL, PHONE)) -> Column:
    """The merged spans of a text: an array of (start, end, label), in code points."""
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType())]))

    @F.udf(kind, useArrow=True)
    def run(t):
        return None if t is None else spans_of(t, categories)

    return run(text)


def native_mask_personal(text: Column) -> Column:
    """Emails and telephones masked by JVM expressions alone (no allowed addresses, no other layers)."""
    return F.regexp_replace(F.regexp_replace(text, EMAIL_PATTERN, f"[{SECRET_TOKEN}_{EMAIL}]"), PHONE_PATTERN, f"[{SECRET_TOKEN}_{PHONE}]")


def native_entropy(text: Column) -> Column:
    """Shannon entropy of a text in bits per byte."""
    data = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))
    n = F.size(data).cast("double")
    shares = F.transform(F.array_distinct(data), lambda c: F.size(F.filter(data, lambda x: x == c)) / n)
    return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def native_is_placeholder(value: Column) -> Column:
    v = F.regexp_replace(F.regexp_replace(value, r"^[\s\u0085 ]+|[\s\u0085 ]+$", ""), "^[\"']+|[\"']+$", "")
    low = F.lower(v)
    return (v == "") | low.isin(PLACEHOLDERS) | (low.startswith("${") & low.endswith("}")) | v.rlike(r"^<[a-z][a-z_-]{2,}>$") | low.rlike(r"^(\*{3,}|x{3,}|\.{3,}|-{3,})$")
