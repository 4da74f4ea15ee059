"""Scalar rules of the record pipeline as Column expressions."""

from __future__ import annotations

import hmac
import re
from urllib.parse import unquote_plus, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values
MAX_RECORD_BYTES = 32 << 20
QUOTA_BYTES = 2 << 30
FLUSH_BYTES, FLUSH_AGE_SECONDS = 10 << 20, 24 * 3600
RATE_LIMIT_PAUSE, MAX_RETRY_AFTER = 300, 3600
BUDGET_BASE, BUDGET_BYTES, MAX_BUDGET = 60, 64 << 10, 1800
MAX_BACKOFF = 900
EXIT_BUDGET_SECONDS = 15
TEXT_RUNES, TEXT_BYTES = 400, 4096
RECORD_METHOD, RECORD_PATH = "POST", "/v1/messages"
ID_PATTERN = r"\A[A-Za-z0-9][A-Za-z0-9._-]*\z"
MASKED = "redacted"
TOKEN_START, TOKEN_HIDDEN, TOKEN_REST = 8, "masked", "…(masked)"
FAILURES = {426: "upgrade", 429: "limited", 408: "timeout", 401: "transient"}
ABANDONED = ["capture queue full", "recording panicked", "capture limit exceeded", "capture deadline passed", "envelope assembly failed", "spool write failed"]
# ---- end of the fixed values


# eligibility and routing facts

def is_eligible(method: Column, path: Column) -> Column:
    return (method == RECORD_METHOD) & (path == RECORD_PATH)


def is_success(status: Column) -> Column:
    return status.between(200, 299)


def fits_record(request: Column, response: Column, limit: int = MAX_RECORD_BYTES) -> Column:
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    return size(request) + size(response) <= limit


def split_token(path: Column) -> Column:
    """A struct of token and rest, null where the path has none."""
    pattern = r"(?s)\A/t/([^/]+)(?:/(.*))?\z"
    return F.when(path.rlike(pattern), F.struct(F.regexp_extract(path, pattern, 1).alias("token"), F.concat(F.lit("/"), F.regexp_extract(path, pattern, 2)).alias("rest")))


def split_beta(values: Column) -> Column:
    """Header values, split at commas, trimmed, without empty ones."""
    parts = F.flatten(F.transform(values, lambda v: F.split(v, ",")))
    return F.filter(F.transform(parts, lambda v: F.regexp_replace(v, r"^\s+|\s+$", "")), lambda v: v != "")


def upstream_origin(upstream: Column, official: Column) -> Column:
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "/+$", "")
    same = (bare(upstream) == bare(official)) & (F.coalesce(upstream, F.lit("")) != "")
    return F.when(same, "official").otherwise("third_party")


def verdict(known: Column, revoked: Column, paused_reason: Column) -> Column:
    paused = F.coalesce(paused_reason, F.lit("")) != ""
    return F.when(~known, "unknown").when(revoked, "revoked").when(paused, "paused").otherwise("record")


def explain_pause(reason: Column) -> Column:
    return (
        F.when(reason == "signed_out", "recording stays off until this device has signed in again")
        .when(reason == "consent_reconfirm", "recording stays off until the new data agreement has been accepted")
        .otherwise(reason)
    )


def project_hash(root: Column) -> Column:
    return F.sha2(root, 256)


def request_id(structured: Column, response: Column, upstream_id: Column, local_key: Column) -> Column:
    """Of a structured response's id, the upstream's and a local one, the first that is there; unsafe ids become local."""
    local = F.concat(F.lit("local-"), F.md5(local_key))
    own = F.when(structured, F.nullif(F.get_json_object(response, "$.id"), F.lit("")))
    found = F.coalesce(own, F.nullif(upstream_id, F.lit("")), local)
    return F.when(found.rlike(ID_PATTERN), found).otherwise(local)


def is_safe_batch_id(batch_id: Column) -> Column:
    return ~batch_id.isin("", ".", "..") & ~batch_id.rlike(r"[/\\]")


def day_key(at: Column) -> Column:
    """yyyyMMdd; the session's time zone has to be UTC."""
    return F.date_format(at, "yyyyMMdd")


def nanos_fraction(at: Column) -> Column:
    """Nanoseconds below a microsecond of an RFC 3339 text, which timestamps cut off."""
    return F.coalesce(F.try_to_number(F.rpad(F.nullif(F.regexp_extract(at, r"\.\d{6}(\d{1,3})", 1), F.lit("")), 3, "0"), F.lit("999")).cast("int"), F.lit(0))


def parse_instant(at: Column) -> Column:
    """A timestamp, null where the text is no RFC 3339 instant."""
    return F.when(at.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(at))


# versions

def version_key(version: Column) -> Column:
    """A key that sorts as versions do; null where the text is none.

    Releases come after their pre-releases, numeric identifiers before others.
    """
    v = F.regexp_replace(F.regexp_replace(version, "^v", ""), r"(?s)\+.*$", "")
    shape = r"^([0-9]+)\.([0-9]+)\.([0-9]+)(?:-([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?$"
    core = [F.regexp_extract(v, shape, i).try_cast("decimal(20,0)") for i in (1, 2, 3)]
    pre = F.regexp_extract(v, shape, 4)
    parts = F.when(pre == "", F.array().cast("array<struct<alpha:boolean,num:decimal(20,0),text:string>>")).otherwise(
        F.transform(F.split(pre, r"\."), lambda p: F.struct((~p.rlike("^[0-9]+$")).alias("alpha"), F.when(p.rlike("^[0-9]+$"), p.try_cast("decimal(20,0)")).alias("num"), F.when(~p.rlike("^[0-9]+$"), p).otherwise("").alias("text")))
    )
    valid = v.rlike(shape) & core[0].isNotNull() & core[1].isNotNull() & core[2].isNotNull()
    return F.when(valid, F.struct(*(c.alias(n) for c, n in zip(core, ("major", "minor", "patch"), strict=True)), (pre == "").alias("release"), parts.alias("pre")))


def version_standing(minimum: Column, version: Column) -> Column:
    a, b = version_key(version), version_key(minimum)
    return F.when(F.coalesce(minimum, F.lit("")) == "", "satisfied").when(a.isNull() | b.isNull(), "unknown").when(a < b, "behind").otherwise("satisfied")


# texts

def human_bytes(n: Column) -> Column:
    """A byte count in binary units with one decimal, by integers: a tie goes to the even digit, as C and Go print it."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate("KMGTPE", start=1):
        half = 1 << 10 * i - 1
        fives = n.bitwiseAND(F.lit(2 * half - 1)) * 5  # of a half unit each, which a long holds up to the last unit
        tenths, rest = F.shiftright(fives, 10 * i - 1), fives.bitwiseAND(F.lit(half - 1)) * 2
        up = (rest > half) | ((rest == half) & (tenths % 2 == 1))
        tenths = F.shiftright(n, 10 * i) * 10 + tenths + F.when(up, 1).otherwise(0)
        out = F.when(n >= 1024**i, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}iB"))).otherwise(out)
    return out


def truncated(text: Column, runes: int = TEXT_RUNES) -> Column:
    return F.when(F.char_length(text) > runes, F.concat(F.substring(text, 1, runes), F.lit("…"))).otherwise(text)


def safe_text(text: Column) -> Column:
    """Runs of white space and of what shows nothing are one space; replacement characters are left out."""
    return truncated(F.trim(F.regexp_replace(F.replace(text, F.lit("�"), F.lit("")), r"[\x00-\x20\p{Z}\p{C}]+", " ")))


def service_details(text: Column) -> Column:
    """A service's own words: at most ``TEXT_BYTES`` bytes are looked at; a character that the cut splits is dropped."""
    return safe_text(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, TEXT_BYTES).cast("string")))


def mask_token(token: Column) -> Column:
    return F.when(token == "", "").when(F.octet_length(token) <= TOKEN_START, TOKEN_HIDDEN).otherwise(F.concat(F.substring(token, 1, TOKEN_START), F.lit(TOKEN_REST)))


def _mask_query(query: str) -> str:
    """Every value masked; a query that can't be taken apart is masked whole."""
    keys = set()
    for pair in filter(None, query.split("&")):
        if ";" in pair or re.search("%(?![0-9a-fA-F]{2})", pair):
            return MASKED
        keys.add(unquote_plus(pair.partition("=")[0]))
    return urlencode([(k, MASKED) for k in sorted(keys)]) or MASKED


def _mask_url(url: str | None) -> str | None:
    if url is None:
        return None
    try:
        u = urlsplit(url)
    except ValueError:
        return url
    host = u.netloc.rpartition("@")[2]
    netloc = f"{MASKED}@{host}" if "@" in u.netloc else u.netloc
    return urlunsplit((u.scheme, netloc, u.path, _mask_query(u.query) if u.query else "", u.fragment))


def mask_url_credentials(url: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(_mask_url, na_action="ignore")

    return run(url)


def is_truthy(value: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s+|\s+$", "")).isin("1", "true", "yes", "on")


def is_credential_safe(url: Column) -> Column:
    """https, or http on a loopback host."""
    scheme, host = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lower(F.try_parse_url(url, F.lit("HOST")))
    loopback = host.isin("localhost", "[::1]", "::1") | host.rlike(r"^127\.\d{1,3}\.\d{1,3}\.\d{1,3}$")
    return F.coalesce((F.coalesce(host, F.lit("")) != "") & ((scheme == "https") | ((scheme == "http") & loopback)), F.lit(False))


def upstream_move(unsupported: Column, masked: Column, kept: Column, wanted: Column, current: Column) -> Column:
    stays = unsupported | masked | kept | (wanted == current)
    return F.when(stays, "none").when(~is_credential_safe(wanted), "refused").otherwise("moved")


# delivery

def failure_class(status: Column) -> Column:
    known = F.when(F.lit(False), "")
    for code, kind in FAILURES.items():
        known = known.when(status == code, kind)
    return known.when(status.between(400, 499), "rejected").otherwise("transient")


def is_temporary(status: Column) -> Column:
    return (status >= 500) | status.isin(408, 429)


def failure_outcome(kind: Column) -> Column:
    return F.when(kind == "upgrade", "upgrade_required").when(kind.isin("limited", "timeout"), "deferred").when(kind == "rejected", "rejected").otherwise("paused")


def retry_after(value: Column, now: Column) -> Column:
    """Seconds to wait: a number, or an HTTP date; nothing readable is 0."""
    seconds = F.when(value.rlike(r"^[+-]?\d+$"), value.try_cast("long"))
    at = F.try_to_timestamp(F.regexp_extract(value, r"^[A-Z][a-z]{2}, (\d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    until = F.unix_timestamp(at) - F.unix_timestamp(now)
    return F.least(F.greatest(F.coalesce(seconds, until, F.lit(0)), F.lit(0)), F.lit(MAX_RETRY_AFTER)).cast("long")


def upload_budget(n_bytes: Column, timeouts: Column) -> Column:
    base = F.lit(BUDGET_BASE) + F.floor(n_bytes / BUDGET_BYTES)
    return F.least(base * F.pow(F.lit(2), F.least(timeouts, F.lit(20))), F.lit(MAX_BUDGET)).cast("long")


def timeout_backoff(timeouts: Column) -> Column:
    return F.least(F.lit(60) * F.pow(F.lit(2), F.least(F.greatest(timeouts - 1, F.lit(0)), F.lit(20))), F.lit(MAX_BACKOFF)).cast("long")


def flush_due(usage: Column, age_seconds: Column, flush_bytes: Column | None = None, flush_age: Column | None = None) -> Column:
    """'empty', 'below_threshold' or 'due'."""
    limit = F.lit(FLUSH_BYTES) if flush_bytes is None else F.when(flush_bytes > 0, flush_bytes).otherwise(FLUSH_BYTES)
    oldest = F.lit(FLUSH_AGE_SECONDS) if flush_age is None else F.when(flush_age > 0, flush_age).otherwise(FLUSH_AGE_SECONDS)
    return F.when(usage == 0, "empty").when((usage < limit) & (F.coalesce(age_seconds, F.lit(0)) < oldest), "below_threshold").otherwise("due")


def merge_setting(old: Column, new: Column) -> Column:
    """The new value where it is set (not null, 0 or '')."""
    return F.when(F.coalesce(new.cast("string"), F.lit("")).isin("", "0"), old).otherwise(new)


def new_quota(old: Column, wanted: Column) -> Column:
    return F.when(wanted > 0, wanted).otherwise(old)


def is_writable(usage: Column, quota: Column, directory_ok: Column) -> Column:
    return directory_ok & (usage < quota)


def first_accepted(*values: tuple[Column, Column]) -> Column:
    """The first value whose condition holds, of (value, condition) in order."""
    return F.coalesce(*(F.when(ok, v) for v, ok in values))


def severity(problem: Column, note: Column, fixed: Column) -> Column:
    """Of a finding, the gravest that holds."""
    return F.when(problem, "problem").when(note, "note").when(fixed, "fixed").otherwise("ok")


def keyed_proof(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a text, as lowercase hex."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda m: hmac.new(key, m.encode(), "sha256").hexdigest(), na_action="ignore")

    return run(message)


def new_batch_id(seed: Column) -> Column:
    """An id for a batch, derived from what identifies it, so that a rerun agrees."""
    return F.concat(F.lit("b-"), F.md5(seed))
