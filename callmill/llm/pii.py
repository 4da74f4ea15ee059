"""Format-preserving pseudonyms for personal data.

Candidates are found by pattern and validated: check digits of cards and
account numbers, areas of social security numbers, calendars, octets; after a
refused candidate the search goes on one character later.  A valid value is mapped to its index in the set of valid
values of its format, the index is permuted by a keyed Feistel network, and
the result is written in the same format, with the same separators and the
same length.  The permutation depends on key and kind alone, so equal values
get equal pseudonyms in every document, and different values of one format
different ones.  Whoever has the key can invert it (``inverse=True``).  The
domain of an address of electronic mail stays as it is.

Dates are permuted among the written forms of the years 1900 to 2099: those
with the year first, and those with the year last, whose first two numbers are
day and month in either order.

There is no shuffle and no state: each text is rewritten where it is read.

Null texts stay null.  Empty texts stay empty.  Repeated rows get equal
results, tables may be empty, other columns pass through, and a column named
like an output is replaced.  Where candidates overlap, the kind listed first
in ``KINDS`` wins, then the one that begins first.
"""

from __future__ import annotations

import bisect
import calendar
import hashlib
import itertools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import with_python_columns

ROUNDS = 8
#: Characters that are one index; a round's digest is long enough for these.
BLOCK = 128


class Cipher:
    """Keyed permutations of ranges of integers, or their inverses."""

    def __init__(self, key: bytes, inverse: bool = False):
        self.key, self.inverse = key, inverse

    def __call__(self, index: int, size: int, tweak: str) -> int:
        """A Feistel network on bits, walked until it is back in range(size)."""
        half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
        mask, width = (1 << half) - 1, (half + 7) // 8

        def round_(i: int, x: int) -> int:
            data = bytes([i]) + x.to_bytes(width, "big")
            mixed = hashlib.blake2b(data, key=self.key, person=tweak.encode()[:16], digest_size=max(8, width + 1)).digest()
            return int.from_bytes(mixed, "big") & mask

        while True:
            left, right = index >> half, index & mask
            if self.inverse:
                for i in reversed(range(ROUNDS)):
                    left, right = right ^ round_(i, left), left
            else:
                for i in range(ROUNDS):
                    left, right = right, left ^ round_(i, right)
            index = left << half | right
            if index < size:
                return index


_CLASSES = [("0123456789", re.compile("[0-9]")), ("abcdefghijklmnopqrstuvwxyz", re.compile("[a-z]")), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", re.compile("[A-Z]"))]
_CLASS_OF = {c: chars for chars, _ in _CLASSES for c in chars}


def permute_characters(value: str, cipher: Cipher, tweak: str, alphabets: dict[str, str] | None = None) -> str:
    """Digits stay digits, small letters small and capitals capital; all else stays.  Each ``BLOCK`` characters are permuted by themselves."""
    if len(value) > BLOCK:
        return "".join(permute_characters(value[i : i + BLOCK], cipher, f"{i // BLOCK or ''}{tweak}", alphabets) for i in range(0, len(value), BLOCK))
    kinds = alphabets or _CLASS_OF
    index, size = 0, 1
    for c in value:
        if c in kinds:
            index, size = index * len(kinds[c]) + kinds[c].index(c), size * len(kinds[c])
    if size == 1:
        return value
    index, out = cipher(index, size, f"{tweak}{size.bit_length()}"), []
    for c in reversed(value):
        if c in kinds:
            index, at = divmod(index, len(kinds[c]))
            c = kinds[c][at]
        out.append(c)
    return "".join(reversed(out))


def refill(template: str, digits: str) -> str:
    """The template's digits replaced, in turn."""
    each = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(each), template)


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(body)))
    return str(-total % 10)


def card(value: str, cipher: Cipher) -> str | None:
    digits = re.sub(r"\D", "", value)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = digits[0] + permute_characters(digits[1:-1], cipher, "card")
    return refill(value, body + luhn_digit(body))


def phone(value: str, cipher: Cipher) -> str | None:
    digits = re.sub(r"\D", "", value)
    country, local = digits[:-10], digits[-10:]
    if country not in ("", "1"):
        return None
    if local[0] in "01" or local[3] in "01":  # outside the numbering plan: permuted among themselves
        return refill(value, country + unplanned(local, cipher))
    index = ((int(local[:3]) - 200) * 800 + int(local[3:6]) - 200) * 10_000 + int(local[6:])
    rest, last = divmod(cipher(index, 800 * 800 * 10_000, "phone"), 10_000)
    area, exchange = divmod(rest, 800)
    return refill(value, f"{country}{area + 200}{exchange + 200}{last:04d}")


def unplanned(local: str, cipher: Cipher) -> str:
    """A permutation of the ten digits that the numbering plan does not hold, by walking until one is met."""
    index = int(local)
    while True:
        index = cipher(index, 10**10, "phone10")
        found = f"{index:010d}"
        if found[0] in "01" or found[3] in "01":
            return found


def social_security(value: str, cipher: Cipher) -> str | None:
    area, group, serial = map(int, value.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    index = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rest, serial = divmod(cipher(index, 898 * 99 * 9999, "ssn"), 9999)
    area, group = divmod(rest, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def address(value: str, cipher: Cipher) -> str | None:
    octets = [int(x) for x in value.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
        return None
    index = octets[0] << 24 | octets[1] << 16 | octets[2] << 8 | octets[3]
    found = cipher(index, 1 << 32, "ip")
    return ".".join(map(str, (found >> 24, found >> 16 & 255, found >> 8 & 255, found & 255)))


_YEARS = range(1900, 2100)


def _written(year_first: bool, leap: bool) -> list[tuple[int, int]]:
    """The pairs of numbers, in order, that stand beside a year in a date."""
    days = [31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    month_day = [(m, d) for m, n in enumerate(days, 1) for d in range(1, n + 1)]
    return month_day if year_first else sorted({*month_day, *((d, m) for m, d in month_day)})


#: By whether the year is first: the pairs of ordinary and of leap years, the place of each pair, and where a year's dates begin.
_DATES = {}
for _first in (True, False):
    _pairs = [_written(_first, leap) for leap in (False, True)]
    _starts = [0, *itertools.accumulate(len(_pairs[calendar.isleap(y)]) for y in _YEARS)]
    _DATES[_first] = (_pairs, [{p: i for i, p in enumerate(x)} for x in _pairs], _starts)


def date(value: str, cipher: Cipher) -> str | None:
    """Year first, or year last after day and month in either order."""
    a, sep, b, _, c = re.fullmatch(r"([0-9]+)([-/.])([0-9]+)([-/.])([0-9]+)", value).groups()
    first = len(a) == 4
    year, pair = (int(a), (int(b), int(c))) if first else (int(c), (int(a), int(b)))
    pairs, place, starts = _DATES[first]
    if year not in _YEARS or pair not in place[calendar.isleap(year)]:
        return None
    index = cipher(starts[year - _YEARS[0]] + place[calendar.isleap(year)][pair], starts[-1], "date" if first else "date, year last")
    at = bisect.bisect_right(starts, index) - 1
    year = _YEARS[at]
    x, y = pairs[calendar.isleap(year)][index - starts[at]]
    return f"{year}{sep}{x:02d}{sep}{y:02d}" if first else f"{x:02d}{sep}{y:02d}{sep}{year}"


def _mod97(country: str, check: str, account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account + country + check)) % 97


def account(value: str, cipher: Cipher) -> str | None:
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain[:2], plain[2:4], plain[4:]) != 1:
        return None
    body = permute_characters(plain[4:], cipher, "iban" + plain[:2])
    each = iter(f"{plain[:2]}{98 - _mod97(plain[:2], '00', body):02d}{body}")
    return "".join(c if c == " " else next(each) for c in value)


def email(value: str, cipher: Cipher) -> str | None:
    local, _, domain = value.rpartition("@")
    return f"{permute_characters(local, cipher, 'email')}@{domain}"


_HEXADECIMAL = dict.fromkeys("0123456789abcdef", "0123456789abcdef")
_ALL_HEXADECIMAL, _DIGIT = re.compile("[0-9a-f]+"), re.compile("[0-9]")


def secret(value: str, cipher: Cipher) -> str | None:
    """Keys and tokens, found by what stands before them; words without digits are none.

    Hexadecimal ones that have a digit are permuted among themselves, and so
    are the others of one pattern of characters: each permutation is walked
    until it is back among its own, so no two values get one pseudonym.
    """
    mark = re.match(r"AKIA|[A-Za-z_]+\s*[=:]\s*[\"']?", value).group()
    tail = value[len(mark) :]
    if mark != "AKIA" and not _DIGIT.search(tail):
        return None
    hexadecimal = _ALL_HEXADECIMAL.fullmatch(tail) is not None
    while True:
        tail = permute_characters(tail, cipher, "secret", _HEXADECIMAL if hexadecimal else None)
        if (_ALL_HEXADECIMAL.fullmatch(tail) is not None) == hexadecimal and (mark == "AKIA" or _DIGIT.search(tail)):
            return mark + tail


#: Kinds in order of preference: pattern, what must be in a text at all, and the pseudonym of a value (None if it isn't valid).
KINDS: dict[str, tuple[re.Pattern, str, Callable[[str, Cipher], str | None]]] = {
    "email": (re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9])"), "@", email),
    "secret": (re.compile(r"(?-i:(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9]))|(?<![A-Za-z0-9])(?:password|passwd|pwd|token|secret|api_?key)\s{0,3}[=:]\s{0,3}(?:\"[^\"\s]{8,}|'[^'\s]{8,}|[^\s\"']{8,})", re.I), "=:A", secret),
    "account": (re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"), "0123456789", account),
    "card": (re.compile(r"(?<![A-Za-z0-9.+-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![A-Za-z0-9-])"), "0123456789", card),
    "phone": (re.compile(r"(?<![A-Za-z0-9.+-])(?:\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![A-Za-z0-9-])"), "0123456789", phone),
    "ssn": (re.compile(r"(?<![A-Za-z0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"), "0123456789", social_security),
    "ip": (re.compile(r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])"), "0123456789", address),
    "date": (re.compile(r"(?<![A-Za-z0-9./-])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![A-Za-z0-9/-]|\.[0-9])"), "0123456789", date),
}
_ANY = re.compile(r"[0-9@=:]")
#: Of the names before secrets, with the mark behind it.
LONGEST_NAME = len("password=")


def pseudonymized(text: str | None, key: bytes, inverse: bool = False) -> tuple[str | None, dict[str, int]]:
    """The text with pseudonyms, and how many of each kind it has; ``inverse`` puts the values back."""
    cipher = Cipher(key, inverse)
    if not text or not _ANY.search(text):
        return text, {}
    spans: list[tuple[int, int, str, str]] = []
    for kind, (pattern, needs, make) in KINDS.items():
        if not any(c in text for c in needs):
            continue
        at, taken = 0, sorted(spans)
        while m := pattern.search(text, at):
            a, end, value = m.start(), m.end(), m.group()
            at = a + 1  # after a candidate that is none, a later group may begin a value
            i = bisect.bisect_right(taken, (a, len(text)))
            held = taken[i - 1][1] if i and taken[i - 1][1] > a else taken[i][1] if i < len(taken) and taken[i][0] < end else 0
            if held:
                # all secrets that begin before the span's end reach into it: they end where this one ends
                at = held if kind == "secret" else at
                continue
            new = make(value, cipher)
            while new is None and " " in value and kind != "secret":  # a group that follows may not belong to the value
                value = value.rpartition(" ")[0]
                new = make(value, cipher) if pattern.fullmatch(value) else None
            if new is not None:
                at = a + len(value)
                spans.append((a, at, new, kind))
            elif kind == "secret":
                # what begins inside has no digits either, but for a name at the end that a quoted value follows
                at = max(at, end - LONGEST_NAME)
    spans.sort()
    out, at, counts = [], 0, dict.fromkeys((k for *_, k in spans), 0)
    for a, b, new, kind in spans:
        out += [text[at:a], new]
        at = b
        counts[kind] += 1
    return "".join([*out, text[at:]]), counts


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text", out: str | None = None, inverse: bool = False) -> DataFrame:
    """``docs`` with the rewritten text in ``out`` (``text`` itself, by default), n_private and kinds (sorted, comma-joined)."""
    if not key:
        raise ValueError("a key is needed")

    def make(texts: list) -> list:
        found = [pseudonymized(t, key, inverse) for t in texts]
        return [[t for t, _ in found], [sum(c.values()) for _, c in found], [",".join(sorted(c)) for _, c in found]]

    return with_python_columns(docs, [text], make, [(out or text, T.StringType()), ("n_private", T.LongType()), ("kinds", T.StringType())])
