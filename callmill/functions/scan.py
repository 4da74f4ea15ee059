"""Matches of the masker's longer patterns, found in time that grows with the text.

A regular expression tries every place where a match may begin, and reads on
from each; what it reads is mostly the same.  These scanners start from the
delimiters that a match must have, read what follows once, and then take the
first beginning that fits.  The spans are those of the patterns in
``redaction``, against which they are tested.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

Range = tuple[int, int]

_SPACE = frozenset("\t\n\f\r ")
_WORD = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")


def _any_case(letters: str) -> frozenset[str]:
    """The characters that a class of these matches when case doesn't matter, in the expressions' sense."""
    return frozenset(c for c in [*map(chr, range(128)), "ſ", "K", "ı", "İ"] if re.fullmatch(f"[{letters}]", c, re.I))


def is_edge(text: str, at: int) -> bool:
    return (at > 0 and text[at - 1] in _WORD) != (at < len(text) and text[at] in _WORD)


class Places:
    """The next place of a character, asked for from left to right."""

    def __init__(self, text: str):
        self.text, self.known = text, {}

    def next(self, char: str, at: int) -> int:
        """Its first place from ``at`` on, or -1."""
        asked, found = self.known.get(char, (0, -2))
        if found == -2 or at < asked or 0 <= found < at:
            found = self.text.find(char, at)
            self.known[char] = (at, found)
        return found


# ---- addresses

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[a-zA-Z0-9.\-]+")
_TOP = re.compile(r"[a-zA-Z]{2,}")


def emails(text: str) -> Iterator[Range]:
    at, mark = 0, text.find("@")
    while mark >= 0:
        end = _domain_end(text, mark + 1)
        if end:
            start = mark
            while start > at and text[start - 1] in _LOCAL:
                start -= 1
            while start < mark and not is_edge(text, start):
                start += 1
            if start < mark:
                yield start, end
                at = end
        mark = text.find("@", max(mark + 1, at))


def _domain_end(text: str, at: int) -> int:
    """Where the domain that begins here ends: behind its last dot that a name of letters follows; 0 if it has none."""
    run = _DOMAIN.match(text, at)
    dot = text.rfind(".", at + 1, run.end()) if run else -1
    while dot >= 0:
        top = _TOP.match(text, dot + 1)
        if top and (top.end() == len(text) or text[top.end()] not in _WORD):
            return top.end()
        dot = text.rfind(".", at + 1, dot)
    return 0


# ---- keyword pairs between white space

_NAME = re.compile(r"[a-z_][a-z0-9_]*=", re.I)
_NAMED = re.compile(r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))[a-z_][a-z0-9_]*=", re.I)
_GAP = re.compile(r"[\t\n\f\r ]+")
_BARE = re.compile(r"[^\t\n\f\r \"']+")


def keyword_pairs(text: str) -> Iterator[Range]:
    """Three pairs of name and value at least, with white space between."""
    places, ends = Places(text), {}

    def value_end(at: int) -> int:
        if at < len(text) and text[at] in "\"'":
            return places.next(text[at], at + 1) + 1
        # what lies in one run ends where the run does
        if ends.get("run", (0, 0))[0] <= at < ends.get("run", (0, 0))[1]:
            return ends["run"][1]
        run = _BARE.match(text, at)
        ends["run"] = run.span() if run else (0, 0)
        return run.end() if run else 0

    def more(end: int) -> int:
        """The end of the pair behind the white space here, or 0."""
        gap = _GAP.match(text, end)
        name = gap and _NAME.match(text, gap.end())
        return value_end(name.end()) if name else 0

    at, refused = 0, -1
    while name := _NAMED.search(text, at):
        at, end, n = name.end(), value_end(name.end()), 1
        if not end or end == refused:
            continue
        first = end
        while following := more(end):
            end, n = following, n + 1
        if n >= 3:
            yield name.start(), end
            at = end
        else:
            refused = first


# ---- fields between semicolons

_FIELD_NAME = re.compile(r"[a-z][a-z0-9 _-]*=", re.I)
_FIELD_KEY = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 _-")
_PLAIN = re.compile(r"[^=;\"'\t\n\f\r ]+")
_LETTER = _any_case("a-z")


def semicolon_fields(text: str) -> Iterator[Range]:
    """Three fields at least, each a name and a value, the first name where a word begins or ends."""
    places = Places(text)

    def value_ends(at: int) -> Iterator[int]:
        c = text[at] if at < len(text) else ""
        if c and c in "\"'{":
            end = places.next("}" if c == "{" else c, at + 1)
            if end >= 0:
                yield end + 1
        plain = _PLAIN.match(text, at) if c != "" else None
        if plain:
            yield plain.end()

    def chain(at: int, need: int) -> int:
        """The end of a value here and of the fields behind it, of which there have to be ``need``; 0 if there are fewer."""
        while True:
            last, ahead = 0, -1
            for end in value_ends(at):
                name = _FIELD_NAME.match(text, end + 1) if end < len(text) and text[end] == ";" else None
                if name and need > 0:
                    found = chain(name.end(), need - 1)
                    if found:
                        return found
                    continue
                if name and next(value_ends(name.end()), 0):
                    ahead = name.end()
                elif need > 0:
                    continue
                last = end
                break
            if not last or ahead < 0:
                return last
            at = ahead

    at = 0
    while (mark := text.find("=", at)) >= 0:
        end = chain(mark + 1, 2)
        start = mark
        if end:
            while start > at and text[start - 1] in _FIELD_KEY:
                start -= 1
            while start < mark and not (text[start] in _LETTER and is_edge(text, start)):
                start += 1
        if end and start < mark:
            yield start, end
            at = end
        else:
            at = mark + 1


# ---- assigned passwords

_KEY_CHAR = _any_case("a-z0-9_-")
_ALNUM = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_CREDENTIAL = re.compile(r"(?:password|passwd|pwd)\Z", re.I)
_ASSIGNED_BARE = re.compile(r"[^\t\n\f\r ,;&]+")


def assignments(text: str, databases: str) -> Iterator[Range]:
    """The values, with their quotes, that are assigned to names of a database's password."""
    database, places = re.compile(databases, re.I), Places(text)
    at, mark = 0, text.find("=")
    while mark >= 0:
        end = mark
        while end > at and text[end - 1] in _SPACE:
            end -= 1
        word = _CREDENTIAL.search(text, max(at, end - 8), end)
        value = _assigned_value(text, mark + 1, places) if word and _named_at(text, word.start(), at, database) else None
        if value:
            yield value
            at = value[1]
        mark = text.find("=", max(mark + 1, at))


def _named_at(text: str, credential: int, at: int, database: re.Pattern) -> bool:
    """Whether a name of a database, that begins behind a character that is neither letter nor digit, leads to the credential's word here."""
    start = credential
    while start > at and text[start - 1] in _KEY_CHAR:
        start -= 1
    for q in range(start, credential):
        if (q == 0 or (q > at and text[q - 1] not in _ALNUM)) and any(text[e] in "_-" or e == credential for e in _name_ends(text, q, credential, database)):
            return True
    return False


def _name_ends(text: str, at: int, most: int, database: re.Pattern) -> Iterator[int]:
    for e in range(at + 2, min(most, at + 10) + 1):
        if database.fullmatch(text, at, e):
            yield e


def _assigned_value(text: str, at: int, places: Places) -> Range | None:
    gap = _GAP.match(text, at)
    starts = range(gap.end(), at - 1, -1) if gap else (at,)
    for start in starts:
        if start < len(text) and text[start] in "\"'":
            end = places.next(text[start], start + 1)
            if end >= 0:
                return start, end + 1
        bare = _ASSIGNED_BARE.match(text, start)
        if bare:
            return bare.span()
        if text[start : start + 1] in _SPACE:
            break
    return None
