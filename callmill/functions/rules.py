"""Rules for secrets, from a table that the caller brings.

One pass of an automaton over all keywords tells which rules a text can hold,
so time does not grow with the number of rules.  Only those run their pattern;
a match counts if its secret is as random as the rule asks and no allowed
pattern fits it.  A second automaton over the secrets that were found gives
every place where one of them stands, also where no rule's context is around.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick


@dataclass(frozen=True)
class Rule:
    """A pattern and the words of which a text has to have one (in small letters; none means every text is tried)."""

    name: str
    pattern: str
    keywords: tuple[str, ...] = ()
    entropy: float = 0.0  # bits per character that the secret has to exceed
    allow: tuple[str, ...] = ()  # patterns of secrets that are none
    group: int = 0  # of the pattern: the secret


def bits(text: str) -> float:
    """Shannon entropy in bits per character."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def automaton(words: dict[str, object]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for word, value in words.items():
        made.add_word(word, value)
    made.make_automaton()
    return made


class Engine:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern), [re.compile(a) for a in r.allow]) for r in rules]
        self.always = {i for i, r in enumerate(rules) if not r.keywords}
        by_word: dict[str, set[int]] = {}
        for i, r in enumerate(rules):
            for word in r.keywords:
                by_word.setdefault(word.lower(), set()).add(i)
        self.words = automaton(by_word) if by_word else None

    def candidates(self, text: str) -> set[int]:
        """The rules of which the text has a keyword."""
        out = set(self.always)
        if self.words:
            for _, found in self.words.iter(text.lower()):
                out |= found
        return out

    def secrets(self, text: str) -> set[str]:
        out = set()
        for i in self.candidates(text):
            rule, pattern, allow = self.rules[i]
            for m in pattern.finditer(text):
                secret = m.group(rule.group)
                if secret and (not rule.entropy or bits(secret) > rule.entropy) and not any(a.search(secret) for a in allow):
                    out.add(secret)
        return out

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Every place of every secret."""
        found = self.secrets(text)
        if found:
            for last, length in automaton({s: len(s) for s in found}).iter(text):
                yield last + 1 - length, last + 1


@functools.lru_cache(16)
def engine(rules: tuple[Rule, ...]) -> Engine:
    return Engine(rules)
