"""URL filter whose pattern rules are indexed by their rarest literal token.

A rule names a host (it also fits every subdomain) and the start of a path.
Its literal tokens are the host's labels and the path's complete segments; a
last segment that a longer one could continue is no token.  Of these, the
token that the fewest URLs of the whole table hold indexes the rule.  A URL's
own tokens then fetch its candidate rules, and regular expressions run on
those only.

The rules are a list that the caller states.  ``RULES_AT_ONCE`` of them are
broadcast together and judge every URL; a longer list is judged in several such
steps, each of which keeps the best rule so far, so a task's memory is bounded
whatever the list's length.  There is no shuffle of rows: the one aggregation
counts the rules' own tokens.

Ids of any type pass through as Arrow data.  Null URLs and URLs without ``://``
have an empty host and path and fit no rule.  Repeated rows are judged one by
one, an empty table gives an empty result, and other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, slices

#: Rules that are sent to the tasks together.
RULES_AT_ONCE = 200_000
_LOWER = str.maketrans(UPPER, LOWER)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def tokens(self) -> list[str]:
        """What each URL that the rule fits must hold as a whole token."""
        return [f"h:{x}" for x in self.host.split(".")] + [f"p:{x}" for x in self.path.split("/")[:-1] if x]

    def pattern(self) -> re.Pattern:
        return re.compile(rf"(?:[^/]*\.)?{re.escape(self.name)}")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lowered) and path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(_LOWER), re.match(r"[^?#]*", rest[len(host) :]).group()


def url_tokens(host: str, path: str) -> set[str]:
    return {f"h:{x}" for x in host.split(".")} | {f"p:{x}" for x in path.split("/") if x}


def token_counts(pages: DataFrame, rules: list[Rule], url: str = "url") -> dict[str, int]:
    """How many URLs of the table hold each token of the rules: one row per token reaches the driver."""
    wanted = sorted({t[2:] for r in rules for t in r.tokens()})
    tokens = F.explode(F.array_distinct(F.split(ascii_lower(F.col(url)), r"[./?#]+"))).alias("token")
    held = pages.select(tokens).where(F.col("token").isin([w.translate(_LOWER) for w in wanted]))
    return {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}


def rule_index(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        rarest = min(rule.tokens(), key=lambda t: (counts.get(t[2:].translate(_LOWER), 0), t))
        index.setdefault(rarest, []).append(rule)
    return index


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url: str = "url", otherwise: str = "allow", at_once: int = RULES_AT_ONCE) -> DataFrame:
    """``id_col``, host, path, rule and verdict of every row.

    Of the rules that fit, the one with the longest name wins, then the one
    with the longer host, then the one listed first.  Where none fits, rule is
    null and the verdict is ``otherwise``.
    """
    judged = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(0).alias("host_length"))
    for at in range(0, max(1, len(rules)), at_once):
        some = rules[at : at + at_once]
        judged = best_rules(judged, rule_index(some, token_counts(pages, some, url)))
    host_and_path = judged.select("id", "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))
    return host_and_path.withColumnRenamed("id", id_col)


def best_rules(judged: DataFrame, index: dict[str, list[Rule]]) -> DataFrame:
    """Rows of id, url, host, path and the best of the rule they have and those of ``index``."""
    sent = judged.sparkSession.sparkContext.broadcast(index)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {t: [(r, r.pattern()) for r in rs] for t, rs in sent.value.items()}
        for batch in slices(batches):
            hosts, paths, rules, verdicts, lengths = [], [], [], [], []
            for u, name, verdict, n in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                host, path = split_url(u)
                whole = host + path
                best = (-1, -1) if name is None else (len(name), n)
                for token in sorted(url_tokens(host, path) & compiled.keys()):
                    for rule, pattern in compiled[token]:
                        rank = (len(rule.name), len(rule.host))
                        if rank > best and pattern.match(whole):
                            best, name, verdict = rank, rule.name, rule.verdict
                hosts.append(host)
                paths.append(path)
                rules.append(name)
                verdicts.append(verdict)
                lengths.append(best[1])
            columns = [batch.column(0), batch.column(1), *(pa.array(c, pa.string()) for c in (rules, verdicts)), pa.array(lengths, pa.int32()), *(pa.array(c, pa.string()) for c in (hosts, paths))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "url", "rule", "verdict", "host_length", "host", "path"])

    kind = judged.schema["id"].dataType.simpleString()
    columns = judged.select("id", "url", "rule", "verdict", "host_length")
    return columns.mapInArrow(judge, f"id {kind}, url string, rule string, verdict string, host_length int, host string, path string")
