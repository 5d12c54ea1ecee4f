r"""Operator 9: URL filtering by pattern rules that are indexed by their rarest literal token.

A URL's subject is its host (after the first ``://``, A-Z lower-cased) followed by
its path (up to ``?`` or ``#``).  A rule is a regular expression on the subject with
literal tokens, maximal runs of letters and digits that every subject it fits
holds whole.  The index files a rule under its token with the fewest rules (the
longest of several); rules without one are always candidates.  The tokens of a
URL fetch candidates, and only those run their regular expressions.

Site rules (host and path prefix, longest wins) come before pattern rules (the
first listed wins); a URL that no rule fits gets the default verdict.
Null URLs and URLs without ``://`` have an empty host and path and fit no rule.  Very long
URLs are read whole.  Rows that repeat are judged alike, each for itself; an empty table gives none.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from verdex.llm.common import append_columns

PARTS = re.compile(r"([^/?#]*)([^?#]*)")
TOKEN = re.compile(r"[A-Za-z0-9]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    #: Of several rules that fit, the highest rank wins.
    rank: int


def site_rule(verdict: str, site: str) -> Rule:
    """A rule for ``host/path``: the host and its subdomains, and paths with that beginning."""
    host, slash, path = site.partition("/")
    path = slash + path
    tokens = TOKEN.findall(host) + [m[0] for m in TOKEN.finditer(path) if m.end() < len(path)]
    return Rule(site, rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}" if path else rf"\A(?:[^/]*\.)?{re.escape(host)}(?:/|\Z)", verdict, tuple(tokens), 1_000_000 + len(site))


def word_rule(verdict: str, words: str, order: int) -> Rule:
    """A rule for hosts in which ``words`` (joined by hyphens) stand as whole words."""
    return Rule(words, rf"\A(?:[^/]*[.-])?{re.escape(words)}(?:[.:-][^/]*)?(?:/|\Z)", verdict, tuple(TOKEN.findall(words)), 1_000 - order)


#: The query's site rules: fixed values of its contract.
SITE_RULES = [
    site_rule("allow", "com/"),
    site_rule("block", "example.com/en/"),
    site_rule("allow", "www.example.com/en/"),
    site_rule("block", "net/es/"),
    site_rule("block", "net/fr/"),
]

#: Words in host names that mark sites without use as training text.
BLOCKED_WORDS = ["casino", "pills", "spam", "bets", "betting", "adult", "porn", "xxx", "ads", "adserver", "tracker", "track", "warez", "viagra", "poker", "escort", "malware", "phishing"]
WORD_RULES = [word_rule("block", w, i) for i, w in enumerate(BLOCKED_WORDS)]


class Index:
    def __init__(self, rules: list[Rule]):
        uses = Counter(t for r in rules for t in set(r.tokens))
        self.by_token: dict[str, list[tuple[re.Pattern, Rule]]] = {}
        self.always: list[tuple[re.Pattern, Rule]] = []
        for rule in rules:
            entry = (re.compile(rule.pattern, re.DOTALL), rule)
            if rule.tokens:
                self.by_token.setdefault(min(rule.tokens, key=lambda t: (uses[t], -len(t), t)), []).append(entry)
            else:
                self.always.append(entry)

    def candidates(self, subject: str) -> list[tuple[re.Pattern, Rule]]:
        get = self.by_token.get
        return self.always + [e for t in dict.fromkeys(TOKEN.findall(subject)) for e in get(t, ())]

    def best(self, subject: str) -> Rule | None:
        fit = [rule for pattern, rule in self.candidates(subject) if pattern.match(subject)]
        return max(fit, key=lambda r: r.rank) if fit else None


def split_url(url: str | None) -> tuple[str, str]:
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    m = PARTS.match(url, at + 3)
    return m[1].translate(LOWER), m[2]


def judge(
    df: DataFrame,
    url: str = "url",
    rules: list[Rule] | None = None,
    default: str = "allow",
    names: tuple[str, str, str, str, str] = ("host", "path", "rule", "verdict", "pattern"),
    keep: list[str] | None = None,
) -> DataFrame:
    """Add host, path, the fitting site rule, the verdict and the fitting pattern rule."""
    rules = [*SITE_RULES, *WORD_RULES] if rules is None else rules

    def make():
        index = Index(rules)

        def apply(urls: list) -> list[pa.Array]:
            rows = []
            for u in urls:
                host, path = split_url(u)
                rule = index.best(host + path) if host or path else None
                site = rule is not None and rule.rank >= 1_000_000
                rows.append((host, path, rule.name if site else None, rule.verdict if rule else default, rule.name if rule and not site else None))
            columns = list(zip(*rows)) if rows else [()] * 5
            return [pa.array(c, pa.string()) for c in columns]

        return apply

    return append_columns(df, make, [T.StructField(n, T.StringType()) for n in names], on=url, keep=keep)
