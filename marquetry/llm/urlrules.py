"""URL filters: pattern rules indexed by their rarest literal token; only rules fetched by a URL's tokens run their expression.

Tokens are runs of letters and digits. A rule stands under the token that the fewest URLs hold; a token that may be part of a
longer one in a URL stands by its first or last EDGE characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[0-9A-Za-z]+")
EDGE = 4
#: Rules that a table may hold: each task gets them all (about 1 kB each, compiled).
MAX_RULES = 200_000


@dataclass(frozen=True)
class HostRule:
    """Verdict for a host, its subdomains and paths that start with `path`; the longest fitting rule wins."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """Verdict for URLs in which the pattern occurs: literal text with `*` for any run and `^` for a separator or the end."""

    verdict: str
    pattern: str

    @property
    def text(self) -> str:
        return self.pattern


#: The rules that come first.
HOST_RULES = (
    HostRule("block", "com", "/en/"),
    HostRule("allow", "example.com", "/en/7"),
    HostRule("allow", "net", "/de/"),
    HostRule("block", "example.net", "/de/8"),
    HostRule("block", "org", "/es/"),
)
#: Asked where no host rule fits; a URL that none fits is allowed.
PATTERN_RULES = (
    PatternRule("block", "spam-farm."),
    PatternRule("block", "cheap-pills."),
    PatternRule("block", "casino^"),
    PatternRule("block", "/ads/*.html"),
    PatternRule("block", "^malware^"),
)


def _expression(rule: HostRule | PatternRule) -> str:
    if isinstance(rule, HostRule):
        return r"(?:[^/]*\.)?" + re.escape(rule.host) + ("" if rule.path else r"(?:/|\Z)") + re.escape(rule.path)
    parts = {"*": ".*", "^": r"(?:[^0-9A-Za-z_.%-]|\Z)"}
    return ".*?" + "".join(parts.get(c, re.escape(c)) for c in rule.pattern)


def _keys(rule: HostRule | PatternRule) -> set[str]:
    """Keys that each fitting URL has: whole tokens, and edges of those with a literal separator on one side only."""
    if isinstance(rule, HostRule):  # host labels are whole; a path's last token may be a mere prefix
        found = {t.lower() for t in TOKEN.findall(rule.host)}
        spots, text, open_start = list(TOKEN.finditer(rule.path)), rule.path, False
    else:
        found, spots, text, open_start = set(), list(TOKEN.finditer(rule.pattern)), rule.pattern, True
    for m in spots:
        left = text[m.start() - 1] != "*" if m.start() else not open_start and not isinstance(rule, HostRule)
        right = m.end() < len(text) and text[m.end()] != "*"
        token = m[0].lower()
        if left and right:
            found.add(token)
        elif left and len(token) >= EDGE:
            found.add(token[:EDGE] + ">")
        elif right and len(token) >= EDGE:
            found.add("<" + token[-EDGE:])
    return found


def url_keys(address: str) -> set[str]:
    """The keys under which rules for host + path may stand."""
    tokens = {t.lower() for t in TOKEN.findall(address)}
    return tokens | {t[:EDGE] + ">" for t in tokens} | {"<" + t[-EDGE:] for t in tokens}


class RuleIndex:
    """Rules under their rarest key (by the URLs that hold it, then by rules, then text); rules without one are always candidates."""

    def __init__(self, rules: Iterable[HostRule | PatternRule], urls: dict[str, int] | None = None):
        self.rules = list(rules)
        self.compiled = [re.compile(_expression(r), re.DOTALL) for r in self.rules]
        keys = [_keys(r) for r in self.rules]
        count, urls = Counter(t for own in keys for t in own), urls or {}
        self.always = [k for k, own in enumerate(keys) if not own]
        self.by_key: dict[str, list[int]] = {}
        for k, own in enumerate(keys):
            if own:
                self.by_key.setdefault(min(own, key=lambda t: (urls.get(t, 0), count[t], t)), []).append(k)

    def fitting(self, address: str) -> Iterator[HostRule | PatternRule]:
        """Rules that fit host + path; their expressions run for candidates only."""
        for k in self.always + [k for t in url_keys(address) for k in self.by_key.get(t, ())]:
            if self.compiled[k].match(address):
                yield self.rules[k]


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path) of what follows the first `://`; both empty for null or no `://`."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    address = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = address.partition("/")
    return host.translate(_LOWER), slash + path


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def judge_url(url: str | None, hosts: RuleIndex, patterns: RuleIndex) -> tuple[str, str, str | None, str]:
    """(host, path, rule, verdict): the longest fitting host rule (ties: block, then text), else a pattern, else allow."""
    host, path = split_url(url)
    address = host + path
    if found := list(hosts.fitting(address)):
        best = min(found, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
        return host, path, best.text, best.verdict
    if found := list(patterns.fitting(address)):
        return host, path, None, min(found, key=lambda r: (-len(r.text), r.verdict != "block", r.text)).verdict
    return host, path, None, "allow"


def read_rules(table: DataFrame) -> tuple[list[HostRule], list[PatternRule]]:
    """Rules of a table (verdict, host, path, pattern): host rules where pattern is null. Their number is checked first."""
    n = table.count()
    if n > MAX_RULES:
        raise ValueError(f"{n} rules; at most {MAX_RULES} go to every task")
    hosts, patterns = [], []
    for r in table.select("verdict", "host", "path", "pattern").toLocalIterator():
        if r["verdict"] not in ("allow", "block"):
            raise ValueError(f"verdict {r['verdict']!r}")
        if r["pattern"] is None:
            hosts.append(HostRule(r["verdict"], r["host"] or "", r["path"] or ""))
        else:
            patterns.append(PatternRule(r["verdict"], r["pattern"]))
    return hosts, patterns


def key_counts(pages: DataFrame, rules: Iterable[HostRule | PatternRule], url_col: str = "url") -> dict[str, int]:
    """How many URLs hold each key of the rules; the keys of rules, no others, are counted and reach the driver."""
    wanted = sorted({t for r in rules for t in _keys(r)})
    if not wanted:
        return {}
    address = F.regexp_extract(F.substring_index(F.col(url_col), "://", -1), r"^[^?#]*", 0)
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(address), F.lit("([0-9a-z]+)")))
    edges = F.concat(tokens, F.transform(tokens, lambda t: F.concat(F.left(t, F.lit(EDGE)), F.lit(">"))), F.transform(tokens, lambda t: F.concat(F.lit("<"), F.right(t, F.lit(EDGE)))))
    held = pages.select(F.explode(F.array_distinct(edges)).alias("key")).where(F.col("key").isin(wanted))
    return {r[0]: r[1] for r in held.groupBy("key").count().toLocalIterator()}


def url_filter(pages: DataFrame, host_rules: Iterable[HostRule] = HOST_RULES, pattern_rules: Iterable[PatternRule] = PATTERN_RULES, url_col: str = "url") -> DataFrame:
    """Judge each URL; adds host, path, rule (null where the verdict is a pattern's or the default) and verdict.

    Null URLs and those without `://` have an empty host and path, fit no host rule and so get the patterns' verdict
    or `allow`. One pass counts in how many URLs the rules' keys occur; then rows are judged one by one, in Arrow batches,
    without a shuffle, so long, empty and repeated URLs need no care; columns of pages that bear these
    names are replaced. An empty table gives an empty result.
    """
    host_rules, pattern_rules = list(host_rules), list(pattern_rules)
    counts = key_counts(pages, [*host_rules, *pattern_rules], url_col)
    hosts, patterns = RuleIndex(host_rules, counts), RuleIndex(pattern_rules, counts)

    @F.pandas_udf("struct<host:string,path:string,rule:string,verdict:string>")
    def judged(urls: pd.Series) -> pd.DataFrame:
        rows = [judge_url(u if isinstance(u, str) else None, hosts, patterns) for u in urls]
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"], dtype=object)

    pages = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c in pages.columns and c != url_col])
    return pages.withColumn("_u", judged(F.col(url_col))).select(*[F.col(f"`{c}`") for c in pages.columns], "_u.*")
