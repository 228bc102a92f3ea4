"""URL filters: host and path rules, then pattern rules indexed by their rarest literal token.

A pattern is ``[@@]`` (an exception) and then literals with ``*`` (anything),
``^`` (a separator or the end), a leading ``||`` (start of a host label) or
``|`` (start), a trailing ``|`` (end); it is matched against the lower-cased
url. A literal token that stands between separators must be a token of every
url that the pattern matches, so a pattern is filed under the one that the
fewest urls hold (counted over all urls), and a url runs only the regular
expressions filed under its own tokens. Patterns without such a token run on
every url.

Host and path rules go first: a rule fits its host and all its subdomains if
the url's path starts with the rule's; the longest wins, and its verdict holds.

Defined results: a null url, or one without ``://``, has an empty host and
path, fits no host rule, and is allowed unless a pattern says otherwise; a url
of any length is matched whole; of the patterns that match the first by text
is named. Ids are carried as they are, repeated rows are judged alike, and
other columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import FILTER_ROWS


class HostRule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The host and path rules of the contract.
HOST_RULES = (
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)

def listed(lines: Iterable[str]) -> list[str]:
    """The patterns of a list's lines; those that are blank or begin with ``!`` do not count."""
    return [x for line in lines if (x := line.strip()) and not x.startswith("!")]


#: The list in production, a file beside this module; tracking and paging parameters alone are no reason to block.
RULE_FILE = Path(__file__).with_name("url_rules.txt")


class Pattern(NamedTuple):
    text: str
    block: bool
    regex: str
    tokens: tuple[str, ...]


def compiled(text: str) -> Pattern:
    body = text.removeprefix("@@").lower()
    regex, rest = "", body
    if rest.startswith("||"):
        regex, rest = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*[.@])?", rest[2:]
    elif rest.startswith("|"):
        regex, rest = "^", rest[1:]
    end = rest.endswith("|")
    rest = rest[:-1] if end else rest
    for c in rest:
        regex += ".*" if c == "*" else r"(?:[^a-z0-9_.%-]|$)" if c == "^" else re.escape(c)
    # A token counts only if neither end can run on: no wildcard and no open end beside it.
    framed = ("|" if body.startswith("|") else "*") + rest + ("|" if end else "*")
    tokens = tuple(m[1] for m in re.finditer(r"(?<![a-z0-9*])([a-z0-9]+)(?![a-z0-9*])", framed))
    return Pattern(text, not text.startswith("@@"), regex + ("$" if end else ""), tokens)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): after the first ://, A-Z of the host lower-cased."""
    if not url or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.partition("://")[2])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def url_tokens(url: str | None) -> set[str]:
    return set(re.findall(r"[a-z0-9]+", (url or "").lower()))


#: The patterns of production.
PATTERNS = tuple(listed(RULE_FILE.read_text(encoding="utf-8").splitlines()))


class UrlFilter:
    """The rules, indexed: hosts by name, patterns by rarest token. Regular expressions are compiled when they first run."""

    def __init__(self, hosts: Sequence[HostRule], patterns: Sequence[str], seen: dict[str, int]):
        self.hosts: dict[str, list[HostRule]] = defaultdict(list)
        for r in sorted(hosts, key=lambda r: -len(r.name)):
            self.hosts[r.host].append(r)
        self.by_token: dict[str, list[Pattern]] = defaultdict(list)
        for p in map(compiled, patterns):
            self.by_token[min(p.tokens, key=lambda t: (seen.get(t, 0), t), default="")].append(p)
        self.ready: dict[str, re.Pattern] = {}

    def matches(self, p: Pattern, low: str) -> bool:
        if p.regex not in self.ready:
            self.ready[p.regex] = re.compile(p.regex, re.DOTALL)
        return bool(self.ready[p.regex].search(low))

    def rule(self, host: str, path: str) -> HostRule | None:
        labels, found = host.split(".") if host else [], []
        for i in range(len(labels)):
            found += [r for r in self.hosts.get(".".join(labels[i:]), ()) if path.startswith(r.path)][:1]
        return max(found, key=lambda r: len(r.name), default=None)

    def pattern(self, url: str | None) -> Pattern | None:
        """The first exception that matches, or else the first block, by list order of the candidates' text."""
        low = (url or "").lower()
        hits = [p for t in ("", *url_tokens(low)) for p in self.by_token.get(t, ()) if self.matches(p, low)]
        return min(hits, key=lambda p: (p.block, p.text), default=None)


def load_patterns(spark: SparkSession, path: str) -> list[str]:
    """The patterns of a text file that Spark reads, one a line."""
    return listed(r.value for r in spark.read.text(path).collect())  # the rule list, not the corpus


def token_counts(pages: DataFrame, url_col: str, tokens: Sequence[str]) -> dict[str, int]:
    """In how many urls each of the rules' tokens stands: one number per token of the list."""
    if not tokens:
        return {}
    wanted = pages.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    found = pages.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(url_col)), F.lit("[a-z0-9]+"), 0))).alias("token"))
    return dict(found.join(F.broadcast(wanted) if len(tokens) <= FILTER_ROWS else wanted, "token", "left_semi").groupBy("token").count().collect())


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", hosts: Sequence[HostRule] = HOST_RULES, patterns: Sequence[str] = PATTERNS) -> DataFrame:
    """(id, host, path, rule, verdict, pattern) for each row of ``pages``; the index is broadcast, its size is the list's."""
    seen = token_counts(pages, url_col, sorted({t for p in patterns for t in compiled(p).tokens}))
    sent = pages.sparkSession.sparkContext.broadcast(UrlFilter(hosts, patterns, seen))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in batches:
            out: list[tuple] = []
            for u in b.column("url").to_pylist():
                host, path = split_url(u)
                rule, hit = index.rule(host, path), None
                if rule is None:
                    hit = index.pattern(u)
                verdict = rule.verdict if rule else "block" if hit and hit.block else "allow"
                out.append((host, path, rule.name if rule else None, verdict, hit.text if hit else None))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([r[i] for r in out], pa.string()) for i in range(5))], ["id", "host", "path", "rule", "verdict", "pattern"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, host string, path string, rule string, verdict string, pattern string")
