"""robots.txt after RFC 9309: records, groups by agent, and one compiled program for each host that tells which rule decides."""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache
from itertools import groupby
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Printable ASCII but for the escape sign.
PLAIN = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) != "%")
ENTRY = "struct<rules: array<struct<allow: boolean, pattern: string>>, delay: double, sitemaps: array<string>>"
#: The fields that are read, and what they say; the first is often written without its hyphen.
FIELDS = {"user-agent": "agent", "user agent": "agent", "useragent": "agent", "allow": "allow", "disallow": "disallow", "crawl-delay": "delay", "sitemap": "sitemap"}
RECORD = re.compile(rf"[ \t]*(?P<field>{'|'.join(FIELDS)})[ \t]*:(?P<value>[^#]*)", re.IGNORECASE)
SECONDS = re.compile(r"\d+(?:\.\d*)?|\.\d+")


def normalise(path: str) -> str:
    """The form in which RFC 9309 compares paths and patterns: valid escapes in upper case, all but printable ASCII escaped."""
    parts = re.split(r"(%[0-9A-Fa-f]{2})", path)  # plain parts and escapes in turn
    return "".join(part.upper() if k % 2 else quote(part, safe=PLAIN, errors="surrogatepass") for k, part in enumerate(parts))


def records(body: str) -> list[tuple[str, str]]:
    """Kind and value of each line that says something."""
    found = (RECORD.match(line) for line in re.split(r"[\r\n]+", body.removeprefix("\ufeff")))
    return [(FIELDS[m["field"].lower()], m["value"].strip()) for m in found if m]


def product(agent: str) -> str:
    """The product token that a name begins with."""
    return re.match(r"[a-z_-]*", agent.strip().lower())[0]


def by_agent(said: list[tuple[str, str]]) -> dict[str, list[tuple[str, str]]]:
    """What is said to each agent: runs of agent lines and of rules take turns, and groups that name an agent again go on."""
    groups, named = defaultdict(list), []
    for is_agents, run in groupby((r for r in said if r[0] != "sitemap"), key=lambda r: r[0] == "agent"):
        values = [*run]
        if is_agents:
            named = dict.fromkeys("*" if v == "*" else product(v) for _, v in values if v)
            for token in named:
                groups[token] += []
        else:
            for token in named:
                groups[token] += values
    return groups


def parse(body: str | None, agent: str) -> dict:
    """Rules for the longest product token that the agent's begins with (else for *), their longest delay, and all sitemaps."""
    said, own = records(body or ""), product(agent)
    groups = by_agent(said)
    token = max((t for t in groups if t and t != "*" and own.startswith(t)), key=len, default="*")
    chosen = groups.get(token, [])
    delays = [float(v) for k, v in chosen if k == "delay" and SECONDS.fullmatch(v)]
    return {
        "rules": [{"allow": k == "allow", "pattern": normalise(v)} for k, v in chosen if k != "delay" and v],
        "delay": max((d for d in delays if d > 0), default=None),
        "sitemaps": [v for k, v in said if k == "sitemap" and v],
    }


def expression(pattern: str) -> str:
    """A regular expression for paths that a pattern fits: after each star the first place of the next literal is taken, and never given back."""
    first, *rest = map(re.escape, pattern.removesuffix("$").split("*"))
    if not pattern.endswith("$"):
        return first + "".join(rf"(?>[\s\S]*?{x})" for x in rest if x)
    *middle, last = rest or [None]
    return first + "".join(rf"(?>[\s\S]*?{x})" for x in middle if x) + (r"\Z" if last is None else rf"[\s\S]*?{last}\Z")


@lru_cache(maxsize=1024)
def program(rules: str) -> tuple[re.Pattern | None, list[bool]]:
    """All rules of a host, one a line with + or - before its pattern, as one expression: the longest first, allow before disallow. The group
    that matches tells the verdict."""
    ordered = sorted({(len(r) - 1, r[0] == "+", r[1:]) for r in rules.split("\n") if r}, reverse=True)
    return (re.compile("|".join(f"({expression(p)})" for _, _, p in ordered)) if ordered else None), [allow for _, allow, _ in ordered]


def verdict(rules: str, path: str | None) -> bool:
    """Whether the rule that decides allows a path; no rule allows."""
    compiled, allows = program(rules)
    found = compiled.match(normalise(path or "/")) if compiled else None
    return allows[found.lastindex - 1] if found else True


def written(rules: list) -> str:
    """Rules as program() reads them; patterns are escaped, so they hold no line ends."""
    return "\n".join(("+" if r["allow"] else "-") + r["pattern"] for r in rules)


def matches(pattern: str, path: str) -> bool:
    """Whether a path begins with a pattern; ``*`` stands for anything, a last ``$`` for the path's end."""
    return bool(re.match(expression(pattern), path))


def allowed(rules: list, path: str | None) -> bool:
    """The longest rule that matches decides, allow before disallow; no rule allows."""
    return verdict(written(rules), path)


def parse_column(agent: str):
    @F.pandas_udf(ENTRY)
    def entry(body: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(b, agent) for b in body], columns=["rules", "delay", "sitemaps"])

    return entry


@F.pandas_udf(T.BooleanType())
def verdict_column(rules: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([verdict(r or "", p) for r, p in zip(rules, path, strict=True)])


def decide(urls: DataFrame, files: DataFrame, agent: str) -> DataFrame:
    """urls (host, path, ...) with allowed and delay; files (host, status, body): a server error forbids, a missing file allows.

    A file is parsed once. URLs carry its rules as one string, by which each worker finds the compiled program of their host, so a host
    with very many URLs is neither parsed nor compiled again for them, and needn't be in one task.
    """
    entries = files.select("host", "status", parse_column(agent)("body").alias("entry"))
    rule = F.transform("entry.rules", lambda r: F.concat(F.when(r["allow"], "+").otherwise("-"), r["pattern"]))
    known = entries.select("host", F.struct("status", F.col("entry.delay").alias("delay"), F.array_join(rule, "\n").alias("rules")).alias("robots_entry"))
    rows = urls.join(known, "host", "left")
    status = F.col("robots_entry.status")
    allows = F.when(status >= 500, False).when((status >= 400) | status.isNull(), True).otherwise(verdict_column(F.coalesce("robots_entry.rules", F.lit("")), F.col("path")))
    return rows.select(*urls.columns, allows.alias("allowed"), F.col("robots_entry.delay").alias("delay"))
