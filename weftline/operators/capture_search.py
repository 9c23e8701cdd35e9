"""Search over captures of several crawls: patterns, field filters, times, and the choice among captures of a URL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text, urls

#: Captures on a result page, for estimates.
PAGE = 3000


def pattern(spec: str) -> tuple[str, str]:
    """The bare URL or host of a pattern, and how it matches: domain (*.host), prefix (url*) or exact."""
    spec = spec.strip()
    if spec.startswith("*."):
        return spec[2:], "domain"
    return (spec[:-1], "prefix") if spec.endswith("*") else (spec, "exact")


def matches(url: Column, spec: str, how: str | None = None) -> Column:
    """Whether a URL matches a pattern; how may be host, domain, prefix or exact."""
    bare, guessed = pattern(spec)
    how = how or guessed
    trimmed = lambda c: F.regexp_replace(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    name = urls.host(url)
    wanted = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "", bare)
    if how == "domain":
        host = wanted.split("/")[0].lower()
        return (name == host) | name.endswith("." + host)
    if how == "host":
        return name == wanted.split("/")[0].lower()
    if how == "prefix":
        return trimmed(url).startswith(wanted)
    return F.regexp_replace(trimmed(url), "/$", "") == wanted.removesuffix("/")


def field_filter(spec: str, columns: dict[str, Column]) -> Column:
    """A filter [!][~|=]field:value: ~ is a regular expression from the start, ! negates; unknown fields keep every row."""
    negated, rest = spec.startswith("!"), spec.removeprefix("!")
    regex = rest.startswith("~")
    name, _, value = rest.removeprefix("~" if regex else "=").partition(":")
    if name not in columns:
        return F.lit(True)
    column = F.coalesce(columns[name], F.lit(""))
    hit = column.rlike(f"^(?:{value})") if regex else column == value
    return ~hit if negated else hit


def between_times(timestamp: Column, since: str = "", until: str = "") -> Column:
    """Both bounds count, at whatever precision they are given."""
    low, high = text.loose_timestamp(since, False), text.loose_timestamp(until, True)
    found = F.lit(True)
    if low:
        found = found & (timestamp >= low)
    return found & (timestamp <= high) if high else found


def search(captures: DataFrame, spec: str, filters: tuple[str, ...] = (), since: str = "", until: str = "", contains: str = "", lacks: str = "", how: str | None = None) -> DataFrame:
    """Captures (url, timestamp, status, mime, languages, digest, ...) that match everything asked for."""
    columns = {c: F.col(c).cast("string") for c in captures.columns}
    found = captures.where(matches(F.col("url"), spec, how)).where(between_times(F.col("timestamp"), since, until))
    for f in filters:
        found = found.where(field_filter(f, columns))
    if contains:
        found = found.where(F.contains(F.col("url"), F.lit(contains)))
    return found.where(~F.contains(F.col("url"), F.lit(lacks))) if lacks else found


def nearest(captures: DataFrame, target: str, visit: str = "visit", sequence: str = "sequence") -> DataFrame:
    """The capture of each URL nearest to a 14-digit time, by the difference of the digits; ties go to the earlier visit and record."""
    distance = F.abs(F.coalesce(F.try_to_number("timestamp", F.lit("9" * 14)).cast("long"), F.lit(0)) - F.lit(int(text.loose_timestamp(target, False) or 0)))
    return _first(captures.withColumn("__distance", distance), ["url"], ["__distance", visit, sequence]).drop("__distance")


def nearest_in_time(captures: DataFrame, target: str, visit: str = "visit", sequence: str = "sequence") -> DataFrame:
    """The same by seconds."""
    seconds = lambda c: F.unix_timestamp(F.try_to_timestamp(c, F.lit("yyyyMMddHHmmss")))
    distance = F.abs(seconds(F.col("timestamp")) - seconds(F.lit(text.loose_timestamp(target, False))))
    return _first(captures.withColumn("__distance", F.coalesce(distance, F.lit(1 << 62))), ["url"], ["__distance", visit, sequence]).drop("__distance")


def _first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")


def latest_only(captures: DataFrame, visit: str = "visit", sequence: str = "sequence") -> DataFrame:
    """The capture of each URL that comes first in visit order: of the newest crawl, the first in index order."""
    return _first(captures, ["url"], [visit, "url_surtkey", sequence])


def digest_dedup(captures: DataFrame, visit: str = "visit", sequence: str = "sequence") -> DataFrame:
    """The first capture of each digest; captures without a digest all stay.

    They get a key of their own each, so that no task has to hold them all.
    """
    own = F.coalesce(F.nullif("digest", F.lit("")), F.concat_ws(" ", F.lit("none"), "url", visit, sequence))
    return _first(captures.withColumn("__digest", own), ["__digest"], [visit, "url_surtkey", sequence]).drop("__digest")


def size_estimate(pages: DataFrame) -> DataFrame:
    """crawl and captures for result pages (crawl, pages), and a total if there are several crawls."""
    each = pages.select("crawl", (F.col("pages") * PAGE).cast("long").alias("captures"))
    total = each.agg(F.count("*").alias("n"), F.sum("captures").alias("captures")).where("n > 1").select(F.lit("total").alias("crawl"), "captures")
    return each.unionByName(total)
