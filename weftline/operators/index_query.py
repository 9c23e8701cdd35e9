"""Filters, projections and counts over the columnar URL index."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sort-key prefixes a set may turn into before only the one that they share is used.
MOST_PREFIXES = 64
#: Values above which a set is joined instead of listed.
MOST_LISTED = 1000

OUTPUT = ("url", "fetch_time", "fetch_status", "content_mime_detected", "content_languages", "warc_filename", "warc_record_offset", "warc_record_length")


def key_of(host: str) -> str:
    """Reversed labels between commas, as sort keys begin."""
    return ",".join(reversed([*host.strip().lower().strip(".").split(".")]))


def sort_key_prefixes(hosts: list[str], below: bool) -> list[str]:
    """Prefixes of the sort key that cover the hosts and, if below, their subdomains; none if they share nothing.

    An index is sorted by this key, so only these predicates skip row groups; they widen, never narrow, the equality
    beside them.
    """
    keys = [key_of(h) for h in hosts]
    if not keys or not all(keys):
        return []
    found = sorted({k + end for k in keys for end in ((")", ",") if below else (")",))})
    if len(found) <= MOST_PREFIXES:
        return found
    shared = os.path.commonprefix(found)
    return [shared] if shared else []


def read_set(path: str) -> list[str]:
    """Values of a file, one a line, without blank lines and # comments; an empty file is an error."""
    with open(path, encoding="utf-8") as f:
        found = [x for line in f if (x := line.strip()) and not x.startswith("#")]
    if not found:
        raise ValueError(f"{path} holds no values")
    return found


@dataclass
class IndexQuery:
    """A conjunction of filters. Negated ones let null pass; language is a substring, without wildcards."""

    domain: str | None = None
    host: str | None = None
    tld: str | None = None
    mime: str | None = None
    status: int = 0
    language: str | None = None
    path_prefix: str | None = None
    domains: list[str] = field(default_factory=list)
    hosts: list[str] = field(default_factory=list)
    not_mime: str | None = None
    not_language: str | None = None
    not_status: int = 0
    limit: int = 0

    def predicates(self) -> list[Column]:
        """Cheap ones first; row groups are pruned by those on the sort key."""
        found: list[Column] = []
        for values, below in (([self.domain] if self.domain else self.domains, True), ([self.host] if self.host else self.hosts, False)):
            if prefixes := sort_key_prefixes(values, below):
                found.append(reduce(or_, (F.col("url_surtkey").startswith(p) for p in prefixes)))
        if self.status:
            found.append(F.col("fetch_status") == self.status)
        if self.not_status:
            found.append(F.col("fetch_status").isNull() | (F.col("fetch_status") != self.not_status))
        for name, value in (("url_host_registered_domain", self.domain), ("url_host_name", self.host), ("url_host_tld", self.tld), ("content_mime_detected", self.mime)):
            if value:
                found.append(F.col(name) == value)
        for name, values in (("url_host_registered_domain", self.domains), ("url_host_name", self.hosts)):
            if values and len(values) <= MOST_LISTED:
                found.append(F.col(name).isin(*values))
        if self.not_mime:
            found.append(F.col("content_mime_detected").isNull() | (F.col("content_mime_detected") != self.not_mime))
        if self.language:
            found.append(F.contains(F.col("content_languages"), F.lit(self.language)))
        if self.not_language:
            found.append(F.col("content_languages").isNull() | ~F.contains(F.col("content_languages"), F.lit(self.not_language)))
        if self.path_prefix:
            found.append(F.col("url_path").startswith(self.path_prefix))
        return found

    def rows(self, index: DataFrame) -> DataFrame:
        for p in self.predicates():
            index = index.where(p)
        for name, values in (("url_host_registered_domain", self.domains), ("url_host_name", self.hosts)):
            if len(values) > MOST_LISTED:  # Spark broadcasts the list if it is small enough
                wanted = index.sparkSession.createDataFrame([(v,) for v in set(values)], f"{name} string")
                index = index.join(wanted, name, "left_semi")
        return index

    def _limited(self, rows: DataFrame, *order) -> DataFrame:
        return rows.orderBy(*order).limit(self.limit) if self.limit else rows

    def urls(self, index: DataFrame) -> DataFrame:
        """The default projection; with a limit, the first rows by sort key and URL."""
        return self._limited(self.rows(index).select(*OUTPUT, *(["url_surtkey"] if self.limit else [])), "url_surtkey", "url", "fetch_time", "warc_record_offset").select(*OUTPUT)

    def locations(self, index: DataFrame) -> DataFrame:
        """Where the records are: filename, offset, length, url."""
        rows = self._limited(self.rows(index), "url_surtkey", "url", "warc_record_offset")
        return rows.select(F.col("warc_filename").alias("filename"), F.col("warc_record_offset").alias("offset"), F.col("warc_record_length").alias("length"), "url")

    def count(self, index: DataFrame) -> DataFrame:
        return self.rows(index).agg(F.count("*").alias("n"))

    def group_count(self, index: DataFrame, name: str) -> DataFrame:
        """value and n; null and the empty string are groups of their own. A limit keeps the largest, then least, null first."""
        found = self.rows(index).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))
        return self._limited(found, F.desc("n"), F.asc_nulls_first("value"))

    def languages(self, index: DataFrame) -> DataFrame:
        return self.group_count(index, "content_languages")

    def mimes(self, index: DataFrame) -> DataFrame:
        return self.group_count(index, "content_mime_detected")

    def sql(self, view: str = "ccindex", columns: tuple[str, ...] = OUTPUT) -> str:
        """The query as SQL text over a view."""
        quote = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        where = []
        for values, below in (([self.domain] if self.domain else self.domains, True), ([self.host] if self.host else self.hosts, False)):
            if prefixes := sort_key_prefixes(values, below):
                where.append("(" + " OR ".join(f"startswith(url_surtkey, {quote(p)})" for p in prefixes) + ")")
        for name, value in (("url_host_registered_domain", self.domain), ("url_host_name", self.host), ("url_host_tld", self.tld), ("content_mime_detected", self.mime)):
            if value:
                where.append(f"{name} = {quote(value)}")
        for name, values in (("url_host_registered_domain", self.domains), ("url_host_name", self.hosts)):
            if values:
                where.append(f"{name} IN ({', '.join(map(quote, values))})")
        if self.status:
            where.append(f"fetch_status = {self.status}")
        if self.not_status:
            where.append(f"(fetch_status IS NULL OR fetch_status <> {self.not_status})")
        if self.language:
            where.append(f"contains(content_languages, {quote(self.language)})")
        if self.not_language:
            where.append(f"(content_languages IS NULL OR NOT contains(content_languages, {quote(self.not_language)}))")
        if self.not_mime:
            where.append(f"(content_mime_detected IS NULL OR content_mime_detected <> {quote(self.not_mime)})")
        if self.path_prefix:
            where.append(f"startswith(url_path, {quote(self.path_prefix)})")
        text = f"SELECT {', '.join(columns)} FROM {view}"
        if where:
            text += " WHERE " + " AND ".join(where)
        return text + (f" ORDER BY url_surtkey, url LIMIT {self.limit}" if self.limit else "")


#: Names that schema listings give to Spark's types.
TYPE_NAMES = {"string": "VARCHAR", "boolean": "BOOLEAN", "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "float": "FLOAT", "double": "DOUBLE", "date": "DATE", "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP", "binary": "BLOB"}


def schema_of(index: DataFrame) -> DataFrame:
    """position, column_name and column_type of a table."""
    rows = [(i, n, TYPE_NAMES.get(t, "STRUCT" if t.startswith("struct") else t.upper())) for i, (n, t) in enumerate(index.dtypes)]
    return index.sparkSession.createDataFrame(rows, "position int, column_name string, column_type string")
