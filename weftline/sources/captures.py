"""The columnar URL index: hive-partitioned Parquet in production, derived from the pages table in tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from weftline.functions import urls

#: Columns that a republished URL index keeps, in their order.
URL_COLUMNS = (
    "url_surtkey", "url", "url_host_name", "url_host_registered_domain", "url_host_tld", "url_protocol", "fetch_time", "fetch_status", "fetch_redirect",
    "content_digest", "content_mime_type", "content_mime_detected", "content_charset", "content_languages", "content_truncated",
    "warc_filename", "warc_record_offset", "warc_record_length",
)


#: The order of a written index; all of it, so that a URL captured very often is dealt over several files.
SORTED = ("crawl", "subset", "url_surtkey", "url", "fetch_time", "warc_filename", "warc_record_offset")
#: Columns whose equality filters a sort key can't serve: their row groups carry Bloom filters.
BLOOMED = ("url_host_name", "url_host_registered_domain", "content_digest")


def with_subset(rows: DataFrame) -> DataFrame:
    """The subset that a capture belongs to: successful responses, robots files, or whatever else came back."""
    robots = F.coalesce(F.col("url_path") == "/robots.txt", F.lit(False))
    return rows.withColumn("subset", F.when(robots, "robotstxt").when(F.col("fetch_status") == 200, "warc").otherwise("crawldiagnostics"))


def write_index(rows: DataFrame, base: str, files: int | None = None, row_group_rows: int = 1 << 20, page_rows: int = 20_000, mode: str = "errorifexists") -> None:
    """Captures (crawl, subset and an index's columns) as crawl=<id>/subset=<name>/*.parquet, in the order of SORTED over all files.

    Rows are dealt by ranges of that order: to `files` tasks, or as many as their bytes ask for. Files, row groups and pages then hold
    neighbours, so a prefix of the sort key skips all others by their bounds, and equality on a column of BLOOMED skips row groups by their Bloom filters.
    An empty table writes no partition.
    """
    order = [c for c in SORTED if c in rows.columns]
    dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    out = dealt.sortWithinPartitions(*order).write.partitionBy("crawl", "subset").mode(mode).option("compression", "zstd")
    out = out.option("parquet.block.row.count.limit", row_group_rows).option("parquet.page.row.count.limit", page_rows).option("parquet.bloom.filter.adaptive.enabled", "true")
    for name in BLOOMED:
        if name in rows.columns:
            out = out.option(f"parquet.bloom.filter.enabled#{name}", "true")
    out.parquet(base)


def read_index(spark: SparkSession, base: str, crawl: str | None = None, subset: str | None = None) -> DataFrame:
    """An index laid out as crawl=<id>/subset=<name>/*.parquet; the arguments prune partitions, whose names stay strings."""
    found = spark.read.parquet(base)
    kinds = StructType([StructField(f.name, StringType() if f.name in ("crawl", "subset") else f.dataType) for f in found.schema])
    if kinds != found.schema:
        found = spark.read.schema(kinds).parquet(base)
    if crawl is not None:
        found = found.where(F.col("crawl") == crawl)
    return found if subset is None else found.where(F.col("subset") == subset)


def from_pages(pages: DataFrame, crawl: str = "A") -> DataFrame:
    """Captures of the pages (page_id, url, html) as crawl A, or as crawl B, a month later, with a fifth of the pages changed and a thirteenth missing."""
    name = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1))
    late = crawl == "B"
    body = F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit("B"))).otherwise(F.col("html")) if late else F.col("html")
    hours = (F.col("page_id") + (720 if late else 0)).cast("long")
    time = F.timestamp_seconds(F.lit(1704067200) + hours * 3600)
    rows = pages.where(F.col("page_id") % 13 != 0) if late else pages
    return rows.select(
        "page_id",
        F.lit(crawl).alias("crawl"),
        F.concat(urls.surt_host_key(name), F.lit(")"), urls.path(F.col("url"))).alias("url_surtkey"),
        "url",
        name.alias("url_host_name"),
        urls.tld(name).alias("url_host_tld"),
        urls.naive_domain(name).alias("url_host_registered_domain"),
        urls.path(F.col("url")).alias("url_path"),
        urls.scheme(F.col("url")).alias("url_protocol"),
        F.when(F.col("page_id") % 10 == 1, F.concat(F.lit("https://"), name, F.lit("/"))).alias("fetch_redirect"),
        F.lit("text/html").alias("content_mime_type"),
        F.upper(F.nullif(F.regexp_extract("html", '<meta charset="([^"]*)"', 1), F.lit(""))).alias("content_charset"),
        F.when(F.col("page_id") % 17 == 0, "length").alias("content_truncated"),
        F.when(F.col("page_id") % 10 == 0, 404).when(F.col("page_id") % 10 == 1, 301).otherwise(200).cast("int").alias("fetch_status"),
        F.when(F.col("page_id") % 4 == 2, "application/pdf").when(F.col("page_id") % 4 == 1, "application/xhtml+xml").otherwise("text/html").alias("content_mime_detected"),
        F.when(F.col("page_id") % 7 == 0, F.lit(None)).when(F.col("page_id") % 11 == 0, "").otherwise(F.regexp_extract("html", '<html lang="([^"]*)"', 1)).alias("content_languages"),
        F.sha2(body, 256).alias("content_digest"),
        F.date_format(time, "yyyyMMddHHmmss").alias("timestamp"),
        F.to_timestamp_ntz(F.date_format(time, "yyyy-MM-dd HH:mm:ss")).alias("fetch_time"),
        F.concat(F.lit("part-"), (F.col("page_id") % 5).cast("string")).alias("warc_filename"),
        (F.col("page_id") * 1000).alias("warc_record_offset"),
        F.octet_length("html").cast("long").alias("warc_record_length"),
    )


#: The same in DuckDB, as the start of a WITH clause that ends with the tables captures (crawl A) and captures_b.
SQL = """
WITH base AS (
    SELECT page_id, url, html, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host,
           coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1), ''), '/') AS path
    FROM pages
), common AS (
    SELECT page_id, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || path AS url_surtkey, url, html, host AS url_host_name,
           regexp_extract(host, '([^.]+)$', 1) AS url_host_tld, regexp_extract(host, '([^.]+[.][^.]+)$', 1) AS url_host_registered_domain,
           path AS url_path, regexp_extract(url, '^([a-z]+)://', 1) AS url_protocol, CASE WHEN page_id % 10 = 1 THEN 'https://' || host || '/' END AS fetch_redirect,
           'text/html' AS content_mime_type, upper(nullif(regexp_extract(html, '<meta charset="([^"]*)"', 1), '')) AS content_charset,
           CASE WHEN page_id % 17 = 0 THEN 'length' END AS content_truncated, (CASE page_id % 10 WHEN 0 THEN 404 WHEN 1 THEN 301 ELSE 200 END)::INT AS fetch_status,
           CASE page_id % 4 WHEN 2 THEN 'application/pdf' WHEN 1 THEN 'application/xhtml+xml' ELSE 'text/html' END AS content_mime_detected,
           CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 11 = 0 THEN '' ELSE regexp_extract(html, '<html lang="([^"]*)"', 1) END AS content_languages,
           'part-' || (page_id % 5) AS warc_filename, page_id * 1000 AS warc_record_offset, strlen(html)::BIGINT AS warc_record_length
    FROM base
), captures AS (
    SELECT *, 'A' AS crawl, sha256(html) AS content_digest, TIMESTAMP '2024-01-01' + to_hours(page_id) AS fetch_time,
           strftime(TIMESTAMP '2024-01-01' + to_hours(page_id), '%Y%m%d%H%M%S') AS timestamp
    FROM common
), captures_b AS (
    SELECT *, 'B' AS crawl, sha256(CASE WHEN page_id % 5 = 0 THEN html || 'B' ELSE html END) AS content_digest, TIMESTAMP '2024-01-01' + to_hours(page_id + 720) AS fetch_time,
           strftime(TIMESTAMP '2024-01-01' + to_hours(page_id + 720), '%Y%m%d%H%M%S') AS timestamp
    FROM common WHERE page_id % 13 <> 0
)
"""
