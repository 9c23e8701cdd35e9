"""Queries over captures of two crawls."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import hashes, urls
from weftline.operators import capture_search as search
from weftline.operators import suffixes
from weftline.queries.registry import query
from weftline.session import table
from weftline.sources import captures

BOTH = captures.SQL.rstrip() + """, both_crawls AS (
    SELECT *, 0 AS visit, page_id AS sequence, CASE WHEN page_id % 17 = 0 THEN '' ELSE substr(content_digest, 1, 2) END AS digest FROM captures_b
    UNION ALL SELECT *, 1, page_id, CASE WHEN page_id % 17 = 0 THEN '' ELSE substr(content_digest, 1, 2) END FROM captures
)
"""  # fmt: skip


def both(spark, sf_dir):
    """Captures of both crawls in visit order, the newer first; digests are shortened so that some repeat, and some are empty."""
    pages = table(spark, sf_dir, "pages")
    rows = captures.from_pages(pages, "B").withColumn("visit", F.lit(0)).unionByName(captures.from_pages(pages, "A").withColumn("visit", F.lit(1)))
    short = F.when(F.col("page_id") % 17 == 0, "").otherwise(F.substring("content_digest", 1, 2))
    return rows.withColumns({"sequence": F.col("page_id"), "digest": short})


OUT = ["crawl", "page_id", "url", "timestamp"]


def as_capture(rows):
    return rows.withColumns({"status": F.col("fetch_status"), "mime": F.col("content_mime_detected"), "languages": F.col("content_languages")})


@query(BOTH + "SELECT crawl, page_id, url, timestamp FROM both_crawls WHERE url_host_name = 'example.com' OR url_host_name LIKE '%.example.com'")
def search_domain(spark, sf_dir):
    return search.search(both(spark, sf_dir), "*.example.com").select(*OUT)


@query(BOTH + "SELECT crawl, page_id, url, timestamp FROM both_crawls WHERE starts_with(regexp_replace(url, '^[a-z]+://', ''), 'ththin.example.com/en/')")
def search_prefix(spark, sf_dir):
    return search.search(both(spark, sf_dir), "http://ththin.example.com/en/*").select(*OUT)


@query(BOTH + "SELECT crawl, page_id, url, timestamp FROM both_crawls WHERE url_host_name LIKE '%.example.com' AND fetch_status <> 404 AND content_mime_detected = 'text/html' AND regexp_matches(url, '^(?:https?://m[.])') AND timestamp BETWEEN '20240102000000' AND '20240214235959' AND contains(url, '/en') AND NOT contains(url, 'utm_')")
def search_filters(spark, sf_dir):
    """Field filters, loose time bounds and parts of URLs."""
    filters = ("!status:404", "=mime:text/html", "~url:https?://m[.]", "unknown:x")
    rows = as_capture(both(spark, sf_dir))
    return search.search(rows, "*.example.com", filters, "2024-01-02", "2024-02-14", "/en", "utm_").select(*OUT)


NEAREST = "SELECT crawl, page_id, url, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY abs(timestamp::BIGINT - 20240120000000), visit, sequence) AS rn FROM both_crawls) WHERE rn = 1"


@query(BOTH + NEAREST)
def search_nearest(spark, sf_dir):
    return search.nearest(both(spark, sf_dir), "20240120").select(*OUT)


@query(BOTH + "SELECT crawl, page_id, url, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY abs(epoch(strptime(timestamp, '%Y%m%d%H%M%S')) - epoch(TIMESTAMP '2024-01-20')), visit, sequence) AS rn FROM both_crawls) WHERE rn = 1")
def search_nearest_in_time(spark, sf_dir):
    return search.nearest_in_time(both(spark, sf_dir), "20240120").select(*OUT)


@query(BOTH + NEAREST + " ORDER BY timestamp DESC, url, crawl LIMIT 25")
def search_nearest_newest(spark, sf_dir):
    """Winners, newest first, then limited."""
    return search.nearest(both(spark, sf_dir), "20240120").select(*OUT).orderBy(F.desc("timestamp"), "url", "crawl").limit(25)


LATEST = ", latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY visit, url_surtkey, sequence) AS rn FROM both_crawls) WHERE rn = 1)"


@query(BOTH + LATEST + " SELECT crawl, page_id, url, timestamp FROM latest")
def search_latest_only(spark, sf_dir):
    return search.latest_only(both(spark, sf_dir)).select(*OUT)


@query(BOTH + LATEST + " SELECT crawl, page_id, url, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY digest, CASE WHEN digest = '' THEN url || visit || sequence ELSE '' END ORDER BY visit, url_surtkey, sequence) AS k FROM latest) WHERE k = 1")
def search_latest_digests(spark, sf_dir):
    """Digests after URLs: a URL whose capture goes for its digest stays seen."""
    return search.digest_dedup(search.latest_only(both(spark, sf_dir))).select(*OUT)


@query(BOTH + ", n AS (SELECT crawl, count(*) * 3000 AS captures FROM both_crawls GROUP BY 1) SELECT crawl, captures::BIGINT AS captures FROM n UNION ALL SELECT 'total', sum(captures)::BIGINT FROM n")
def search_estimate(spark, sf_dir):
    return search.size_estimate(both(spark, sf_dir).groupBy("crawl").agg(F.count("*").alias("pages")))


@query(
    """WITH p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1), ''), '/') AS path,
           regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS q FROM pages),
    s AS (SELECT *, regexp_replace(host, '^www[.]', '') AS bare, array_to_string(list_filter(string_split(q, '&'), lambda x: NOT list_contains(['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'msclkid', 'ref', 'source', '_ga'], string_split(x, '=')[1])), '&') AS kept FROM p)
    SELECT page_id, host, regexp_extract(host, '([^.]+)$', 1) AS tld, array_to_string(list_reverse(string_split(host, '.')), '.') AS reversed,
           array_to_string(list_reverse(string_split(bare, '.')), ',') || ')' || lower(path) || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS surt, regexp_replace(url, '#.*$', '') AS canonical,
           scheme || '://' || host || regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1) || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS normal, regexp_extract(host, '([^.]+[.][^.]+)$', 1) AS domain FROM s"""
)
def url_functions(spark, sf_dir):
    url = F.col("url")
    name = urls.host(url)
    return table(spark, sf_dir, "pages").select(
        "page_id", name.alias("host"), urls.tld(name).alias("tld"), urls.reverse_host(name).alias("reversed"), urls.surt(url).alias("surt"),
        urls.canonical_url(url).alias("canonical"), urls.normalize_url(url).alias("normal"), urls.registered_domain(name).alias("domain"),
    )


def fnv(text, bits, basis, prime):
    """SQL for FNV-1a of an ASCII string."""
    return f"list_reduce(list_transform(string_split({text}, ''), lambda c: unicode(c)::HUGEINT), lambda h, b: (xor(h, b) * {prime}) % {1 << bits}, {basis}::HUGEINT)"


FNV64 = (64, 14695981039346656037, 1099511628211)


@query(
    f"SELECT page_id, lower(lpad(to_hex(({fnv('url', *FNV64)})::UBIGINT), 16, '0')) AS doc_id, substr(sha256(url), 1, 32) AS markdown_id, "
    f"({fnv('domain', *FNV64)} % 3)::INT AS shard, {fnv('url', 32, 2166136261, 16777619)}::DOUBLE / 4294967296 AS sample "
    "FROM (SELECT page_id, url, regexp_extract(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '([^.]+[.][^.]+)$', 1) AS domain FROM pages)"
)
def url_identifiers(spark, sf_dir):
    """FNV identifiers, shards and samples."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", hashes.fnv64_hex(url).alias("doc_id"), hashes.markdown_doc_id(url).alias("markdown_id"), hashes.shard(urls.registered_domain(urls.host(url)), 3).alias("shard"), hashes.sample_fraction(url).alias("sample")
    )


@query(f"SELECT page_id, lower(lpad(to_hex(({fnv('canonical', *FNV64)})::UBIGINT), 16, '0')) AS doc_id FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS canonical FROM pages)")
def document_ids(spark, sf_dir):
    """Identifiers of pages by canonical URL, which has no fragment."""
    return table(spark, sf_dir, "pages").select("page_id", hashes.document_id(F.col("url")).alias("doc_id"))


@query("SELECT page_id, substr(sha256(url), 1, 32) AS markdown_id, sha1(html) AS body_sha1 FROM pages")
def url_digests(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", hashes.markdown_doc_id(F.col("url")).alias("markdown_id"), F.sha1("html").alias("body_sha1"))


#: Rules that set some of the pages' hosts apart: plain, wildcard and exception.
SUFFIX_RULES = ("com", "net", "org", "example.org", "*.example.net", "!tionsh.example.net", "m.ththth.example.net")


@query(
    "WITH rules(key, makes, exception) AS (VALUES ('com', 1, false), ('net', 1, false), ('org', 1, false), ('example.org', 2, false), ('example.net', 3, false), ('tionsh.example.net', 2, true), ('m.ththth.example.net', 4, false)), "
    "host AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages), part AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM host), "
    "best AS (SELECT host, max(struct_pack(e := exception, m := makes)) AS b FROM (SELECT host, array_to_string(l[len(l) - s + 1 :], '.') AS key FROM part, range(1, 9) t(s) WHERE s <= len(l)) JOIN rules USING (key) GROUP BY host), "
    "made AS (SELECT host, l, coalesce(b.m, 1) AS m FROM part LEFT JOIN best USING (host)) "
    "SELECT page_id, host, array_to_string(l[greatest(len(l) - m + 1, 1) :], '.') AS public_suffix, CASE WHEN len(l) > m THEN array_to_string(l[len(l) - m :], '.') END AS registered_domain FROM host JOIN made USING (host)"
)
def registered_domains(spark, sf_dir):
    """Each page's public suffix and registered domain by suffix rules."""
    rows = table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    return suffixes.with_registered_domain(rows, suffixes.rules(spark, SUFFIX_RULES))


@query(
    "WITH made AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, lower(regexp_extract(url, '([^./]+[.](com|net|org))([/?#:]|$)', 1)) AS domain FROM pages), keyed AS (SELECT page_id, CASE WHEN domain LIKE '%.org' THEN host ELSE domain END AS shard_key FROM made) "
    "SELECT page_id, shard_key, (list_reduce(list_transform(range(0, strlen(shard_key)), lambda i: ('0x' || substr(hex(encode(shard_key)), (2 * i + 1)::BIGINT, 2))::HUGEINT), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616, 14695981039346656037::HUGEINT) % 5)::BIGINT AS shard FROM keyed"
)
def domain_shards(spark, sf_dir):
    """Each page's shard by registered domain, where every name under org is a suffix: those hosts follow themselves."""
    rows = table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    found = suffixes.with_registered_domain(rows, suffixes.rules(spark, ("com", "net", "*.org", "*.example.org", "*.m.example.org", "*.blog.example.org")))
    own = F.when(~F.col("host").endswith(".org"), F.col("registered_domain"))
    return found.select("page_id", suffixes.shard_key(F.col("host"), own).alias("shard_key"), suffixes.shard(F.col("host"), own, 5).cast("long").alias("shard"))
