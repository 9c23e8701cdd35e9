"""Queries over the columnar URL index."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators.index_query import IndexQuery, schema_of
from weftline.queries.registry import query
from weftline.session import once, table
from weftline.sources import captures, tables

HOSTS = ["tionsh.example.net", "m.ththth.example.net", "ththin.example.com", "nobody.example.com"]


def index(spark, sf_dir, crawl="A", subset=None):
    """The captures of the pages, from an index on disk that holds two crawls; it is written when an application first asks for it."""

    def write(path):
        pages = table(spark, sf_dir, "pages")
        both = captures.from_pages(pages, "A").unionByName(captures.from_pages(pages, "B"))
        captures.write_index(captures.with_subset(both), path)

    return captures.read_index(spark, once(spark, "index", sf_dir, write), crawl, subset)


COLUMNS = "url, fetch_time, fetch_status, content_mime_detected, content_languages, warc_filename, warc_record_offset, warc_record_length"


@query(captures.SQL + "SELECT url_host_name AS host, count(*) AS captures, count(*) FILTER (WHERE fetch_status = 200) AS ok, count(*) FILTER (WHERE content_mime_detected = 'text/html') AS html FROM captures WHERE url_host_registered_domain = 'example.com' GROUP BY 1")
def captures_by_host(spark, sf_dir):
    """Captures of one domain by host, most first."""
    rows = IndexQuery(domain="example.com").rows(index(spark, sf_dir))
    ok, html = F.col("fetch_status") == 200, F.col("content_mime_detected") == "text/html"
    found = rows.groupBy(F.col("url_host_name").alias("host")).agg(F.count("*").alias("captures"), F.count_if(ok).alias("ok"), F.count_if(html).alias("html"))
    return found.orderBy(F.desc("captures"), "host")


@query(captures.SQL + "SELECT count(*) AS n FROM captures WHERE url_host_tld = 'org'")
def index_count_tld(spark, sf_dir):
    return IndexQuery(tld="org").count(index(spark, sf_dir))


@query(captures.SQL + "SELECT count(*) AS n FROM captures")
def index_count_all(spark, sf_dir):
    return IndexQuery().count(index(spark, sf_dir))


@query(captures.SQL + f"SELECT {COLUMNS} FROM captures WHERE url_host_registered_domain = 'example.org' AND fetch_status = 200 AND content_mime_detected = 'text/html'")
def index_urls(spark, sf_dir):
    return IndexQuery(domain="example.org", status=200, mime="text/html").urls(index(spark, sf_dir))


@query(captures.SQL + f"SELECT {COLUMNS} FROM captures WHERE url_host_tld = 'com' ORDER BY url_surtkey, url, fetch_time, warc_record_offset LIMIT 20")
def index_urls_limit(spark, sf_dir):
    return IndexQuery(tld="com", limit=20).urls(index(spark, sf_dir))


@query(captures.SQL + "SELECT warc_filename AS filename, warc_record_offset AS \"offset\", warc_record_length AS length, url FROM captures WHERE url_host_name = 'ththin.example.com'")
def index_locations(spark, sf_dir):
    return IndexQuery(host="ththin.example.com").locations(index(spark, sf_dir))


@query(captures.SQL + "SELECT content_languages AS value, count(*) AS n FROM captures GROUP BY 1")
def index_languages(spark, sf_dir):
    return IndexQuery().languages(index(spark, sf_dir))


@query(captures.SQL + "SELECT content_mime_detected AS value, count(*) AS n FROM captures WHERE fetch_status = 200 GROUP BY 1 ORDER BY n DESC, value LIMIT 2")
def index_mimes_top(spark, sf_dir):
    return IndexQuery(status=200, limit=2).mimes(index(spark, sf_dir))


@query(captures.SQL + "SELECT page_id, url, content_languages FROM captures WHERE (content_languages IS NULL OR NOT contains(content_languages, 'en')) AND (fetch_status IS NULL OR fetch_status <> 404) AND (content_mime_detected IS NULL OR content_mime_detected <> 'application/pdf')")
def index_negated(spark, sf_dir):
    """Negated filters let null pass."""
    q = IndexQuery(not_language="en", not_status=404, not_mime="application/pdf")
    return q.rows(index(spark, sf_dir)).select("page_id", "url", "content_languages")


@query(captures.SQL + "SELECT page_id, url FROM captures WHERE contains(content_languages, 'e') AND starts_with(url_path, '/en/1')")
def index_substring_prefix(spark, sf_dir):
    return IndexQuery(language="e", path_prefix="/en/1").rows(index(spark, sf_dir)).select("page_id", "url")


@query(captures.SQL + f"SELECT page_id, url FROM captures WHERE url_host_name IN ({', '.join(repr(h) for h in HOSTS)})")
def index_host_set(spark, sf_dir):
    return IndexQuery(hosts=HOSTS).rows(index(spark, sf_dir)).select("page_id", "url")


@query(captures.SQL + "SELECT page_id, url FROM captures WHERE url_host_registered_domain IN ('example.com', 'example.net')")
def index_domain_set_joined(spark, sf_dir):
    """A set too long to list becomes a semi join; most of its domains match nothing."""
    domains = ["example.com", "example.net"] + [f"none{i}.org" for i in range(1500)]
    return IndexQuery(domains=domains).rows(index(spark, sf_dir)).select("page_id", "url")


@query(captures.SQL + f"SELECT {COLUMNS} FROM captures WHERE url_host_registered_domain = 'example.com' AND fetch_status <> 404 AND NOT contains(content_languages, 'fr')" + " OR (url_host_registered_domain = 'example.com' AND fetch_status <> 404 AND content_languages IS NULL)")
def index_rendered_sql(spark, sf_dir):
    """The rendered SQL, run over a view."""
    q = IndexQuery(domain="example.com", not_status=404, not_language="fr")
    return tables.passthrough(spark, q.sql(), ccindex=index(spark, sf_dir))


@query(
    """SELECT * FROM (VALUES (0, 'page_id', 'BIGINT'), (1, 'crawl', 'VARCHAR'), (2, 'url_surtkey', 'VARCHAR'), (3, 'url', 'VARCHAR'), (4, 'url_host_name', 'VARCHAR'), (5, 'url_host_tld', 'VARCHAR'),
    (6, 'url_host_registered_domain', 'VARCHAR'), (7, 'url_path', 'VARCHAR'), (8, 'url_protocol', 'VARCHAR'), (9, 'fetch_redirect', 'VARCHAR'), (10, 'content_mime_type', 'VARCHAR'), (11, 'content_charset', 'VARCHAR'),
    (12, 'content_truncated', 'VARCHAR'), (13, 'fetch_status', 'INTEGER'), (14, 'content_mime_detected', 'VARCHAR'), (15, 'content_languages', 'VARCHAR'), (16, 'content_digest', 'VARCHAR'),
    (17, 'timestamp', 'VARCHAR'), (18, 'fetch_time', 'TIMESTAMP'), (19, 'warc_filename', 'VARCHAR'), (20, 'warc_record_offset', 'BIGINT'), (21, 'warc_record_length', 'BIGINT')) t(position, column_name, column_type)"""
)
def index_schema(spark, sf_dir):
    return schema_of(captures.from_pages(table(spark, sf_dir, "pages")))


@query(captures.SQL + f"SELECT {', '.join(captures.URL_COLUMNS)} FROM captures")
def index_republished(spark, sf_dir):
    """The eighteen columns that a republished index keeps."""
    return index(spark, sf_dir).select(*captures.URL_COLUMNS)


@query(captures.SQL + "SELECT url_host_name AS host, count(*) AS n, min(url_surtkey) AS first_key FROM captures_b WHERE fetch_status = 200 AND url_host_registered_domain = 'example.net' GROUP BY 1")
def index_second_crawl(spark, sf_dir):
    """One domain's successful captures in one crawl: partitions and a sort-key prefix are pruned."""
    rows = IndexQuery(domain="example.net").rows(index(spark, sf_dir, "B", "warc"))
    return rows.groupBy(F.col("url_host_name").alias("host")).agg(F.count("*").alias("n"), F.min("url_surtkey").alias("first_key"))


@query(captures.SQL + "SELECT crawl, CASE WHEN fetch_status = 200 THEN 'warc' ELSE 'crawldiagnostics' END AS subset, count(*) AS n, count(DISTINCT url_surtkey) AS keys FROM (SELECT crawl, fetch_status, url_surtkey FROM captures UNION ALL SELECT crawl, fetch_status, url_surtkey FROM captures_b) GROUP BY ALL")
def index_subsets(spark, sf_dir):
    """Captures and different keys of each crawl and subset of the index."""
    return index(spark, sf_dir, None).groupBy("crawl", "subset").agg(F.count("*").alias("n"), F.count_distinct("url_surtkey").alias("keys"))


@query(captures.SQL + "SELECT page_id, url, content_digest FROM captures WHERE content_digest IN (SELECT max(content_digest) FROM captures)")
def index_by_digest(spark, sf_dir):
    """The captures of one payload: an equality that only Bloom filters can serve."""
    rows = index(spark, sf_dir)
    wanted = rows.agg(F.max("content_digest")).first()[0]
    return rows.where(F.col("content_digest") == wanted).select("page_id", "url", "content_digest")
