"""The index on disk: how it is laid out, and what a filter doesn't read."""

from __future__ import annotations

import glob
from datetime import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weftline.operators.index_query import IndexQuery
from weftline.sources import captures

DOMAINS, PATHS = 60, 50


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    """60 domains of 50 pages, in two crawls, in several files of small row groups."""
    path = str(tmp_path_factory.mktemp("index") / "t")
    at = F.col("id") % (DOMAINS * PATHS)
    name = F.concat(F.lit("www.site"), F.lpad((at / PATHS).cast("int").cast("string"), 2, "0"), F.lit(".example"))
    rows = spark.range(2 * DOMAINS * PATHS).orderBy(F.rand(4)).select(
        F.when(F.col("id") < DOMAINS * PATHS, "2024").otherwise("2025").alias("crawl"),
        F.concat(F.lit("example,site"), F.substring(name, 9, 2), F.lit(",www)/"), at.cast("string")).alias("url_surtkey"),
        F.concat(F.lit("http://"), name, F.lit("/"), at.cast("string")).alias("url"),
        name.alias("url_host_name"),
        F.substring(name, 5, 100).alias("url_host_registered_domain"),
        F.lit("example").alias("url_host_tld"),
        F.when(at % 50 == 7, "/robots.txt").otherwise(F.concat(F.lit("/"), at.cast("string"))).alias("url_path"),
        F.when(at % 5 == 0, 404).otherwise(200).alias("fetch_status"),
        F.timestamp_seconds(at).alias("fetch_time"),
        F.sha2(at.cast("string"), 256).alias("content_digest"),
        F.lit("text/html").alias("content_mime_detected"),
        F.lit("eng").alias("content_languages"),
        F.lit("w").alias("warc_filename"),
        at.alias("warc_record_offset"),
        F.lit(1).cast("long").alias("warc_record_length"),
    )
    captures.write_index(captures.with_subset(rows), path, files=6, row_group_rows=200, page_rows=50)
    return path


def leaves(df):
    """The scans of a plan that has run."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    found = plan.collectLeaves()
    return [found.apply(i) for i in range(found.size())]


def read(df, metric="numOutputRows"):
    df.collect()
    return sum(x.metrics().apply(metric).value() for x in leaves(df) if x.metrics().contains(metric))


def test_layout(spark, base):
    """Partitions keep their names as strings; keys are in order inside files, and files of a partition don't overlap."""
    found = captures.read_index(spark, base)
    assert dict(found.dtypes)["crawl"] == "string"
    counts = {(r["crawl"], r["subset"]): r["n"] for r in found.groupBy("crawl", "subset").agg(F.count("*").alias("n")).collect()}
    assert counts == {(c, s): n for c in ("2024", "2025") for s, n in (("robotstxt", 60), ("warc", 2340), ("crawldiagnostics", 600))}
    for folder in glob.glob(f"{base}/crawl=*/subset=*"):
        spans = []
        for path in glob.glob(f"{folder}/*.parquet"):
            file = pq.ParquetFile(path)
            keys = file.read(["url_surtkey"]).column(0).to_pylist()
            assert keys == sorted(keys) and all(file.metadata.row_group(g).num_rows <= 200 for g in range(file.num_row_groups))
            spans.append((keys[0], keys[-1]))
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_partitions_and_filters_reach_the_scan(spark, base):
    q = IndexQuery(domain="site07.example", status=200)
    df = q.urls(captures.read_index(spark, base, "2025", "warc"))
    (scan,) = leaves(df)
    assert "crawl" in str(scan.metadata().apply("PartitionFilters")) and "subset" in str(scan.metadata().apply("PartitionFilters"))
    pushed = str(scan.metadata().apply("PushedFilters"))
    assert "StringStartsWith(url_surtkey,example,site07" in pushed and "EqualTo(fetch_status,200)" in pushed
    assert "content_digest" not in str(scan.metadata().apply("ReadSchema"))
    assert df.count() == 39


def test_one_domain_reads_a_tenth(spark, base):
    """Rows that leave the scan, before any filter runs: those of the row groups and pages that bounds can't rule out."""
    index = captures.read_index(spark, base, "2024", "warc")
    whole = read(index.select("url"))
    one = read(IndexQuery(domain="site07.example").rows(index).select("url"))
    assert whole == 2340 and 39 <= one <= whole / 10
    assert read(IndexQuery(hosts=[f"www.site{i:02}.example" for i in (3, 41)]).rows(index).select("url")) <= whole / 5
    assert read(IndexQuery(domain="nosuch.example").rows(index).select("url")) <= 200


def test_bytes_fall_with_the_row_groups(base):
    """The same decision from the footers: bytes of the row groups whose bounds meet one domain's prefix."""
    total = kept = 0
    for path in glob.glob(f"{base}/crawl=2024/subset=warc/*.parquet"):
        meta = pq.ParquetFile(path).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            key = next(group.column(c) for c in range(group.num_columns) if group.column(c).path_in_schema == "url_surtkey")
            total += group.total_byte_size
            if key.statistics.max >= "example,site07," and key.statistics.min < "example,site07-":
                kept += group.total_byte_size
    assert kept and kept * 5 <= total


def test_bloom_filters_skip_what_isnt_there(spark, base):
    index = captures.read_index(spark, base, "2024")
    assert read(index.where(F.col("content_digest") == "0" * 64).select("url")) == 0
    wanted = index.where("warc_record_offset = 77").first()["content_digest"]
    assert read(index.where(F.col("content_digest") == wanted).select("url")) <= 400


def test_edges(spark, base, tmp_path):
    """Null keys, one URL captured very often, clashing extra columns, an empty table, and a base that exists."""
    at = datetime(2024, 1, 1)
    rows = [("7", "warc", None, None, at, "x"), *[("7", "warc", "com,a)/", "http://a.com/", at, str(k)) for k in range(500)]]
    schema = "crawl string, subset string, url_surtkey string, url string, fetch_time timestamp, bucket string"
    path = str(tmp_path / "i")
    captures.write_index(spark.createDataFrame(rows, schema), path, files=3)
    found = captures.read_index(spark, path, "7")
    assert found.count() == 501 and found.where("url_surtkey IS NULL").count() == 1 and found.select("bucket").distinct().count() == 501
    captures.write_index(spark.createDataFrame([], schema), str(tmp_path / "e"))
    with pytest.raises(Exception, match="(?i)exists"):
        captures.write_index(spark.createDataFrame(rows, schema), path)
