"""Archives, text tables, verification and streams on small files that the tests write."""

from __future__ import annotations

import gzip
import io
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weftline.functions import html
from weftline.operators import bm25, capture_search, frontier
from weftline.plans import service, verify
from weftline.sources import archives, tables
from weftline.streaming import events, politeness


def warc_file(path, records):
    with open(path, "wb") as f:
        for headers, block in records:
            f.write(archives.member(headers, block))


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<html><title>T</title><p>Body</p></html>"


@pytest.fixture
def archive(tmp_path):
    folder = tmp_path / "a"
    folder.mkdir()
    wat = json.dumps({"Container": {"Filename": "w", "Offset": "12", "Gzip-Metadata": {"Deflate-Length": "34"}}, "Envelope": {"WARC-Header-Metadata": {"WARC-Target-URI": "<http://a/>"}, "Payload-Metadata": {"HTTP-Response-Metadata": {"Response-Message": {"Status": "200 OK"}, "Headers": {"content-TYPE": "text/html; x"}, "HTML-Metadata": {"Head": {"Title": "T", "Metas": [{"name": "n", "content": "c"}]}, "Links": [{"path": "A@/href", "url": "/1"}, {"path": "A@/href", "url": "/2"}]}}}}})
    records = [
        ({"WARC-Type": "warcinfo", "Content-Type": "application/warc-fields"}, b"software: x\r\n"),
        ({"WARC-Type": "response", "WARC-Target-URI": "<http://a/>", "WARC-Date": "2024-01-02T03:04:05Z"}, HTTP),
        ({"WARC-Type": "metadata", "WARC-Target-URI": "http://a/"}, wat.encode()),
        ({"WARC-Type": "metadata"}, b"not json"),
        ({"WARC-Type": "conversion", "WARC-Target-URI": "http://a/", "WARC-Identified-Content-Language": "eng"}, b"  Some text \n"),
        ({"WARC-Type": "conversion", "WARC-Target-URI": "http://b/"}, b"   "),
    ]
    warc_file(folder / "x.warc.gz", records)
    (folder / "y.warc.gz").write_bytes(gzip.compress(b"not a record") + archives.member(*records[1]) + b"\x00trash")
    return str(folder)


def test_warc(spark, archive):
    rows = archives.read_warc(spark, archive).orderBy("filename", "offset").collect()
    assert [r["type"] for r in rows] == ["warcinfo", "response", "metadata", "metadata", "conversion", "conversion", "response"]
    page = rows[1]
    assert (page["url"], page["http_status"], page["http_mime"], page["block"]) == ("http://a/", 200, "text/html", HTTP)
    assert page["date"] == datetime(2024, 1, 2, 3, 4, 5)
    with open(f"{archive}/x.warc.gz", "rb") as f:
        f.seek(page["offset"])
        assert HTTP in gzip.decompress(f.read(page["length"]))


def test_wat_wet_convert(spark, archive):
    records = archives.read_warc(spark, archive)
    wat = archives.wat(records).collect()
    assert [(r["url"], r["http_status"], r["content_type"], r["title"], r["links_count"], r["warc_offset"], r["warc_length"]) for r in wat] == [("http://a/", 200, "text/html", "T", 2, 12, 34)]
    assert [r["url"] for r in archives.flatten_links(archives.wat(records)).orderBy("url").collect()] == ["/1", "/2"]
    assert json.loads(archives.wat_row(archives.wat(records)).first()["metas"])[0]["name"] == "n"
    assert [(r["content_language"], r["text"]) for r in archives.wet(records).collect()] == [("eng", "Some text")]
    made = archives.convert(archives.archive_filter(records, content=True), html.extractor("raw")).collect()
    assert {(r["title"], r["markdown"]) for r in made} == {("T", "T \nBody")}
    found = archives.fetch(spark, archive, records.where("type = 'metadata'")).count()
    assert found == 2
    assert [archives.kind_of(n) for n in ("x.warc.wat.gz", "x.warc.wet.gz", "x.warc.gz")] == ["wat", "wet", "warc"]


def test_warc_writer(spark, tmp_path):
    archives.register(spark)
    rows = spark.range(40).select(F.concat(F.lit("http://h/"), F.col("id").cast("string")).alias("url"), F.lit("response").alias("type"), F.concat(F.lit(HTTP), F.encode(F.repeat(F.col("id").cast("string"), 500), "UTF-8")).alias("block"))
    out = str(tmp_path / "out")
    rows.coalesce(2).write.format("warc").option("path", out).option("max_bytes", 4000).mode("append").save()
    back = archives.read_warc(spark, out)
    assert back.where("type = 'response'").select("url", "block").exceptAll(rows.select("url", "block")).isEmpty() and back.where("type = 'response'").count() == 40
    files = back.select("filename").distinct().count()
    assert files > 2 and back.where("offset = 0 and type = 'warcinfo'").count() == files


def test_rank_and_graph_lines(spark):
    lines = spark.createDataFrame([(x,) for x in ("#h\tx", "1\t2.5\t3\t4.5\tcom.example\t7", "bad\t2\t3\t4\tcom.bad", "5 6.0 7 8.0 org.space", "short\t1")], "value string")
    assert [(r["harmonic_pos"], r["host_rev"]) for r in tables.ranks(lines).orderBy("host_rev").collect()] == [(None, "com.bad"), (1, "com.example"), (5, "org.space")]
    assert [tuple(r) for r in tables.domain_ranks(lines).collect()] == [("example.com", 1, 2.5, 3, 4.5, 7)]
    graph = spark.createDataFrame([("1\tcom.a",), ("x\tcom.b",), ("1\t2",), ("3",)], "value string")
    assert tables.vertices(graph).count() == 2 and [tuple(r) for r in tables.edges(graph).collect()] == [(1, 2)]


def test_text_sources(spark, tmp_path):
    (tmp_path / "m.paths.gz").write_bytes(gzip.compress(b"crawl=1/subset=warc/part-10.parquet\n\n crawl=1/subset=robotstxt/part-2.parquet \n"))
    paths = tables.manifest(spark, str(tmp_path / "m.paths.gz"))
    assert [r["part"] for r in tables.numeric_parts(paths).collect()] == [2, 10]
    assert tables.index_parts(paths, "warc").count() == 1
    with pytest.raises(ValueError):
        tables.index_parts(paths, "none")
    (tmp_path / "c.json").write_text('{"url": "http://a/", "timestamp": "2024"}\nnot json\n{"status": "200"}\n')
    assert [r["url"] for r in tables.capture_pages(spark, str(tmp_path / "c.json")).collect()] == ["http://a/"]
    docs = spark.createDataFrame([("http://a/", "t", "x", "", "fr"), ("", "t", "x", "en", "")], "url string, title string, text string, language string, content_language string")
    assert [r["language"] for r in tables.document_lines(docs).collect()] == ["fr"]
    for how in ("json", "csv", "tsv", "list", "url", "markdown", "raw"):
        assert tables.render(docs, how).count() == 2
    assert tables.render(spark.createDataFrame([('a"b', 1)], "x string, y int"), "csv").first()["value"] == '"a""b",1'


def test_verify(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "good"))
    good = next(str(p) for p in (tmp_path / "good").glob("*.parquet"))
    (tmp_path / "cut").write_bytes(b"PAR1 and no more of it")
    (tmp_path / "tiny").write_bytes(b"x")
    paths = spark.createDataFrame([(p,) for p in (good, str(tmp_path / "cut"), str(tmp_path / "tiny"), str(tmp_path / "none"))], "path string")
    found = verify.verify_shards(paths, {"id": "int64"})
    status = {r["path"]: r["status"] for r in found.collect()}
    assert list(status.values()).count("truncated") == 2 and status[str(tmp_path / "none")] == "missing" and status[good] == "ok"
    assert verify.verify_shards(paths.limit(1), {"id": "string"}).first()["status"] == "schema"
    total = verify.verify_totals(found, spark.createDataFrame([(good, 1 << 40)], "path string, rows long")).first()
    assert total["passed"] == 1 and total["failed"] == 3 and total["mismatched"] == 1
    scanned = verify.scan_library(spark, str(tmp_path / "good"))
    assert {r["status"] for r in verify.library_differences(scanned, scanned).collect()} == {"ok"}


def test_index_files_and_service(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bm25.write_index(docs, str(tmp_path / "i"), buckets=4)
    index, query = bm25.postings(docs), "thing und"
    stats = bm25.statistics(index).first()
    pruned = bm25.search(bm25.read_index(spark, str(tmp_path / "i"), query, 4), query, 10, stats["documents"], stats["mean_length"])
    assert pruned.collect() == bm25.search(index, query, 10).collect()
    assert bm25.read_statistics(spark, str(tmp_path / "i")) == stats
    records = spark.createDataFrame([("a.com", 2), ("b.org", 1), ("com", 3)], "host string, harmonic_pos int")
    api = service.Service(spark, records, index, docs.select("doc_id", "lang"))
    assert [r["host"] for r in api.hosts(5, "com").collect()] == ["a.com", "com"]
    assert api.host("B.org").count() == 1 and api.search(query, 1000).count() <= 100 and api.health().first()["search"]
    with pytest.raises(service.Unavailable):
        service.Service(spark).host("x")


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    for name, f in {"tumbling": lambda d: events.tumbling(d, "1 hour", ["event_type"], delay="3650 days"), "sliding": lambda d: events.sliding(d, "2 hours", "1 hour", ["event_type"], delay="3650 days")}.items():
        stream = events.read_stream(spark, str(tmp_path / "in"), rows.schema)
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        batch = f(rows.withColumn("ts", F.col("ts").cast("timestamp"))).select("start", "event_type", "n")
        assert spark.table(name).select("start", "event_type", "n").exceptAll(batch).isEmpty() and spark.table(name).count() == batch.count()


def test_first_seen_stream_publishes_once(spark, tmp_path):
    spark.createDataFrame([(f"u{i % 7}",) for i in range(50)], "url string").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = events.read_stream(spark, str(tmp_path / "in"), "url string")
    events.publish(events.first_seen(stream), str(tmp_path / "out"), str(tmp_path / "cp"), ["url"]).awaitTermination(120)
    events.publish(events.first_seen(events.read_stream(spark, str(tmp_path / "in"), "url string")), str(tmp_path / "out"), str(tmp_path / "cp"), ["url"]).awaitTermination(120)
    assert sorted(r["url"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [f"u{i}" for i in range(7)]


def test_frontier_tables(spark):
    empty = spark.createDataFrame([], "url string, host string, priority double, depth int, retries int, next_at long, state int")
    found = spark.createDataFrame([("http://a/1", 1.0, 0, 0), ("http://a/2", 2.0, 0, 0), ("http://b/", 0.5, 0, 0), ("http://a/1", 0.1, 1, 0)], "url string, priority double, depth int, next_at long")
    front = frontier.admit(empty, found)
    assert front.count() == 3 and frontier.admit(front, found).count() == 3
    hosts = spark.createDataFrame([], "host string, next_at long")
    claimed = frontier.claim(front, hosts, 10, 5)
    assert [r["url"] for r in claimed.collect()] == ["http://a/2", "http://b/"]
    clocks = frontier.hold(hosts, claimed, 10, 5)
    assert frontier.claim(front, clocks, 12, 5).isEmpty()
    outcome = spark.createDataFrame([("http://a/2", False), ("http://b/", True)], "url string, ok boolean")
    state = {r["url"]: (r["state"], r["retries"], r["next_at"]) for r in frontier.settle(front, outcome, 20, 4, 1).collect()}
    assert state == {"http://a/1": (0, 0, 0), "http://a/2": (0, 1, 24), "http://b/": (2, 0, 0)}


def test_politeness_stream(spark, tmp_path):
    """Each host's URLs are claimed once each, best first, no two closer than the delay."""
    rng = random.Random(9)
    rows = [(f"h{i % 3}", f"http://h{i % 3}/{i // 2}", float(rng.randint(1, 9)), "found") for i in range(18)]
    spark.createDataFrame(rows, "host string, url string, priority double, kind string").coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("host string, url string, priority double, kind string").parquet(str(tmp_path / "in"))
    q = politeness.schedule(stream, delay_ms=300).writeStream.format("memory").queryName("claims").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    wanted = len({r[1] for r in rows})
    try:
        for _ in range(240):
            if spark.table("claims").count() >= wanted:
                break
            q.awaitTermination(1) if q.isActive else None
            assert q.exception() is None
    finally:
        q.stop()
    claims = spark.table("claims").orderBy("claimed_at").collect()
    assert sorted(c["url"] for c in claims) == sorted({r[1] for r in rows})
    for host in {c["host"] for c in claims}:
        own = [c for c in claims if c["host"] == host]
        assert all(b["claimed_at"] - a["claimed_at"] >= 300 for a, b in zip(own, own[1:], strict=False))
        assert [c["priority"] for c in own] == sorted((c["priority"] for c in own), reverse=True)


def test_patterns(spark):
    assert capture_search.pattern("*.a.com") == ("a.com", "domain") and capture_search.pattern("a.com/x*") == ("a.com/x", "prefix")
    rows = spark.createDataFrame([(u,) for u in ("http://a.com/", "https://b.a.com/x", "http://aa.com/", "http://a.com/x/y")], "url string")
    count = lambda spec, how=None: rows.where(capture_search.matches(F.col("url"), spec, how)).count()
    assert (count("*.a.com"), count("a.com/*"), count("a.com"), count("http://a.com/x", "host")) == (3, 2, 1, 2)


def test_damage_inside_a_member_is_an_error():
    """Only what follows the last member is passed over."""
    one = archives.member({"WARC-Type": "resource"}, b"x" * 500)
    assert [(at, n) for at, n, _ in archives.members(io.BytesIO(one + one + b"\x00trash"), size=7)] == [(0, len(one)), (len(one), len(one))]
    broken = one[:30] + bytes(255 - b for b in one[30:])
    for data in (one + one[:-9], one + broken + one):
        with pytest.raises(ValueError, match=f"byte {len(one)}"):
            list(archives.members(io.BytesIO(data)))


def test_places_are_joined():
    places = [("a", 0, 10), ("a", 0, 10), ("a", 12, 5), ("a", 30, 5), ("a", 36, 20), ("b", 37, 1)]
    assert [*archives.joined(iter(places), gap=3, most=20)] == [[("a", 0, 10), ("a", 12, 5)], [("a", 30, 5)], [("a", 36, 20)], [("b", 37, 1)]]
