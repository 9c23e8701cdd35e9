"""robots.txt: groups and matching after RFC 9309, and the cache as state with a clock that moves."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_frontier_stream import Map, Value
from weftline.functions import robots
from weftline.streaming import robots_cache

FILES = {
    # groups that name an agent again go on; the longest token wins; comments, blanks, and fields in any case
    "merged": ("User-agent: weft\nDisallow: /a/\n\nuser-agent: other\nDisallow: /\n\nUSER-AGENT: Weft # again\nDisallow: /b/\nCrawl-delay: 3", {"/a/x": False, "/b/x": False, "/c": True}),
    "longest token": ("User-agent: *\nDisallow: /\nUser-agent: we\nDisallow: /we\nUser-agent: weft\nDisallow: /weft\nUser-agent: weft-images\nDisallow: /", {"/we": True, "/weft/x": False, "/": True}),
    "several agents": ("User-agent: a\nUser-agent: weft\nSitemap: http://s/\nDisallow: /x\nUser-agent: b\nDisallow: /", {"/x": False, "/y": True}),
    "star and dollar": ("User-agent: *\nDisallow: /*.php$\nDisallow: /p*/q\nAllow: /p1/q", {"/a.php": False, "/a.php?x": True, "/p2/x/q": False, "/p1/q": True, "/.php": False}),
    "escapes": ("User-agent: *\nDisallow: /%7Ejoe/\nDisallow: /é\nDisallow: /a%2fb", {"/~joe/x": True, "/%7ejoe/x": False, "/%C3%A9": False, "/a%2Fb": False, "/a/b": True}),
    "longest rule": ("User-agent: *\nDisallow: /\nAllow: /public\nDisallow: /public/not", {"/": False, "/public": True, "/public/not": False, "/public/no": True}),
    "allow wins ties": ("User-agent: *\nDisallow: /a\nAllow: /a", {"/a": True}),
    "empty rule": ("User-agent: *\nDisallow:", {"/": True}),
    "no group": ("Disallow: /", {"/": True}),
    "old line ends": ("User-agent: *\rDisallow: /x\rAllow: /x/y", {"/x": False, "/x/y": True}),
    "mark": ("﻿User-agent: *\nDisallow: /", {"/": False}),
    "odd spelling": ("useragent : weft\ndisallow : /x", {"/x": False}),
    "dollar inside": ("User-agent: *\nDisallow: /a$b", {"/a$b": False, "/a": True}),
    "signs": ("User-agent: *\nDisallow: /a.b\nDisallow: /c+(d)", {"/axb": True, "/a.b": False, "/c+(d)": False, "/cc(d)": True}),
}


@pytest.mark.parametrize("name", FILES)
def test_files(name):
    body, paths = FILES[name]
    entry = robots.parse(body, "Weft/2.0 (+http://x)")
    assert {p: robots.allowed(entry["rules"], p) for p in paths} == paths


def test_delays_and_sitemaps():
    entry = robots.parse("Sitemap: http://a/1\nUser-agent: weft\nCrawl-delay: 2\nSitemap: http://a/2\nUser-agent: weft\nCrawl-delay: 0.5\nCrawl-delay: -1\nCrawl-delay: soon", "weft")
    assert (entry["delay"], entry["sitemaps"], entry["rules"]) == (2.0, ["http://a/1", "http://a/2"], [])
    assert robots.parse(None, "weft") == {"rules": [], "delay": None, "sitemaps": []}


def test_decide_on_stars_and_escapes(spark):
    """Rules with stars, ends and escapes through the table operator; a host with many URLs; columns named as the operator's."""
    files = spark.createDataFrame([(h, 200, FILES[n][0]) for h, n in (("a", "star and dollar"), ("b", "escapes"))] + [("c", 500, None), ("d", 404, "User-agent: *\nDisallow: /")], "host string, status int, body string")
    pages = spark.createDataFrame([(h, p, w) for h, n in (("a", "star and dollar"), ("b", "escapes")) for p, w in FILES[n][1].items()] + [("c", "/", False), ("d", "/", True), ("e", None, True), (None, "/", True)], "host string, path string, status boolean")
    many = pages.unionByName(spark.range(2000).select(F.lit("a").alias("host"), F.concat(F.lit("/"), F.col("id").cast("string"), F.lit(".php")).alias("path"), F.lit(False).alias("status")))
    found = robots.decide(many, files, "weft").collect()
    assert len(found) == many.count() and all(r["allowed"] == r["status"] for r in found)


class Cache:
    """One host's cache in memory."""

    def __init__(self, **how):
        self.now, self.timers = 1, []
        self.own = robots_cache.RobotsCache("weft", **how)
        self.own.init(self)

    def getMapState(self, name, key, value, ttl=None):  # noqa: N802
        return Map([])

    def getValueState(self, name, kind):  # noqa: N802
        return Value([])

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now

    def tell(self, *rows):
        frame = pd.DataFrame([r + (None,) * (6 - len(r)) for r in rows], columns=["kind", "url", "path", "status", "body", "cache_control"])
        return [(r["kind"], r["url"], r["allowed"]) for out in self.own.handleInputRows(("h",), iter([frame]), self) for r in out.astype(object).where(out.notna(), None).to_dict("records")]

    def ring(self):
        return [r["kind"] for out in self.own.handleExpiredTimer(("h",), self, None) for r in out.to_dict("records")]


def url(path):
    return ("url", f"http://h{path}", path)


def answer(status, body=None, header=None):
    return ("answer", None, None, status, body, header)


RULES = "User-agent: *\nDisallow: /x"


def test_one_request_is_out_and_its_answer_releases_all():
    cache = Cache()
    assert cache.tell(url("/x"), url("/y")) == [("fetch", None, None)]
    assert cache.tell(url("/z")) == []
    assert cache.tell(url("/x/2"), answer(200, RULES)) == [("verdict", "http://h/x", False), ("verdict", "http://h/y", True), ("verdict", "http://h/z", True), ("verdict", "http://h/x/2", False)]
    assert not cache.own.waiting and cache.tell(url("/x")) == [("verdict", "http://h/x", False)]


@pytest.mark.parametrize("status,header,first,lasts", [(200, None, False, robots_cache.DAY), (200, "public, max-age=3600", False, 3_600_000), (200, "max-age=1", False, robots_cache.LEAST), (200, "max-age=99999999", False, robots_cache.DAY), (200, "no-store", False, robots_cache.LEAST), (200, "max-age=x", False, robots_cache.DAY), (404, None, True, robots_cache.DAY), (301, None, True, robots_cache.DAY), (503, None, False, robots_cache.ERROR), (None, None, False, robots_cache.ERROR)])
def test_lifetimes(status, header, first, lasts):
    cache = Cache()
    cache.tell(url("/x"))
    assert cache.tell(answer(status, RULES, header)) == [("verdict", "http://h/x", first)]
    cache.now += lasts - 1
    assert cache.tell(url("/x")) == [("verdict", "http://h/x", first)]
    cache.now += 1
    assert cache.tell(url("/x")) == [("fetch", None, None)]
    assert cache.tell(answer(200, "")) == [("verdict", "http://h/x", True)]


def test_a_lost_request_is_made_again():
    cache = Cache(patience_ms=100)
    cache.tell(url("/y"))
    cache.now += 50
    assert cache.ring() == []
    cache.now += 50
    assert cache.ring() == ["fetch"] and cache.ring() == []
    cache.tell(answer(200))
    cache.now += 1000
    assert cache.ring() == []


def test_stream(spark, tmp_path):
    """Two hosts through a real stream: fetches first, verdicts once the answers have come."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [[("a", *url("/x"), None, None, None), ("b", *url("/x"), None, None, None), ("a", *url("/y"), None, None, None)], [("a", *answer(200, RULES)), ("b", *answer(503)), ("a", "odd", None, None, None, None, None)]]
    for k, some in enumerate(rows):
        spark.createDataFrame(some, robots_cache.INPUT).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(robots_cache.INPUT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = robots_cache.verdicts(stream, "weft").writeStream.format("memory").queryName("said").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for _ in range(150):  # timers keep such a query busy, so it is never said to be through
            if spark.table("said").where("kind = 'verdict'").count() >= 3:
                break
            query.awaitTermination(1)
            assert query.exception() is None
    finally:
        query.stop()
    found = spark.table("said").collect()
    assert sorted((r["host"], r["url"], r["allowed"]) for r in found if r["kind"] == "verdict") == [("a", "http://h/x", False), ("a", "http://h/y", True), ("b", "http://h/x", False)]
    assert sorted(r["host"] for r in found if r["kind"] == "fetch") in (["a", "b"], [])
