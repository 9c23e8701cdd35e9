"""Scalar functions against vectors and plain Python."""

from __future__ import annotations

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from weftline.functions import hashes, html, ranking, robots, text, urls
from weftline.operators import dedup, ranges
from weftline.operators.components import components
from weftline.operators.index_query import IndexQuery, sort_key_prefixes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def fnv(data: bytes, basis: int, prime: int, bits: int) -> int:
    for b in data:
        basis = (basis ^ b) * prime % (1 << bits)
    return basis


def test_fnv_vectors(spark):
    assert one(spark, hashes.fnv64_hex(F.lit("a"))) == "af63dc4c8601ec8c"
    for s in ("", "foobar", "http://é.example/ß?q=日本"):
        want = fnv(s.encode(), 0xCBF29CE484222325, 0x100000001B3, 64)
        assert one(spark, hashes.fnv64_hex(F.lit(s))) == f"{want:016x}"
        assert one(spark, hashes.fnv64_signed(F.lit(s))) % (1 << 64) == want
        assert one(spark, hashes.shard(F.lit(s), 7)) == want % 7
        assert one(spark, hashes.fnv32(F.lit(s))) == fnv(s.encode(), 0x811C9DC5, 0x01000193, 32)
    assert dedup.fnv64_all([b"", b"a", b"foobar"]).tolist() == [fnv(x, 0xCBF29CE484222325, 0x100000001B3, 64) for x in (b"", b"a", b"foobar")]


@pytest.mark.parametrize(("host", "shard"), [("example.com", 2), ("news.ycombinator.com", 0), ("en.wikipedia.org", 2), ("bbc.co.uk", 0), ("golang.org", 0)])
def test_shard_vectors(spark, host, shard):
    assert one(spark, hashes.shard(urls.registered_domain(F.lit(host)), 3)) == shard


@pytest.mark.parametrize(
    ("url", "surt"),
    [
        ("https://www.Example.com/A/B?q=X", "com,example)/a/b?q=X"),
        ("example.com", "com,example)/"),
        ("http://a.b.co.uk:8080/#x", "uk,co,b,a)/"),
        ("", ""),
    ],
)
def test_surt(spark, url, surt):
    assert one(spark, urls.surt(F.lit(url))) == surt


def test_normalize(spark):
    assert one(spark, urls.normalize_url(F.lit("HTTP://Example.COM:80/A?utm_source=x&b=1&ref=y&c#frag"))) == "http://example.com/A?b=1&c"
    assert one(spark, urls.normalize_url(F.lit("https://example.com:443/?utm_source=x"))) == "https://example.com/"
    assert one(spark, urls.canonical_url(F.lit("Example.com/A#f"))) == "http://example.com/A"
    assert one(spark, urls.registered_domain(F.lit("a.b.co.uk"))) == "b.co.uk"
    assert one(spark, urls.registered_domain(F.lit("co.uk"))) == ""


def test_sort_key_prefixes():
    assert sort_key_prefixes(["Example.com."], True) == ["com,example)", "com,example,"]
    assert sort_key_prefixes(["a.com", ""], True) == []
    assert sort_key_prefixes([f"h{i}.example.com" for i in range(100)], False) == ["com,example,h"]
    assert sort_key_prefixes([f"{c}{d}.{c}" for c in "abcdefgh" for d in "abcdefghi"], False) == []


def test_pushed_filters(spark, tmp_path):
    rows = spark.createDataFrame([("com,example)/", "example.com", "text/html", 200, "http://example.com/", "/")], "url_surtkey string, url_host_registered_domain string, content_mime_detected string, fetch_status int, url string, url_path string")
    rows.write.parquet(str(tmp_path / "i"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = IndexQuery(domain="example.com", status=200).rows(spark.read.parquet(str(tmp_path / "i")))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(url_surtkey,com,example" in plan and "EqualTo(fetch_status,200)" in plan


def test_loose_timestamp():
    assert text.loose_timestamp("2024", False) == "20240000000000"
    assert text.loose_timestamp("2024", True) == "20241231235959"
    assert text.loose_timestamp("2024-06-15", True) == "20240615235959"
    assert text.loose_timestamp("x", True) == ""
    assert text.loose_timestamp("20240615123456789", True) == "20240615123456"


def test_error_fingerprint(spark):
    said = 'Get "https://a.example/x": dial tcp 10.0.0.1:443: i/o timeout'
    assert one(spark, text.error_fingerprint(F.lit(said))) == "dial tcp N i/o timeout"
    long = one(spark, text.error_fingerprint(F.lit("word " * 60)))
    assert long.endswith(" ...") and len(long) <= 124


def test_tiers(spark):
    tier = lambda p, r: one(spark, ranking.crawl_tier(F.lit(p).cast("long"), F.lit(r)))
    assert [tier(1, 0.9), tier(1, 0.8), tier(10**6, 0.5), tier(5 * 10**6, 0.2), tier(10**7, 0.0), tier(10**8, 0.9)] == [1, 2, 2, 3, 4, 5]
    assert [tier(None, 0.9), tier(0, 0.3), tier(-1, 0.1)] == [3, 4, 5]


def simhash_slowly(words: list[str]) -> int:
    runs = {" ".join(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else set(words)
    votes = [0] * 64
    for h in {fnv(r.encode(), 0xCBF29CE484222325, 0x100000001B3, 64) for r in runs}:
        for i in range(64):
            votes[i] += 1 if h >> i & 1 else -1
    return sum(1 << i for i in range(64) if votes[i] > 0)


def test_simhash(spark):
    rng = random.Random(5)
    words = ["the", "Quick", "brown", "fox", "été", "9lives", "x"]
    docs = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(60)] + ["", "one", "-- !!"]
    rows = spark.createDataFrame([*enumerate(docs), (99, None)], "id int, text string")
    found = {r["id"]: r["simhash"] for r in dedup.simhash(rows, "id", "text").collect()}
    for i, d in enumerate(docs):
        own = [w for w in "".join(c if c.isalnum() else " " for c in d).lower().split()]
        assert found[i] % (1 << 64) == simhash_slowly(own), d
    assert found[99] == 0


def test_near_clusters(spark):
    rng = random.Random(6)
    base = rng.getrandbits(64)
    prints = [base, base ^ 1, base ^ 3, base ^ 0b111000, rng.getrandbits(64), rng.getrandbits(64)] + [rng.getrandbits(64) for _ in range(30)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows = spark.createDataFrame([(i, p, 1000) for i, p in enumerate(signed)], "id long, simhash long, bytes int")
    near = {(i, j) for i, j in combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3}
    pairs = {(r["a"], r["b"]) for r in dedup.near_pairs(rows).collect()}
    assert pairs <= near and {x for p in pairs for x in p} == {0, 1, 2, 3} and len(pairs) >= 3
    assert len(dedup.band_masks(3)) == 20
    lengths = rows.withColumn("bytes", F.when(F.col("id") == 3, 5000).otherwise(F.col("bytes")))
    assert {x for r in dedup.near_pairs(lengths).collect() for x in r} == {0, 1, 2}
    clusters = dedup.near_clusters(rows).collect()
    assert [(r["root"], r["size"]) for r in clusters] == [(0, 4)]


def test_crowded_buckets_are_dealt_again(spark):
    """Links equal those of all pairs whatever a bucket holds, over equal fingerprints of many lengths too."""
    rng = random.Random(8)
    rows = []
    for _ in range(4):
        base = rng.getrandbits(64)
        for _ in range(40):
            flipped = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
            rows.append((len(rows), base ^ flipped, rng.choice([600, 1000, 1500, 4000, 9000])))
    near = [(i, j) for (i, p, m), (j, q, n) in combinations(rows, 2) if (p ^ q).bit_count() <= 3 and min(m, n) >= 0.5 * max(m, n)]
    made = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p, n) for i, p, n in rows], "id long, simhash long, bytes int")

    def groups(pairs):
        root = list(range(len(rows)))
        for a, b in pairs:
            a, b = root[a], root[b]
            root = [min(a, b) if r in (a, b) else r for r in root]
        return root

    for block in (4096, 8):
        assert groups([(r["a"], r["b"]) for r in dedup.near_pairs(made, block=block).collect()]) == groups(near)


def test_components_are_exact(spark):
    rng = random.Random(7)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    parent: dict[int, int] = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).isEmpty()


def test_robots():
    body = "User-agent: *\nDisallow: /private\nAllow: /private/ok\nDisallow: /*.gif$\nCrawl-delay: 3\n\nUser-agent: weft\nUser-agent: other\nDisallow: /w # all\nSitemap: http://a/s.xml\nDisallow:\n"
    entry = robots.parse(body, "nobody/1.0")
    assert entry["delay"] == 3.0 and entry["sitemaps"] == ["http://a/s.xml"]
    checks = {"/": True, "": True, "/private/x": False, "/private/ok/1": True, "/a.gif": False, "/a.gif?x": True, "/%7euser": True}
    assert {p: robots.allowed(entry["rules"], p) for p in checks} == checks
    own = robots.parse(body, "Weft/2.0")
    assert not robots.allowed(own["rules"], "/w/1") and robots.allowed(own["rules"], "/private/x")
    assert robots.allowed([{"allow": True, "pattern": "/a"}, {"allow": False, "pattern": "/a"}], "/ab")
    assert robots.normalise("/é%c3 x") == "/%C3%A9%C3%20x"


def test_robots_patterns_are_linear():
    """Against the definition by regular expressions, and with many stars."""
    rng = random.Random(12)
    for _ in range(5000):
        pattern, path = "".join(rng.choices("/ab*$", weights=[2, 3, 3, 3, 1], k=rng.randint(1, 7))), "/" + "".join(rng.choices("/ab", k=rng.randint(0, 8)))
        slow = re.compile(".*".join(map(re.escape, pattern.removesuffix("$").split("*"))), re.DOTALL)
        assert robots.matches(pattern, path) == bool((slow.fullmatch if pattern.endswith("$") else slow.match)(path)), (pattern, path)
    assert not robots.matches("/" + "*a" * 500 + "*b$", "/" + "a" * 5000)
    assert robots.normalise("/%7e%zz%C3") == "/%7E%25zz%C3"


def test_robots_by_host(spark):
    files = spark.createDataFrame([("a", 200, "User-agent: *\nDisallow: /x"), ("b", 503, None), ("c", 404, None)], "host string, status int, body string")
    pages = spark.createDataFrame([(h, p) for h in "abcd" for p in ("/x", "/y")], "host string, path string")
    found = {(r["host"], r["path"]): r["allowed"] for r in robots.decide(pages, files, "w").collect()}
    assert found == {("a", "/x"): False, ("a", "/y"): True, ("b", "/x"): False, ("b", "/y"): False, ("c", "/x"): True, ("c", "/y"): True, ("d", "/x"): True, ("d", "/y"): True}


PAGE = """<!DOCTYPE html><html lang="fr"><head><title> A  title </title><meta name="description" content="D"><link rel="canonical" href="http://c/"><meta property="og:url" content="http://o/"></head>
<body><nav><a href="/n">n</a></nav><script>var t = "</p>";</script><h1>Head</h1><p>One <b>bold</b> &amp; <a href="x.html" title="T">link <i>in</i></a><p>Two<ul><li>a<li>b</ul><a href="#f">f</a><a href="javascript:x()">j</a></body></html>"""


def test_malformed_html():
    """Marked sections, heads without an end and random markup: nothing raises, no text is lost."""
    assert html.parse_text("<p>a</p><![foo bar]]><p>b</p>").split() == ["a", "b"]
    page = "<html><head><title>x</title><body><p>Hello there</p><a href='/y'>z</a>"
    assert "Hello there" in html.parse_text(page) and "Hello there" in html.parse_markdown(page) and html.parse_title(page) == "x"
    assert html.parse_content(page)["body"].startswith("Hello there")
    rng = random.Random(11)
    pieces = ["<", ">", "</", "<!", "<![", "]]>", "<!--", "-->", "<?", "p", "head", "title", "a href=", '"', "'", "&", "&#x", ";", "=", "/", " ", "script", "x", "CDATA[", "<!doctype "]
    for _ in range(3000):
        made = "".join(rng.choices(pieces, k=rng.randint(0, 25)))
        for parse in (html.parse_title, html.parse_text, html.parse_markdown, html.parse_content):
            parse(made)
        html.parse_links(made, "http://h/")


def test_html():
    assert html.parse_title(PAGE) == "A title"
    got = html.parse_content(PAGE)
    assert (got["title"], got["description"], got["canonical_url"], got["language"]) == ("A  title", "D", "http://c/", "fr")
    assert "bold" in got["body"] and "var t" not in got["body"] and got["body"].split()[0] == "Head"
    assert [(x["url"], x["text"], x["title"]) for x in html.parse_links(PAGE, "http://h/d/")] == [("http://h/n", "n", ""), ("http://h/d/x.html", "link in", "T")]
    mark = html.parse_markdown(PAGE)
    assert "# Head" in mark and "**bold**" in mark and "[link in](x.html)" in mark and "\n- a" in mark
    assert html.parse_title(None) == "" and html.parse_text(None) == "" and html.parse_links("<a href='http://[bad'>x", "http://h/") == []


def test_extractors():
    assert html.extractor("simple") is html.EXTRACTORS["simple@1"]
    with pytest.raises(KeyError):
        html.extractor("none")


def joined_slowly(rows, gap, most):
    out = []
    for name, start, size in sorted(rows):
        end = start + size
        if out and out[-1][0] == name and start - out[-1][2] <= gap and max(end, out[-1][2]) - out[-1][1] <= most:
            out[-1] = (name, out[-1][1], max(end, out[-1][2]), out[-1][3] + 1)
        else:
            out.append((name, start, end, 1))
    return out


def test_ranges(spark):
    rng = random.Random(8)
    rows = [(f"f{rng.randint(0, 3)}", rng.randint(0, 4000), rng.randint(1, 60)) for _ in range(400)]
    found = ranges.coalesce_ranges(spark.createDataFrame(rows, "filename string, offset long, length long"), 5, 300)
    assert sorted(map(tuple, found.collect())) == joined_slowly(rows, 5, 300)


def test_range_and_crawl_specs():
    assert ranges.expand_ranges("0,3-5,4", 5) == [0, 3, 4]
    assert ranges.expand_ranges("all", 3) == [0, 1, 2]
    catalog = ["CC-MAIN-2024-30", "CC-MAIN-2024-10", "CC-MAIN-2023-50"]
    assert ranges.resolve_crawls(catalog, "latest") == catalog[:1]
    assert ranges.resolve_crawls(catalog, "2024,CC-MAIN-2023-50,latest") == catalog
    assert ranges.resolve_crawls(catalog, "2") == catalog[:2]
    with pytest.raises(ValueError):
        ranges.resolve_crawls(catalog, "nothing")
