"""Queries over hosts, ranks and the link graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import hashes, ranking, urls
from weftline.operators import frontier, hosts
from weftline.queries.index import index
from weftline.queries.registry import query
from weftline.session import table
from weftline.sources import captures

PROFILE = """SELECT url_host_name, min(url_host_registered_domain) AS registered_domain, count(*) AS url_count,
    count(*) FILTER (WHERE fetch_status BETWEEN 200 AND 299) AS status_2xx, count(*) FILTER (WHERE fetch_status BETWEEN 300 AND 399) AS status_3xx,
    count(*) FILTER (WHERE fetch_status BETWEEN 400 AND 499) AS status_4xx, count(*) FILTER (WHERE fetch_status BETWEEN 500 AND 599) AS status_5xx,
    (SELECT content_mime_detected FROM captures m WHERE m.url_host_name = c.url_host_name GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_mime,
    (SELECT content_languages FROM captures m WHERE m.url_host_name = c.url_host_name AND content_languages IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS language,
    min(fetch_time)::VARCHAR AS first_seen, max(fetch_time)::VARCHAR AS last_seen, sum(coalesce(warc_record_length, 0))::BIGINT AS total_bytes FROM captures c GROUP BY url_host_name"""

#: Ranks of the hosts of the pages: by number of pages, then name.
RANKS = """, counted AS (SELECT url_host_name AS host, count(*) AS n FROM captures GROUP BY 1),
ranks AS (SELECT host, row_number() OVER (ORDER BY n DESC, host)::BIGINT AS harmonic_pos, n::DOUBLE AS harmonic_val, array_to_string(list_reverse(string_split(host, '.')), '.') AS host_rev FROM counted)
"""
RATES = """, rates AS (SELECT a.url_host_name AS host, count(*) AS total_urls, sum(CASE WHEN a.content_digest <> b.content_digest THEN 1 ELSE 0 END)::BIGINT AS changed_urls,
round(sum(CASE WHEN a.content_digest <> b.content_digest THEN 1 ELSE 0 END)::DOUBLE / count(*), 4) AS change_rate FROM captures a JOIN captures_b b ON a.url = b.url GROUP BY 1)
"""
TIER = "CASE WHEN harmonic_pos <= 100000 AND change_rate > 0.8 THEN 1 WHEN harmonic_pos <= 1000000 AND change_rate >= 0.5 THEN 2 WHEN harmonic_pos <= 5000000 AND change_rate >= 0.2 THEN 3 WHEN harmonic_pos <= 10000000 THEN 4 ELSE 5 END"


def ranks(spark, sf_dir):
    """A rank table as published: positions by number of pages. Positions come from a range sort of the few hosts' counts."""
    counted = index(spark, sf_dir).groupBy(F.col("url_host_name").alias("host")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "host")).cast("long")
    return counted.select("host", place.alias("harmonic_pos"), F.col("n").cast("double").alias("harmonic_val"), urls.reverse_host(F.col("host")).alias("host_rev"))


def rates(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return hosts.change_rates(captures.from_pages(pages, "A"), captures.from_pages(pages, "B"))


@query(captures.SQL + PROFILE)
def host_profile(spark, sf_dir):
    return hosts.host_profile(index(spark, sf_dir))


@query(captures.SQL + RATES + "SELECT * FROM rates")
def host_change_rates(spark, sf_dir):
    return rates(spark, sf_dir)


@query(captures.SQL + RATES + "SELECT host, total_urls, change_rate, CASE WHEN change_rate >= 0.5 THEN 3 WHEN change_rate >= 0.2 THEN 4 ELSE 5 END AS tier FROM rates")
def host_diff_tiers(spark, sf_dir):
    """Without ranks the change rate alone decides."""
    return hosts.with_tier(rates(spark, sf_dir)).select("host", "total_urls", "change_rate", "tier")


@query(captures.SQL + RANKS + RATES + f", j AS (SELECT ranks.host, harmonic_pos, harmonic_val, coalesce(change_rate, 0) AS change_rate FROM ranks LEFT JOIN rates USING (host)), t AS (SELECT *, {TIER} AS tier FROM j) SELECT host, tier, CASE tier WHEN 1 THEN 24 WHEN 2 THEN 72 WHEN 3 THEN 168 WHEN 4 THEN 720 ELSE 0 END AS interval_hours, round(change_rate * ln(1 + harmonic_val), 9) AS score FROM t")
def host_schedule(spark, sf_dir):
    found = hosts.schedule(ranks(spark, sf_dir), rates(spark, sf_dir))
    return found.withColumn("score", F.round("score", 9))


@query(captures.SQL + RANKS + "SELECT host, harmonic_pos, harmonic_val FROM ranks WHERE starts_with(host_rev, 'com.') ORDER BY harmonic_pos LIMIT 10")
def rank_top(spark, sf_dir):
    return hosts.rank_top(ranks(spark, sf_dir), 10, "com").select("host", "harmonic_pos", "harmonic_val")


@query(captures.SQL + RANKS + "SELECT host, harmonic_pos FROM ranks WHERE host = 'ththin.example.com'")
def rank_lookup(spark, sf_dir):
    return hosts.rank_lookup(ranks(spark, sf_dir), "ththin.example.com").select("host", "harmonic_pos")


@query(captures.SQL + RANKS + f", p AS ({PROFILE}) SELECT ranks.host, harmonic_pos, regexp_extract(ranks.host, '([^.]+)$', 1) AS tld, registered_domain, url_count, status_2xx, top_mime, total_bytes FROM ranks LEFT JOIN p ON ranks.host = p.url_host_name AND p.url_count > 1")
def host_enrich(spark, sf_dir):
    """What wasn't measured stays null, except the domain, which then is the last two labels."""
    profiles = hosts.host_profile(index(spark, sf_dir)).where("url_count > 1")
    found = hosts.enrich(ranks(spark, sf_dir), profiles=profiles)
    known = F.when(F.col("url_count").isNotNull(), F.col("registered_domain"))
    return found.select("host", "harmonic_pos", "tld", known.alias("registered_domain"), "url_count", "status_2xx", "top_mime", "total_bytes")


LINKS = """WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS link FROM pages),
vertices AS (SELECT DISTINCT page_id AS id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages),
edges AS (SELECT page_id AS src, (page_id * 7 + length(link)) % 300 AS dst FROM h)
"""


def graph(spark, sf_dir):
    """A graph over the pages: each link of a page leads to a page that its length chooses; some lead nowhere."""
    pages = table(spark, sf_dir, "pages")
    name = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1))
    vertices = pages.select(F.col("page_id").alias("id"), urls.reverse_host(name).alias("host_rev")).distinct()
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)"'), F.lit(1))).alias("link"))
    edges = links.select(F.col("page_id").alias("src"), ((F.col("page_id") * 7 + F.length("link")) % 300).alias("dst"))
    return vertices, edges


@query(LINKS + "SELECT id, host, (SELECT count(*) FROM edges WHERE dst = id) AS in_degree, (SELECT count(*) FROM edges WHERE src = id) AS out_degree FROM vertices")
def graph_degrees(spark, sf_dir):
    return hosts.degrees(*graph(spark, sf_dir))


@query(
    "WITH a AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS domain FROM pages WHERE page_id % 3 <> 0), b AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS domain FROM pages WHERE page_id % 3 <> 1) "
    "SELECT coalesce(a.domain, b.domain) AS domain, CASE WHEN a.domain IS NULL THEN 'added' WHEN b.domain IS NULL THEN 'removed' ELSE 'shared' END AS status FROM a FULL JOIN b ON a.domain = b.domain"
)
def domain_diff(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("domain"))
    return hosts.domain_diff(rows.where("page_id % 3 <> 0"), rows.where("page_id % 3 <> 1"))


@query(
    "WITH RECURSIVE e AS (SELECT DISTINCT p_partkey % 97 AS src, (p_partkey * 31 + p_size) % 97 AS dst FROM part), walk AS (SELECT 0::BIGINT AS url, 0 AS depth UNION SELECT e.dst, depth + 1 FROM walk JOIN e ON walk.url = e.src WHERE depth < 3) "
    "SELECT url::VARCHAR AS url, min(depth)::INT AS depth, (1 / pow(2, min(depth)))::DOUBLE AS priority FROM walk GROUP BY url"
)
def frontier_expand(spark, sf_dir):
    """Breadth-first link expansion, three levels deep."""
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 97).cast("string").alias("src"), ((F.col("p_partkey") * 31 + F.col("p_size")) % 97).cast("string").alias("dst")).distinct()
    seeds = spark.createDataFrame([("0", 1.0)], "url string, priority double")
    return frontier.expand(seeds, rows, 3)


FRONTIER = """WITH f AS (SELECT url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, ((page_id * 37) % 101)::DOUBLE AS priority, page_id % 50 AS next_at, page_id % 4 AS state, row_number() OVER (PARTITION BY url ORDER BY page_id) AS k FROM pages),
g AS (SELECT * FROM f WHERE k = 1), hosts AS (SELECT host, max(next_at) + 10 AS host_next FROM g WHERE next_at % 2 = 0 GROUP BY host)
"""


def frontier_tables(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"))
    name = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1))
    made = rows.select("url", name.alias("host"), ((F.col("page_id") * 37) % 101).cast("double").alias("priority"), F.lit(0).alias("depth"), F.lit(0).alias("retries"), (F.col("page_id") % 50).alias("next_at"), (F.col("page_id") % 4).cast("int").alias("state"))
    clocks = made.where("next_at % 2 = 0").groupBy("host").agg((F.max("next_at") + 10).alias("next_at"))
    return made, clocks


@query(
    FRONTIER + ", due AS (SELECT g.*, row_number() OVER (PARTITION BY g.host ORDER BY priority DESC, next_at, url) AS r FROM g LEFT JOIN hosts USING (host) WHERE state = 0 AND next_at <= 45 AND coalesce(host_next, 0) <= 45) "
    "SELECT url, host, priority, next_at FROM due WHERE r = 1 ORDER BY priority DESC, next_at, url LIMIT 15"
)
def frontier_claim(spark, sf_dir):
    """The best URL of each host that may be asked."""
    made, clocks = frontier_tables(spark, sf_dir)
    return frontier.claim(made, clocks, now=45, n=15).select("url", "host", "priority", "next_at")


@query(FRONTIER + "SELECT url, CASE WHEN page_id IS NULL THEN state WHEN ok THEN 2 ELSE 0 END::INT AS state, CASE WHEN page_id IS NOT NULL AND NOT ok THEN 1 ELSE 0 END AS retries, (CASE WHEN page_id IS NOT NULL AND NOT ok THEN 100 + 5 ELSE next_at END)::BIGINT AS next_at FROM g LEFT JOIN (SELECT url AS u, min(page_id) AS page_id, min(page_id) % 2 = 0 AS ok FROM pages GROUP BY url HAVING min(page_id) % 3 = 0) o ON g.url = o.u")
def frontier_settle(spark, sf_dir):
    """Outcomes: done, or back with a delay."""
    made, _ = frontier_tables(spark, sf_dir)
    outcomes = table(spark, sf_dir, "pages").groupBy("url").agg(F.min("page_id").alias("page_id")).where("page_id % 3 = 0").select("url", (F.col("page_id") % 2 == 0).alias("ok"))
    return frontier.settle(made, outcomes, now=100, delay=5, most_retries=2).select("url", "state", "retries", "next_at")


@query("SELECT s_suppkey AS pos, CASE WHEN pct <= 0.001 THEN 1 WHEN pct <= 0.005 THEN 2 WHEN pct <= 0.01 THEN 3 WHEN pct <= 0.05 THEN 4 WHEN pct <= 0.1 THEN 5 WHEN pct <= 0.2 THEN 6 WHEN pct <= 0.4 THEN 7 WHEN pct <= 0.6 THEN 8 WHEN pct <= 0.8 THEN 9 ELSE 10 END AS tier FROM (SELECT s_suppkey, s_suppkey::DOUBLE / 90 AS pct FROM supplier)")
def rank_tiers(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    return rows.select(F.col("s_suppkey").alias("pos"), ranking.harmonic_tier(F.col("s_suppkey"), F.lit(90)).alias("tier"))


@query("SELECT s_suppkey AS pos, round(s_acctbal * (1 + 0.5 * ln(1 + s_suppkey)), 6) AS boosted, round(1 + (10 - greatest(1, least(10, s_suppkey))) * 0.1, 6)::DOUBLE AS tier_boost FROM supplier")
def rank_boosts(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    boosted = ranking.link_boost(F.col("s_acctbal"), F.col("s_suppkey"), 0.5)
    return rows.select(F.col("s_suppkey").alias("pos"), F.round(boosted, 6).alias("boosted"), F.round(ranking.tier_boost(F.col("s_suppkey")).cast("double"), 6).alias("tier_boost"))


@query(captures.SQL + "SELECT page_id, url FROM captures WHERE contains(url_host_name, 'ththi')")
def news_search(spark, sf_dir):
    """Hosts by a part of their name."""
    return hosts.host_contains(index(spark, sf_dir), "ThThI").select("page_id", "url")


@query(captures.SQL + "SELECT a.page_id, a.url, max_by(b.content_digest, b.page_id) AS content_digest FROM captures a LEFT JOIN captures_b b ON a.url = b.url GROUP BY a.page_id, a.url")
def refetch_provenance(spark, sf_dir):
    """The last record of each URL beside its rows."""
    pages = table(spark, sf_dir, "pages")
    rows = captures.from_pages(pages, "A").select("page_id", "url")
    records = captures.from_pages(pages, "B").select("url", F.col("page_id").alias("place"), "content_digest")
    return hosts.attach_last(rows, records, "url", "place", ["content_digest"])


@query(
    "WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders) SELECT 'cc-main-' || strftime(m, '%Y-') || lower(strftime(m, '%b')) || CASE WHEN month(m) % 2 = 0 THEN '' ELSE '-dec' END AS name, (year(m) * 100 + month(m))::INT AS \"order\" FROM m "
    "UNION ALL SELECT 'old-' || r_name, 0 FROM region"
)
def release_order(spark, sf_dir):
    """Names of releases, one for each month of orders, in the order of their first month; other names have none."""
    month = table(spark, sf_dir, "orders").select(F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).alias("m")).distinct()
    end = F.when(F.month("m") % 2 == 0, "").otherwise("-dec")
    names = month.select(F.concat(F.lit("cc-main-"), F.date_format("m", "yyyy-"), F.lower(F.date_format("m", "MMM")), end).alias("name"))
    names = names.unionByName(table(spark, sf_dir, "region").select(F.concat(F.lit("old-"), "r_name").alias("name")))
    return names.select("name", hosts.release_order(F.col("name")).alias("order"))


@query(
    "WITH f AS (SELECT 'cc-main-' || (2015 + s_nationkey % 8) || '-' || ['jan','apr','oct'][(s_nationkey % 3)::INT + 1] AS name, s_suppkey % 4 AS kind, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_suppkey END AS size FROM supplier) "
    "SELECT name FROM f WHERE size > 0 AND kind < 3 GROUP BY name HAVING count(DISTINCT kind) = 3 ORDER BY substr(name, 9, 4)::INT * 100 + CASE substr(name, 14) WHEN 'jan' THEN 1 WHEN 'apr' THEN 4 ELSE 10 END DESC, name DESC LIMIT 1"
)
def release_complete(spark, sf_dir):
    """The newest release of which vertices, edges and ranks are all there."""
    key, kinds = F.col("s_nationkey"), F.array(F.lit("vertices"), F.lit("edges"), F.lit("ranks"), F.lit("other"))
    month = F.get(F.array(F.lit("jan"), F.lit("apr"), F.lit("oct")), (key % 3).cast("int"))
    size = F.when(F.col("s_suppkey") % 5 == 0, 0).otherwise(F.col("s_suppkey"))
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("cc-main-"), (key % 8 + 2015).cast("string"), F.lit("-"), month).alias("name"), F.get(kinds, (F.col("s_suppkey") % 4).cast("int")).alias("kind"), size.alias("size"))
    return hosts.first_complete(files.select("name").distinct(), files, ["vertices", "edges", "ranks"])


@query(
    captures.SQL + RATES + ", t AS (SELECT CASE WHEN change_rate >= 0.5 THEN 3 WHEN change_rate >= 0.2 THEN 4 ELSE 5 END AS tier FROM rates), n AS (SELECT tier, count(*) AS hosts FROM t GROUP BY tier) "
    "SELECT tier, hosts, CASE tier WHEN 3 THEN 4650 WHEN 4 THEN 1450 ELSE 0 END AS budget, round(CASE tier WHEN 3 THEN 4650 WHEN 4 THEN 1450 ELSE 0 END / hosts, 6) AS each FROM n"
)
def daily_budget(spark, sf_dir):
    """What the hosts of each tier may be fetched a day, together and each."""
    tiers = hosts.with_tier(rates(spark, sf_dir)).groupBy("tier").agg(F.count("*").alias("hosts"))
    return hosts.with_budget(tiers, 50_000)


@query(
    captures.SQL + RANKS + ", l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"(/[^\"]*)\"', 1)) AS link FROM pages), v AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages WHERE page_id % 3 > 0), "
    "e AS (SELECT lower(regexp_extract(p.url, '^[a-z]+://([^/?#:]+)', 1)) AS src, lower(regexp_extract(q.url, '^[a-z]+://([^/?#:]+)', 1)) AS dst FROM l JOIN pages p USING (page_id) JOIN pages q ON q.page_id = (l.page_id * 7 + length(link)) % 300) "
    "SELECT ranks.host, harmonic_pos, CASE WHEN v.host IS NOT NULL THEN (SELECT count(*) FROM e WHERE dst = ranks.host) END AS in_degree, CASE WHEN v.host IS NOT NULL THEN (SELECT count(*) FROM e WHERE src = ranks.host) END AS out_degree FROM ranks LEFT JOIN v ON v.host = ranks.host"
)
def host_measured(spark, sf_dir):
    """Ranked hosts with their links in and out, null for those that aren't in the graph."""
    pages = table(spark, sf_dir, "pages")
    name = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1))
    known = pages.select("page_id", name.alias("host"))
    links = pages.select("page_id", name.alias("src"), F.explode(F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)"'), F.lit(1))).alias("link"))
    to = ((F.col("page_id") * 7 + F.length("link")) % 300).alias("page_id")
    edges = links.select("src", to).join(known, "page_id").select("src", F.col("host").alias("dst"))
    vertices = known.where("page_id % 3 > 0").select(F.col("host").alias("id"), urls.reverse_host(F.col("host")).alias("host_rev")).distinct()
    measured = hosts.degrees(vertices, edges)
    return hosts.enrich(ranks(spark, sf_dir), measured=measured).select("host", "harmonic_pos", "in_degree", "out_degree")


@query("SELECT vec_id, (vec_id * 2654435761) % 65536 AS h, bit_count(xor((vec_id * 2654435761) % 65536, vec_id))::INT AS distance FROM embeddings")
def hamming_distances(spark, sf_dir):
    h = (F.col("vec_id") * 2654435761) % 65536
    return table(spark, sf_dir, "embeddings").select("vec_id", h.alias("h"), hashes.hamming(h, F.col("vec_id")).alias("distance"))
