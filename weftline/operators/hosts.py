"""Hosts, ranks and the link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import ranking, urls


def status_class(status: str, hundreds: int) -> Column:
    return F.count_if((F.col(status) >= hundreds * 100) & (F.col(status) < hundreds * 100 + 100))


def mode(name: str) -> Column:
    """The most frequent value, the least of several."""
    return F.mode(name, True)


def host_profile(index: DataFrame) -> DataFrame:
    """A row per host: captures by status class, most frequent type and language, first and last time, bytes."""
    time = F.col("fetch_time").cast("string")
    return index.groupBy("url_host_name").agg(
        F.min("url_host_registered_domain").alias("registered_domain"),
        F.count("*").alias("url_count"),
        *[status_class("fetch_status", k).alias(f"status_{k}xx") for k in (2, 3, 4, 5)],
        mode("content_mime_detected").alias("top_mime"),
        mode("content_languages").alias("language"),
        F.min(time).alias("first_seen"),
        F.max(time).alias("last_seen"),
        F.sum(F.coalesce("warc_record_length", F.lit(0))).alias("total_bytes"),
    )


def change_rates(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per host of the earlier crawl: URLs in both crawls and the share whose digest changed. Repeated URLs pair up all ways."""
    a = before.select("url", F.col("url_host_name").alias("host"), F.col("content_digest").alias("digest_a"))
    b = after.select("url", F.col("content_digest").alias("digest_b"))
    changed = F.sum(F.when(F.col("digest_a") != F.col("digest_b"), 1).otherwise(0))
    return a.join(b, "url").groupBy("host").agg(F.count("*").alias("total_urls"), changed.alias("changed_urls"), F.round(changed / F.count("*"), 4).alias("change_rate"))


def with_tier(rates: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """Change rates with a recrawl tier; ranks (host, harmonic_pos) may be missing for a host."""
    found = rates.join(ranks, "host", "left") if ranks is not None else rates.withColumn("harmonic_pos", F.lit(None).cast("long"))
    return found.withColumn("tier", ranking.crawl_tier(F.col("harmonic_pos"), F.col("change_rate")))


def schedule(ranks: DataFrame, rates: DataFrame) -> DataFrame:
    """host, tier, interval_hours and score for ranks (host, harmonic_pos, harmonic_val) and change rates."""
    rows = ranks.join(rates.select("host", "change_rate"), "host", "left")
    rate = F.coalesce("change_rate", F.lit(0.0))
    tier = ranking.crawl_tier(F.col("harmonic_pos"), rate)
    return rows.select("host", tier.alias("tier"), ranking.tier_interval(tier).alias("interval_hours"), ranking.crawl_score(F.col("harmonic_val"), rate).alias("score"))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """In and out degree of each vertex (id, host_rev); edges (src, dst) of unknown vertices are ignored, and zero is a measurement."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    rows = vertices.join(out, "id", "left").join(into, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("id", urls.reverse_host(F.col("host_rev")).alias("host"), zero("in_degree"), zero("out_degree"))


def enrich(ranks: DataFrame, measured: DataFrame | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """Ranks (host, ...) with degrees and host profiles where they were measured, null where not.

    The profile's registered domain counts before the last two labels of the host.
    """
    rows = ranks.withColumns({"tld": urls.tld(F.col("host")), "naive_domain": urls.naive_domain(F.col("host"))})
    if measured is not None:
        rows = rows.join(measured.select("host", "in_degree", "out_degree"), "host", "left")
    if profiles is None:
        return rows.withColumnRenamed("naive_domain", "registered_domain")
    rows = rows.join(profiles.withColumnRenamed("url_host_name", "host"), "host", "left")
    return rows.withColumn("registered_domain", F.coalesce(F.nullif("registered_domain", F.lit("")), "naive_domain")).drop("naive_domain")


def rank_top(ranks: DataFrame, k: int, tld: str | None = None) -> DataFrame:
    """The k first by harmonic position, of one top-level domain (by the reversed host's first labels)."""
    if tld:
        ranks = ranks.where(F.col("host_rev").startswith(".".join(reversed(tld.split("."))) + "."))
    return ranks.orderBy("harmonic_pos", "host_rev").limit(k)


def rank_lookup(ranks: DataFrame, host: str) -> DataFrame:
    return ranks.where(F.col("host_rev") == ".".join(reversed(host.lower().split(".")))).orderBy("harmonic_pos").limit(1)


def domain_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """domain and status (added, removed, shared) over two releases (domain); exact strings, each once."""
    a = old.select("domain").distinct().withColumn("old", F.lit(True))
    b = new.select("domain").distinct().withColumn("new", F.lit(True))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("shared")
    return a.join(b, "domain", "full_outer").select("domain", status.alias("status"))


def under_tld(host: Column, tld: str) -> Column:
    return host.endswith("." + tld) | (urls.tld(host) == tld)


#: Months in the names of releases.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def release_order(name: Column) -> Column:
    """year * 100 + the first month of a release's name, 0 if it isn't one: newest first by descending order."""
    pattern = r"^cc-main-(\d{4})-([a-z]{3})"
    year, month = F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2)
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), month)
    return F.when(year == "", 0).otherwise(F.coalesce(year.try_cast("int"), F.lit(0)) * 100 + number).cast("int")


def first_published(releases: DataFrame) -> DataFrame:
    """The newest release (name, size) whose table has a size; no row if none has."""
    return releases.where("size > 0").orderBy(F.desc(release_order(F.col("name"))), F.desc("name")).limit(1)


def first_complete(releases: DataFrame, files: DataFrame, kinds: list[str]) -> DataFrame:
    """The newest release (name) that has a file with a size of each kind; files are (name, kind, size). No row if none is complete."""
    there = files.where(F.col("kind").isin(*kinds) & (F.col("size") > 0)).groupBy("name").agg(F.count_distinct("kind").alias("kinds"))
    whole = releases.join(there.where(F.col("kinds") == len(set(kinds))), "name", "left_semi")
    return whole.orderBy(F.desc(release_order(F.col("name"))), F.desc("name")).limit(1)


def with_budget(tiers: DataFrame, capacity: int) -> DataFrame:
    """Tiers (tier, hosts) with what they may be fetched a day in all, and of each host; tier 5 isn't fetched."""
    budgets = daily_budget(capacity)
    pick = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in budgets.items() for x in pair]), F.col("tier")), F.lit(0))
    return tiers.withColumn("budget", pick).withColumn("each", F.round(F.try_divide("budget", "hosts"), 6))


def daily_budget(capacity: int) -> dict[int, int]:
    """Fetches a day for tiers 1 to 4."""
    return {tier: round(capacity * share) for tier, share in {1: 0.023, 2: 0.052, 3: 0.093, 4: 0.029}.items()}


def host_contains(index: DataFrame, part: str) -> DataFrame:
    """Rows whose host holds a string, in any case; Spark reads the other columns of surviving row groups only."""
    return index.where(F.contains(F.lower("url_host_name"), F.lit(part.lower())))


def attach_last(rows: DataFrame, records: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Rows with columns of the last of the records that share their key, null where there is none."""
    last = records.groupBy(F.col(key)).agg(F.max_by(F.struct(*columns), order).alias("__last"))
    return rows.join(last, key, "left").select(*rows.columns, *[F.col(f"__last.{c}").alias(c) for c in columns])
