"""The crawl frontier as tables: admission, claims under politeness, retries and link expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import urls
from weftline.session import cut

PENDING, CLAIMED, DONE, FAILED = 0, 1, 2, 3


def admit(frontier: DataFrame, found: DataFrame) -> DataFrame:
    """The frontier with the found URLs (url, priority, depth, next_at) that it lacks; of repeated ones the best priority.

    Exact: joined by URL, no approximate filter.
    """
    ranked = found.withColumn("__rank", F.row_number().over(Window.partitionBy("url").orderBy(F.desc("priority"), "depth", "next_at"))).where("__rank = 1").drop("__rank")
    fresh = ranked.join(frontier.select("url"), "url", "left_anti")
    made = fresh.select("url", urls.host(F.col("url")).alias("host"), "priority", "depth", F.lit(0).alias("retries"), "next_at", F.lit(PENDING).alias("state"))
    return frontier.unionByName(made)


def claim(frontier: DataFrame, hosts: DataFrame, now: int, n: int) -> DataFrame:
    """The n best URLs that may be fetched now: pending, due, one for each host whose own time has come (host, next_at)."""
    clocks = hosts.select("host", F.col("next_at").alias("host_next"))
    due = frontier.where((F.col("state") == PENDING) & (F.col("next_at") <= now)).join(clocks, "host", "left").where(F.coalesce("host_next", F.lit(0)) <= now).drop("host_next")
    best = due.withColumn("__rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("priority"), "next_at", "url"))).where("__rank = 1").drop("__rank")
    return best.orderBy(F.desc("priority"), "next_at", "url").limit(n)


def hold(hosts: DataFrame, claimed: DataFrame, now: int, delay: int) -> DataFrame:
    """Host clocks after claims: now + delay, and never earlier than before."""
    moved = claimed.groupBy("host").agg(F.lit(now + delay).cast("long").alias("next_at"))
    return hosts.select("host", "next_at").unionByName(moved).groupBy("host").agg(F.max("next_at").alias("next_at"))


def settle(frontier: DataFrame, outcomes: DataFrame, now: int, delay: int, most_retries: int) -> DataFrame:
    """States after outcomes (url, ok): done, or pending again after delay * 2^retries, or failed after the last retry."""
    rows = frontier.join(outcomes.select("url", "ok"), "url", "left")
    again = (~F.col("ok")) & (F.col("retries") < most_retries)
    state = F.when(F.col("ok").isNull(), F.col("state")).when(F.col("ok"), DONE).when(again, PENDING).otherwise(FAILED)
    next_at = F.when(again, now + delay * F.pow(F.lit(2), F.col("retries")).cast("long")).otherwise(F.col("next_at"))
    retries = F.col("retries") + F.when(again, 1).otherwise(0)
    return rows.select("url", "host", "priority", "depth", retries.alias("retries"), next_at.alias("next_at"), state.alias("state"))


def reopen(frontier: DataFrame) -> DataFrame:
    """After a stop, what was claimed is pending again."""
    return frontier.withColumn("state", F.when(F.col("state") == CLAIMED, PENDING).otherwise(F.col("state")))


def expand(seeds: DataFrame, links: DataFrame, most_depth: int, same_host: bool = False) -> DataFrame:
    """url, depth and priority of all that links (src, dst) reach from seeds (url, priority): half the priority a step, each URL once.

    Breadth first: a round joins the last level with the links and leaves out what was seen; rounds are cut.
    """
    seen = cut(seeds.groupBy("url").agg(F.max("priority").alias("priority")).select("url", F.lit(0).alias("depth"), "priority"), "level")
    level = seen
    for depth in range(1, most_depth + 1):
        rows = level.join(links, level["url"] == links["src"])
        if same_host:
            rows = rows.where(urls.host(F.col("src")) == urls.host(F.col("dst")))
        found = rows.groupBy(F.col("dst").alias("url")).agg((F.max("priority") / 2).alias("priority"))
        level = cut(found.join(seen.select("url"), "url", "left_anti").select("url", F.lit(depth).alias("depth"), "priority"), "level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def counters(fetches: DataFrame) -> DataFrame:
    """One row of counters over fetches (outcome, bytes)."""
    kinds = ("fetched", "failed", "retried", "disallowed", "unreachable", "discovered")
    return fetches.agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in kinds], F.sum("bytes").alias("bytes"))
