"""Registered domains by public suffix rules: plain, wildcard and exception rules, the longest match of which decides.

A rule file has one rule a line (`co.uk`, `*.ck`, `!www.ck`), comments after `//`, and may mark a part as private. Hosts take part once each:
every host is exploded into its suffixes, at most as many as it has labels, which meet the rules in an equality join; the best rule of
each host is picked by an aggregation. Rules are broadcast below a counted size and shuffled beyond it.

Edge cases: hosts are compared in lower case, without a dot at either end; rules with letters beyond ASCII are also known in
their encoded form. A host that no rule fits has its last label as suffix. A bare suffix, an address, an empty or null host have no registered
domain (null); `shard_key` falls back to the host there, as one host must stay in one shard. Repeated rules count once; an
exception wins over every other rule. No rules at all leave the last two labels. Extra columns pass through; columns named as the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import hashes

#: Rules up to this many are sent to all tasks; the published list has some ten thousand.
FEW_RULES = 1 << 17
RULE = "key string, labels int, exception boolean, private boolean"
#: Where a rule file's private part begins and ends.
PRIVATE = ("===BEGIN PRIVATE DOMAINS===", "===END PRIVATE DOMAINS===")


def _encoded(rule: str) -> str | None:
    """A rule with its labels in the form that URLs carry; none if there is no such form."""
    try:
        return ".".join(label.encode("idna").decode() if label != "*" else label for label in rule.split("."))
    except UnicodeError:
        return None


def parse_rules(lines: Iterable[str]) -> list[tuple[str, int, bool, bool]]:
    """key (the rule without its star or exclamation mark), labels of the suffix it makes, whether it is an exception, whether it is private.

    A wildcard's key is what its star stands before, so hosts meet it by the suffix one label shorter.
    """
    found, private = {}, False
    for line in lines:
        if line.lstrip().startswith("//"):
            private = (private or PRIVATE[0] in line) and PRIVATE[1] not in line
        elif words := line.split():
            rule = words[0].lower().strip(".")
            for form in dict.fromkeys((rule, _encoded(rule))):
                if form:
                    bare = form.removeprefix("!").removeprefix("*.")
                    labels = bare.count(".") + 1 - form.startswith("!") + form.startswith("*.")
                    found[bare, labels, form.startswith("!")] = private
    return [(*k, p) for k, p in found.items()]


def rules(spark: SparkSession, lines: Iterable[str], private: bool = True) -> DataFrame:
    """A table of rules; without those of the private part if that is asked."""
    return spark.createDataFrame([r for r in parse_rules(lines) if private or not r[3]], RULE)


def read_rules(spark: SparkSession, path: str, private: bool = True) -> DataFrame:
    """The rules of a file; such a file has some ten thousand lines."""
    return rules(spark, (r["value"] for r in spark.read.text(path, wholetext=False).coalesce(1).collect()), private)


def clean(host: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(host), r"^\.+|\.+$", ""))


def is_address(host: Column) -> Column:
    return host.rlike(r"^\[|:|^[0-9]+(\.[0-9]+){3}$")


def suffix_table(hosts: DataFrame, rules: DataFrame, host_col: str = "host") -> DataFrame:
    """host, public_suffix and registered_domain, once for each different host."""
    once = hosts.select(F.col(host_col).alias("host")).where("host IS NOT NULL").distinct()
    parts = once.withColumn("labels", F.split(clean(F.col("host")), r"\."))
    n = F.size("labels")
    each = parts.select("host", F.explode(F.sequence(F.lit(1), n)).alias("size"), "labels")
    each = each.select("host", "size", F.array_join(F.slice("labels", F.size("labels") - F.col("size") + 1, F.col("size")), ".").alias("key"))
    known = rules.select("key", F.col("labels").alias("makes"), "exception").distinct()
    if known.count() <= FEW_RULES:
        known = F.broadcast(known)
    best = F.max(F.struct("exception", "makes"))
    fit = each.join(known, "key").groupBy("host").agg(best.alias("best"))
    found = parts.join(fit, "host", "left").select("host", "labels", F.coalesce("best.makes", F.lit(1)).alias("makes"))
    real = ~is_address(F.col("host")) & (F.array_join("labels", "") != "") & F.forall("labels", lambda x: x != "")
    tail = lambda k: F.array_join(F.slice("labels", F.greatest(F.size("labels") - k + 1, F.lit(1)), k), ".")
    return found.select(
        "host",
        # A wildcard may ask for one label more than a host has: then the host itself is a suffix.
        F.when(real, tail(F.col("makes"))).alias("public_suffix"),
        F.when(real & (F.size("labels") > F.col("makes")), tail(F.col("makes") + 1)).alias("registered_domain"),
    )


def with_registered_domain(rows: DataFrame, rules: DataFrame, host_col: str = "host") -> DataFrame:
    """rows with public_suffix and registered_domain. A host with very many rows is split by Spark, as the table beside it has it once."""
    kept = [c for c in rows.columns if c.lower() not in ("public_suffix", "registered_domain")]
    domains = suffix_table(rows, rules, host_col).select(F.struct("host", "public_suffix", "registered_domain").alias("found_by_rules"))
    joined = rows.select(*kept).join(domains, F.col(host_col) == F.col("found_by_rules.host"), "left")
    return joined.select(*kept, "found_by_rules.public_suffix", "found_by_rules.registered_domain")


def shard_key(host: Column, registered_domain: Column) -> Column:
    """What a URL's shard follows: its registered domain, else its host; null without a host."""
    return F.coalesce(registered_domain, F.nullif(clean(host), F.lit("")))


def shard(host: Column, registered_domain: Column, shards: int) -> Column:
    key = shard_key(host, registered_domain)
    return F.when(key.isNotNull(), hashes.shard(key, shards))
