"""Ranking formulas and recrawl tiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shares of all hosts up to which a tier reaches, tier 1 first.
TIER_SHARES = (0.001, 0.005, 0.01, 0.05, 0.10, 0.20, 0.40, 0.60, 0.80)
#: Hours between visits by recrawl tier; tier 5 is on demand.
TIER_HOURS = {1: 24, 2: 72, 3: 168, 4: 720}


def bm25_idf(documents: Column, frequency: Column) -> Column:
    return F.when(frequency == 0, 0.0).otherwise(F.ln((documents - frequency + 0.5) / (frequency + 0.5) + 1))


def bm25_tf(tf: Column, length: Column, mean_length: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    ratio = length / F.greatest(F.lit(1.0), mean_length)
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * ratio))


def link_boost(score: Column, harmonic: Column, alpha: float) -> Column:
    return score * (1 + alpha * F.log1p(harmonic))


def harmonic_tier(position: Column, hosts: Column) -> Column:
    """1 (most important) to 10 (the long tail)."""
    share, found = position / hosts, F.lit(10)
    for tier, most in reversed([*enumerate(TIER_SHARES, 1)]):
        found = F.when(share <= most, tier).otherwise(found)
    return F.when(hosts == 0, 10).otherwise(found)


def tier_boost(tier: Column) -> Column:
    return 1.0 + (10 - F.greatest(F.lit(1), F.least(F.lit(10), tier))) * 0.1


def crawl_tier(position: Column, rate: Column) -> Column:
    """1 to 5; without a rank (null or not positive) the change rate alone decides, and no better than 3."""
    known = position.isNotNull() & (position > 0)
    by_rate = F.when(rate >= 0.5, 3).when(rate >= 0.2, 4).otherwise(5)
    by_both = (
        F.when((position <= 100_000) & (rate > 0.8), 1)
        .when((position <= 1_000_000) & (rate >= 0.5), 2)
        .when((position <= 5_000_000) & (rate >= 0.2), 3)
        .when(position <= 10_000_000, 4)
        .otherwise(5)
    )
    return F.when(known, by_both).otherwise(by_rate)


def crawl_score(harmonic: Column, rate: Column) -> Column:
    return rate * F.log1p(harmonic)


def tier_interval(tier: Column) -> Column:
    found = F.lit(0)
    for k, hours in TIER_HOURS.items():
        found = F.when(tier == k, hours).otherwise(found)
    return found
