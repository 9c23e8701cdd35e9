"""Line dedup by distinct-site spread.

A line that stands on `least_sites` or more different sites is boilerplate. HyperLogLog sketches of the sites of each line
hash are merged by aggregation; lines whose estimate is far above the threshold are boilerplate, those far below are
not, and those between are counted exactly. Of a boilerplate line only the document of smallest id keeps its lines: text
that whole groups of copies share is left once. A document that has no text left goes, as all of it stands elsewhere.

All of this is DataFrame work on the JVM. Lines are shuffled as hashes, counts are aggregated before shuffles, and a line that
a third of all documents have meets its verdict in a join whose skewed partitions Spark splits.

Edge cases: lines are compared without white space at their ends; blank lines are never boilerplate and stay; null and
empty texts stay as they are; rows without a site count for none; rows whose id is null keep no boilerplate unless all
rows that have the line lack an id; repeated rows keep or lose the same lines. Very long texts are split whole in a row. A tie for the smallest id
is between rows of one id, which all keep the line. An empty table gives no rows. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import cut

#: Around the threshold, estimates between these multiples of it are settled by exact counts.
BELOW, ABOVE = 0.4, 1.6


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_rows(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """id, version (a hash of the text), site, position and line hash of each line that isn't blank."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.col(site_col).alias("site"), F.posexplode(split_lines(F.col(text_col))).alias("position", "line"))
    line = F.regexp_replace("line", r"^\s+|\s+$", "")
    trimmed = rows.select("id", "version", "site", "position", F.when(F.col("line").rlike(r"^\s|\s$"), line).otherwise(F.col("line")).alias("line"))
    return trimmed.where("line <> ''").select("id", "version", "site", "position", F.xxhash64("line").alias("line"))


def boilerplate(lines: DataFrame, least_sites: int) -> DataFrame:
    """line and keeper (the smallest id that has it) of the lines on at least `least_sites` sites."""
    sketched = lines.groupBy("line").agg(F.approx_count_distinct("site", 0.1).alias("sites"), F.count("*").alias("n"), F.min("id").alias("keeper"))
    likely = cut(sketched.where((F.col("n") >= least_sites) & (F.col("sites") >= BELOW * least_sites)).select("line", "sites", "keeper"), "likely")
    sure = likely.where(F.col("sites") > ABOVE * least_sites).select("line", "keeper")
    near = likely.where(F.col("sites") <= ABOVE * least_sites).select("line", "keeper")
    pairs = lines.join(near, "line").where("site is not null").groupBy("line", "site").agg(F.min("keeper").alias("keeper"))
    exact = pairs.groupBy("line").agg(F.count("*").alias("sites"), F.min("keeper").alias("keeper")).where(F.col("sites") >= least_sites)
    return sure.unionByName(exact.select("line", "keeper"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", least_sites: int = 10) -> DataFrame:
    """docs with the texts that are left, and n_lines and n_removed; documents without text left are dropped."""
    lines = cut(line_rows(docs, id_col, text_col, site_col), "lines")
    known = cut(boilerplate(lines, least_sites), "boilerplate")
    hits = lines.join(known, "line").where(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy("id", "version").agg(F.collect_set("position").alias("removed"))
    columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]  # as Spark compares names
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    hits = hits.select(F.col("id").alias("hit"), F.col("version").alias("hit_version"), "removed")
    joined = rows.join(hits, F.col("id").eqNullSafe(F.col("hit")) & (F.col("version") == F.col("hit_version")), "left")
    # One split for each text: the lambda's variable holds its lines.
    kept = lambda parts: F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("removed")), lambda i: F.get(parts, i))
    left = F.element_at(F.transform(F.array(split_lines(F.col("text"))), lambda parts: F.array_join(kept(parts), "\n")), 1)
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(left)
    n_lines = F.coalesce(F.size(split_lines(F.col("text"))), F.lit(0))
    made = joined.select("row", text.alias("left"), "removed", F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).alias("n"))
    made = made.where(F.col("removed").isNull() | F.col("left").rlike(r"\S"))
    return made.select(*[F.col("left").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in columns], "n_lines", F.when(F.col("removed").isNull(), 0).otherwise(F.col("n")).cast("long").alias("n_removed"))
