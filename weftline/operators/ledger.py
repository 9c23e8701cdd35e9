"""Ledgers, tallies, histograms and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text


def upsert(ledger: DataFrame, update: DataFrame, keys: list[str]) -> DataFrame:
    """The ledger with the update's rows in place of its own of the same key."""
    return ledger.join(update.select(*keys).distinct(), keys, "left_anti").unionByName(update)


def newest(rows: DataFrame, keys: list[str], stamp: str, source: str) -> DataFrame:
    """For each key the row with the strictly newest stamp; of equal ones the first by source."""
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(stamp), source)))
    return ranked.where("__rank = 1").drop("__rank")


def totals(ledger: DataFrame) -> DataFrame:
    """servers, shards, slices, files, rows, bytes and done over ledger rows (server, shard, shards, files, rows, bytes, done)."""
    return ledger.agg(
        F.count_distinct("server").alias("servers"),
        F.count_distinct("shard").alias("shards"),
        F.max("shards").alias("slices"),
        *[F.sum(c).alias(c) for c in ("files", "rows", "bytes")],
        F.count_if("done").alias("done"),
    )


def not_done(work: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key the ledger lacks."""
    return work.join(ledger.select(*keys), keys, "left_anti")


def month_tally(rows: DataFrame) -> DataFrame:
    """rows, rows_2xx and rows_html by month (month, fetch_status, content_mime_detected)."""
    html = F.col("content_mime_detected").isin("text/html", "application/xhtml+xml")
    ok = F.col("fetch_status").between(200, 299)
    return rows.groupBy("month").agg(F.count("*").alias("rows"), F.count_if(ok).alias("rows_2xx"), F.count_if(html).alias("rows_html"))


def top_and_other(counts: DataFrame, name: str, n: int) -> DataFrame:
    """The n largest groups of (name, n), the rest as "other", and rows without a name as "none"."""
    named = counts.where(F.coalesce(F.col(name), F.lit("")) != "")
    top = named.orderBy(F.desc("n"), name).limit(n).select(name, "n", F.lit(0).alias("part"))
    rest = named.join(top.select(name), name, "left_anti").agg(F.sum("n").alias("n")).where("n is not null").select(F.lit("other").alias(name), "n", F.lit(1).alias("part"))
    none = counts.where(F.coalesce(F.col(name), F.lit("")) == "").agg(F.sum("n").alias("n")).where("n is not null").select(F.lit("none").alias(name), "n", F.lit(2).alias("part"))
    return top.unionAll(rest).unionAll(none)


def histogram(rows: DataFrame, value: str, bounds: list[float], by: list[str] | None = None) -> DataFrame:
    """Cumulative buckets le_<i> for each bound, sum and count."""
    found = [F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    return rows.groupBy(*(by or [])).agg(*found, F.sum(value).alias("sum"), F.count(value).alias("count"))


def error_classes(rows: DataFrame, message: str = "error", tls: bool = True) -> DataFrame:
    """class and n over failed fetches."""
    return rows.where(F.coalesce(F.col(message), F.lit("")) != "").groupBy(text.error_class(F.col(message), tls).alias("class")).agg(F.count("*").alias("n"))


def top_errors(rows: DataFrame, n: int, message: str = "error") -> DataFrame:
    """The n most frequent kinds of failure: fingerprint and n."""
    kinds = rows.select(text.error_fingerprint(F.col(message)).alias("fingerprint")).where("fingerprint <> ''")
    return kinds.groupBy("fingerprint").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "fingerprint").limit(n)


def run_shares(rows: DataFrame, phases: list[str]) -> DataFrame:
    """Busy and idle shares of runs (workers, wall, items, and seconds of each phase)."""
    busy = sum((F.coalesce(p, F.lit(0.0)) for p in phases[1:]), F.coalesce(phases[0], F.lit(0.0)))
    capacity = F.col("workers") * F.col("wall")
    share = lambda x: F.coalesce(F.try_divide(x, capacity), F.lit(0.0))
    return rows.select(
        "*",
        busy.alias("busy"),
        F.greatest(capacity - busy, F.lit(0.0)).alias("idle"),
        share(busy).alias("busy_share"),
        F.coalesce(F.try_divide(F.col("items"), F.col("wall")), F.lit(0.0)).alias("rate"),
        F.coalesce(F.try_divide(busy, F.col("items")), F.lit(0.0)).alias("per_item"),
    )


def progress(ledger: DataFrame, expected: int) -> DataFrame:
    """One row: elapsed seconds, shards and rows an hour, and hours left; null under a minute (first_committed, last_committed, rows)."""
    found = ledger.agg(F.count("*").alias("shards"), F.sum("rows").alias("rows"), (F.unix_timestamp(F.max("last_committed")) - F.unix_timestamp(F.min("first_committed"))).alias("elapsed"))
    hours = F.when(F.col("elapsed") >= 60, F.col("elapsed") / 3600)
    return found.select("shards", "rows", "elapsed", (F.col("shards") / hours).alias("shards_per_hour"), (F.col("rows") / hours).alias("rows_per_hour"), (F.greatest(expected - F.col("shards"), F.lit(0)) / (F.col("shards") / hours)).alias("hours_left"))


def reduction(before: Column, after: Column) -> Column:
    """By how many per cent after is smaller; 0 without a before."""
    return F.coalesce(F.try_divide(100.0 * (before - after), before), F.lit(0.0))


def library_usage(files: DataFrame) -> DataFrame:
    """files and bytes by crawl, kind and format, and a total row if there are several groups."""
    each = files.groupBy("crawl", "kind", "format").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    total = each.agg(F.count("*").alias("groups"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes")).where("groups > 1")
    return each.unionByName(total.select(F.lit("total").alias("crawl"), F.lit("").alias("kind"), F.lit("").alias("format"), "files", "bytes"))


def interleave(rows: DataFrame, host: str, sequence: str) -> DataFrame:
    """Rows with a position that takes one of each host a turn, hosts in order of their first row.

    Turns are partitioned by host; only the order of the result is global, as a range sort.
    """
    turn = F.row_number().over(Window.partitionBy(host).orderBy(sequence))
    first = F.min(sequence).over(Window.partitionBy(host))
    return rows.withColumns({"turn": turn, "host_first": first}).orderBy("turn", "host_first", sequence)


def spread(rows: DataFrame, host: str, sequence: str, most: int) -> DataFrame:
    """Rows with turns as interleave gives them, within each block of `most` numbers of the sequence: no more are ever held back."""
    block = F.floor(F.col(sequence) / most).cast("long")
    turns = Window.partitionBy("block", host)
    rows = rows.withColumn("block", block).withColumns({"turn": F.row_number().over(turns.orderBy(sequence)), "host_first": F.min(sequence).over(turns)})
    return rows.orderBy("block", "turn", "host_first", sequence)


def domain_url(domain: Column) -> Column:
    """Where a domain's work begins."""
    return F.concat(F.lit("https://"), domain, F.lit("/"))


def checkpoint(in_flight: DataFrame, source: str, shard: int) -> DataFrame:
    """source, shard, part and row: where a run of this work list goes on, its unfinished rows included."""
    return safe_checkpoint(in_flight).select(F.lit(source).alias("source"), F.lit(shard).alias("shard"), "part", "row")


def resume(work: DataFrame, mark: DataFrame, source: str, shard: int) -> DataFrame:
    """Work (part, row) from a checkpoint on, all of it without one; rows may come again. A checkpoint of other work is refused.

    The checkpoint is one row, read by the driver, so its bounds reach the scan.
    """
    at = mark.where("part is not null").first()
    if at is None:
        return work
    if (at["source"], at["shard"]) != (source, shard):
        raise ValueError(f"the checkpoint is of {at['source']}, shard {at['shard']}")
    part = F.col("part")
    return work.where((part > at["part"]) | ((part == at["part"]) & (F.col("row") >= at["row"])))


def changed_since(archived: DataFrame, live: DataFrame) -> DataFrame:
    """One row: pages in both (doc_id, markdown) and those whose text changed; live rows with an error are left out."""
    now = live.where("error = ''").select("doc_id", F.col("markdown").alias("__now"))
    both = archived.select("doc_id", "markdown").join(now, "doc_id")
    return both.agg(F.count("*").alias("pages"), F.count_if(F.col("markdown") != F.col("__now")).alias("changed"))


def projected(size: Column, done: Column, total: int) -> Column:
    """What all parts would hold if they are like those done; null before the first."""
    return size * F.try_divide(F.lit(float(total)), done)


def safe_checkpoint(in_flight: DataFrame) -> DataFrame:
    """The least (part, row) that is still being worked on."""
    return in_flight.agg(F.min(F.struct("part", "row")).alias("at")).select("at.part", "at.row")


def files_per_kind(manifests: DataFrame, kinds: list[str]) -> DataFrame:
    """kind and files over manifest lines (kind, path); -1 for a kind whose manifest could not be read."""
    wanted = manifests.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    counted = manifests.groupBy("kind").agg(F.count("*").alias("files"))
    return wanted.join(counted, "kind", "left").select("kind", F.coalesce("files", F.lit(-1)).alias("files"))
