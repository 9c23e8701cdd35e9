"""Queries over ledgers, tallies, ranges and run statistics, derived from events, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import ledger, ranges
from weftline.plans import corpus
from weftline.queries.index import index
from weftline.queries.registry import query
from weftline.session import table
from weftline.sources import captures
from weftline.streaming import journal

LEDGER = """WITH led AS (SELECT 'server' || (o_custkey % 5) AS server, (o_orderkey % 40)::BIGINT AS shard, 40::BIGINT AS shards, (o_orderkey % 3)::BIGINT AS files, (o_orderkey % 1000)::BIGINT AS "rows", o_orderkey * 10 AS bytes,
    o_orderkey % 2 = 0 AS done, o_orderdate AS first_committed, o_orderdate + to_seconds(o_custkey) AS last_committed, o_orderkey FROM orders)
"""


def led(spark, sf_dir):
    """Ledger rows from orders."""
    o = table(spark, sf_dir, "orders")
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        F.concat(F.lit("server"), (customer % 5).cast("string")).alias("server"), (key % 40).alias("shard"), F.lit(40).cast("long").alias("shards"), (key % 3).alias("files"), (key % 1000).alias("rows"),
        (key * 10).alias("bytes"), (key % 2 == 0).alias("done"), F.col("o_orderdate").alias("first_committed"), (F.col("o_orderdate") + F.make_dt_interval(secs=customer)).alias("last_committed"), "o_orderkey",
    )


@query(LEDGER + "SELECT server, shard, o_orderkey, last_committed FROM (SELECT *, row_number() OVER (PARTITION BY server, shard ORDER BY last_committed DESC, o_orderkey) AS rn FROM led) WHERE rn = 1")
def ledger_newest(spark, sf_dir):
    """The newest row of each server and shard."""
    return ledger.newest(led(spark, sf_dir), ["server", "shard"], "last_committed", "o_orderkey").select("server", "shard", "o_orderkey", "last_committed")


@query(LEDGER + "SELECT server, shard, \"rows\" FROM (SELECT DISTINCT server, shard, 1::BIGINT AS \"rows\" FROM led WHERE shard < 30) WHERE shard < 20 UNION ALL SELECT server, shard, 2 FROM (SELECT DISTINCT server, shard FROM led WHERE shard >= 20)")
def ledger_upsert(spark, sf_dir):
    """Rows of the same key are replaced, others added."""
    keys = led(spark, sf_dir).select("server", "shard").distinct()
    old = keys.where("shard < 30").withColumn("rows", F.lit(1).cast("long"))
    return ledger.upsert(old, keys.where("shard >= 20").withColumn("rows", F.lit(2).cast("long")), ["server", "shard"])


@query(LEDGER + "SELECT count(DISTINCT server) AS servers, count(DISTINCT shard) AS shards, max(shards) AS slices, sum(files)::BIGINT AS files, sum(\"rows\")::BIGINT AS \"rows\", sum(bytes)::BIGINT AS bytes, count(*) FILTER (WHERE done) AS done FROM led")
def ledger_totals(spark, sf_dir):
    return ledger.totals(led(spark, sf_dir))


@query(LEDGER + "SELECT count(*) AS shards, sum(\"rows\")::BIGINT AS \"rows\", (epoch(max(last_committed)) - epoch(min(first_committed)))::BIGINT AS elapsed, round(count(*) / ((epoch(max(last_committed)) - epoch(min(first_committed))) / 3600), 6) AS shards_per_hour FROM led")
def ledger_progress(spark, sf_dir):
    found = ledger.progress(led(spark, sf_dir), 1_000_000)
    return found.select("shards", "rows", "elapsed", F.round("shards_per_hour", 6).alias("shards_per_hour"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def ledger_not_done(spark, sf_dir):
    """Work whose key is not in the ledger."""
    work = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey")
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"))
    return ledger.not_done(work, done, ["key"]).select(F.col("key").alias("o_orderkey"), "o_custkey")


@query(captures.SQL + "SELECT substr(timestamp, 1, 6) AS month, count(*) AS \"rows\", count(*) FILTER (WHERE fetch_status BETWEEN 200 AND 299) AS rows_2xx, count(*) FILTER (WHERE content_mime_detected IN ('text/html', 'application/xhtml+xml')) AS rows_html FROM captures GROUP BY 1")
def month_tally(spark, sf_dir):
    return ledger.month_tally(index(spark, sf_dir).withColumn("month", F.substring("timestamp", 1, 6)))


@query(captures.SQL + ", c AS (SELECT content_languages AS language, count(*) AS n FROM captures GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, language) AS rn FROM c WHERE coalesce(language, '') <> '') SELECT language, n, 0 AS part FROM r WHERE rn <= 2 UNION ALL SELECT 'other', sum(n)::BIGINT, 1 FROM r WHERE rn > 2 HAVING sum(n) IS NOT NULL UNION ALL SELECT 'none', sum(n)::BIGINT, 2 FROM c WHERE coalesce(language, '') = '' HAVING sum(n) IS NOT NULL")
def language_bars(spark, sf_dir):
    """The two largest, the rest, and those without."""
    counts = index(spark, sf_dir).groupBy(F.col("content_languages").alias("language")).agg(F.count("*").alias("n"))
    return ledger.top_and_other(counts, "language", 2)


@query("SELECT event_type, count(*) FILTER (WHERE value <= 1) AS le_0, count(*) FILTER (WHERE value <= 10) AS le_1, count(*) FILTER (WHERE value <= 100) AS le_2, round(sum(value), 4) AS sum, count(value) AS count FROM events GROUP BY 1")
def histogram_values(spark, sf_dir):
    found = ledger.histogram(table(spark, sf_dir, "events"), "value", [1, 10, 100], ["event_type"])
    return found.withColumn("sum", F.round("sum", 4))


MESSAGES = ("dial tcp 10.0.0.7:443: connection refused", 'Get "https://a.example/x?y=1": context deadline exceeded', "lookup b.example: no such host", "x509: certificate has expired or is not yet valid", "host congested, skip", "unexpected EOF after 512 bytes", "")
ERRORS = "WITH e AS (SELECT event_id, [" + ", ".join("'" + m.replace("'", "''") + "'" for m in MESSAGES) + "][(event_id % 7)::INT + 1] AS error FROM events)\n"
CLASS = "CASE WHEN error LIKE '%no such host%' THEN 'dns' WHEN error LIKE '%deadline exceeded%' THEN 'timeout' WHEN error LIKE '%connection refused%' THEN 'refused' WHEN error LIKE '%skip%' OR error LIKE '%congested%' THEN 'skip' WHEN error LIKE '%x509:%' THEN 'tls' ELSE 'other' END"


def errors(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.array(*[F.lit(m) for m in MESSAGES])[(F.col("event_id") % 7).cast("int")].alias("error"))


@query(ERRORS + f"SELECT {CLASS} AS class, count(*) AS n FROM e WHERE error <> '' GROUP BY 1")
def error_classes(spark, sf_dir):
    return ledger.error_classes(errors(spark, sf_dir))


@query(ERRORS + ", f AS (SELECT CASE event_id % 7 WHEN 0 THEN 'dial tcp N connection refused' WHEN 1 THEN 'context deadline exceeded' WHEN 2 THEN 'lookup b.example: no such host' WHEN 3 THEN 'N certificate has expired or is not yet valid' WHEN 4 THEN 'host congested, skip' WHEN 5 THEN 'unexpected eof after N bytes' END AS fingerprint FROM e) SELECT fingerprint, count(*) AS n FROM f WHERE fingerprint IS NOT NULL GROUP BY 1 ORDER BY n DESC, fingerprint LIMIT 3")
def error_fingerprints(spark, sf_dir):
    return ledger.top_errors(errors(spark, sf_dir), 3)


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS turn_rank, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations")
def interleave_turns(spark, sf_dir):
    """One row of each conversation in a turn."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"))
    return ledger.interleave(rows, "conv_id", "seq").select("conv_id", F.col("seq").alias("turn"), F.col("turn").alias("turn_rank"), F.col("host_first").alias("first"))


@query(captures.SQL + "SELECT min(fetch_status)::INT AS part, (SELECT min(page_id) FROM captures WHERE fetch_status = 200) AS \"row\" FROM captures")
def safe_checkpoint(spark, sf_dir):
    return ledger.safe_checkpoint(index(spark, sf_dir).select(F.col("fetch_status").alias("part"), F.col("page_id").alias("row")))


@query(
    "WITH r AS (SELECT s_suppkey, (s_nationkey + 1)::DOUBLE AS workers, (s_suppkey * 2)::DOUBLE AS wall, s_suppkey * 100 AS items, (s_suppkey % 7)::DOUBLE AS get, (s_suppkey % 5)::DOUBLE AS parse FROM supplier) "
    "SELECT s_suppkey, get + parse AS busy, greatest(workers * wall - get - parse, 0) AS idle, round(coalesce((get + parse) / nullif(workers * wall, 0), 0), 9) AS busy_share, round(coalesce(items / nullif(wall, 0), 0), 9) AS rate FROM r"
)
def run_shares(spark, sf_dir):
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") + 1).cast("double").alias("workers"), (key * 2).cast("double").alias("wall"), (key * 100).alias("items"), (key % 7).cast("double").alias("fetch"), (key % 5).cast("double").alias("parse"))
    found = ledger.run_shares(rows, ["fetch", "parse"])
    return found.select("s_suppkey", "busy", "idle", F.round("busy_share", 9).alias("busy_share"), F.round("rate", 9).alias("rate"))


@query("WITH f AS (SELECT 'c' || (p_partkey % 3) AS crawl, p_brand AS kind, 'parquet' AS format, p_size AS bytes FROM part), g AS (SELECT crawl, kind, format, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM f GROUP BY ALL) SELECT * FROM g UNION ALL SELECT 'total', '', '', sum(files)::BIGINT, sum(bytes)::BIGINT FROM g HAVING count(*) > 1")
def library_usage(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("c"), (F.col("p_partkey") % 3).cast("string")).alias("crawl"), F.col("p_brand").alias("kind"), F.lit("parquet").alias("format"), F.col("p_size").alias("bytes"))
    return ledger.library_usage(rows)


@query(
    "WITH RECURSIVE r AS (SELECT 'part-' || (page_id % 5) AS filename, page_id * 1000 AS s, page_id * 1000 + strlen(html) AS e, row_number() OVER (PARTITION BY page_id % 5 ORDER BY page_id) AS rn FROM pages), "
    "g AS (SELECT filename, rn, s AS gs, e AS ge, 1 AS gid FROM r WHERE rn = 1 UNION ALL "
    "SELECT filename, rn, CASE WHEN fits THEN gs ELSE s END, CASE WHEN fits THEN greatest(ge, e) ELSE e END, CASE WHEN fits THEN gid ELSE gid + 1 END "
    "FROM (SELECT r.filename, r.rn, s, e, gs, ge, gid, s - ge <= 4000 AND greatest(e, ge) - gs <= 50000 AS fits FROM g JOIN r ON r.filename = g.filename AND r.rn = g.rn + 1)) "
    "SELECT filename, min(gs)::BIGINT AS group_start, max(ge)::BIGINT AS group_end, count(*) AS n FROM g GROUP BY filename, gid"
)
def ranges_coalesced(spark, sf_dir):
    """Byte ranges joined across small holes."""
    rows = index(spark, sf_dir).select(F.col("warc_filename").alias("filename"), F.col("warc_record_offset").alias("offset"), F.col("warc_record_length").alias("length"))
    return ranges.coalesce_ranges(rows, gap=4000, most=50_000)


@query(captures.SQL + "SELECT url AS path FROM captures WHERE contains(url, '/en/') ORDER BY url LIMIT 30")
def manifest_slice(spark, sf_dir):
    return ranges.manifest_slice(index(spark, sf_dir).select(F.col("url").alias("path")), "/en/", limit=30)


@query("SELECT kind, files FROM (SELECT p_brand AS kind, count(*) AS files FROM part WHERE p_brand IN ('Brand#11', 'Brand#12') GROUP BY 1) UNION ALL SELECT 'none', -1")
def files_per_kind(spark, sf_dir):
    rows = table(spark, sf_dir, "part").where("p_brand in ('Brand#11', 'Brand#12')").select(F.col("p_brand").alias("kind"), F.col("p_name").alias("path"))
    kinds = [r["kind"] for r in rows.select("kind").distinct().collect()]
    return ledger.files_per_kind(rows, [*kinds, "none"])


@query("SELECT s_suppkey, round(coalesce(100.0 * (s_suppkey * 7 - s_nationkey) / nullif(s_suppkey * 7, 0), 0), 6)::DOUBLE AS reduction FROM supplier")
def size_reduction(spark, sf_dir):
    before = F.col("s_suppkey") * 7
    found = ledger.reduction(before, F.col("s_nationkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(found.cast("double"), 6).alias("reduction"))


@query("SELECT event_type, count(*) FILTER (WHERE event_id % 5 = 0) AS failed, count(*) FILTER (WHERE event_id % 5 <> 0) AS ok FROM events GROUP BY 1")
def fetch_outcomes(spark, sf_dir):
    """Failures stay rows of the stream, so counts count attempts."""
    rows = table(spark, sf_dir, "events").withColumn("error", F.when(F.col("event_id") % 5 == 0, "timeout"))
    return corpus.outcomes(rows).groupBy("event_type").agg(F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("outcome") == "ok").alias("ok"))


NOTES = """WITH notes AS (SELECT ts, event_id AS number, 'run' || (user_id % 100) AS run, CASE WHEN event_id % 50 = 0 THEN 'end' WHEN event_id % 3 = 0 THEN 'shard' ELSE 'tick' END AS event, event_id % 1000 AS "rows", (user_id % 20)::INT AS shard,
    CASE event_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'ok' END AS status, (event_id % 60)::DOUBLE AS seconds, 400000::BIGINT AS total FROM events)
"""


def notes(spark, sf_dir):
    """Journal events from the stream's table: a hundred runs with ticks, shards and ends."""
    key, user = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), key.alias("number"), F.concat(F.lit("run"), (user % 100).cast("string")).alias("run"), F.when(key % 50 == 0, "end").when(key % 3 == 0, "shard").otherwise("tick").alias("event"),
        (key % 1000).alias("rows"), (user % 20).cast("int").alias("shard"), F.when(key % 4 == 0, "failed").when(key % 4 == 1, "skipped").otherwise("ok").alias("status"), F.lit(None).cast("string").alias("error"),
        (key % 60).cast("double").alias("seconds"), F.lit(400000).cast("long").alias("total"),
    )


@query(
    NOTES + """, seen AS (SELECT *, (epoch_us(ts) - epoch_us(min(ts) OVER w)) / 1e6 AS elapsed, sum(CASE WHEN event = 'tick' THEN "rows" ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS done FROM notes WINDOW w AS (PARTITION BY run ORDER BY ts, number)),
    r AS (SELECT *, CASE WHEN elapsed >= 1 THEN done * 3600 / elapsed END AS rate FROM seen WHERE event = 'tick')
    SELECT run, number, done, round(rate, 4) AS rate, round(CASE WHEN seconds > 0 THEN "rows" * 3600 / seconds END, 4) AS tick_rate, round(CASE WHEN done >= total THEN 0.0 WHEN rate > 0 THEN (total - done) * 3600 / rate END, 4) AS seconds_left FROM r"""
)
def journal_rates(spark, sf_dir):
    """Rates and the time left at each tick of a run's journal."""
    found = journal.rates(notes(spark, sf_dir))
    return found.select("run", "number", "done", *[F.round(c, 4).alias(c) for c in ("rate", "tick_rate", "seconds_left")])


@query(
    NOTES + """, last AS (SELECT run, shard, status FROM notes WHERE event = 'shard' QUALIFY row_number() OVER (PARTITION BY run, shard ORDER BY ts DESC, number DESC) = 1),
    s AS (SELECT run, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped FROM last GROUP BY run),
    t AS (SELECT run, sum(CASE WHEN event = 'tick' THEN "rows" ELSE 0 END)::BIGINT AS "rows", count(*) FILTER (WHERE event = 'tick') AS ticks, bool_or(event = 'end') AS ended FROM notes GROUP BY run)
    SELECT run, "rows", ticks, ended, coalesce(ok, 0) AS ok, coalesce(failed, 0) AS failed, coalesce(skipped, 0) AS skipped FROM t LEFT JOIN s USING (run)"""
)
def journal_summary(spark, sf_dir):
    """What each run did, by the newest outcome of its shards."""
    return journal.summary(notes(spark, sf_dir))
