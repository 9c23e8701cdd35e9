"""Event-time operators, as batches here (tests run the same functions as streams), and a stream through the capture sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.queries.registry import query
from weftline.queries.archives import new_folder
from weftline.session import table
from weftline.sources import sink
from weftline.streaming import events


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    return events.tumbling(table(spark, sf_dir, "events"), "1 hour", ["event_type"]).withColumn("total", F.round("total", 4))


@query("WITH e AS (SELECT event_type, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS start FROM events) SELECT start, event_type, count(*) AS n FROM e GROUP BY 1, 2")
def stream_sliding(spark, sf_dir):
    return events.sliding(table(spark, sf_dir, "events"), "1 hour", "30 minutes", ["event_type"])


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) "
    'SELECT min(ts) AS start, max(ts) + INTERVAL \'30 minutes\' AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k'
)
def stream_sessions(spark, sf_dir):
    return events.sessions(table(spark, sf_dir, "events"), "30 minutes", ["user_id"])


@query("SELECT user_id FROM events GROUP BY user_id")
def stream_first_seen(spark, sf_dir):
    return events.first_seen(table(spark, sf_dir, "events").select("user_id"), "user_id")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_sealed(spark, sf_dir):
    """Events streamed from their files into the capture sink, which seals each batch's shards together."""
    sink.register(spark)
    source, out = new_folder(spark, "arriving"), new_folder(spark, "stream-sealed")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    rows.repartition(4).write.parquet(source)
    running = (
        events.read_stream(spark, source, rows.schema).writeStream.format("captures_sink").option("path", out).option("target_bytes", str(16 << 20))
        .option("checkpointLocation", f"{out}-mark").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return sink.read(spark, out, rows.schema)
