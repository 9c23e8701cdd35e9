"""A run's journal: what its streams and its steps did, as JSON lines that outlive it, and rates and time left from them.

    journal = Journal(folder, total=1_000_000)
    spark.streams.addListener(journal)          # start, a tick for each micro-batch, end
    journal.note("shard", shard=7, status="ok", rows=1200)
    journal.rates(journal.read(spark, folder))

Object stores can't append, so each event is a file of one line, under its day; a crash loses nothing that was noted. `compact` joins the files of past days.

Edge cases: events of several runs are told apart by `run`; a run without ticks has no rates; rates are null before the first second has passed, the time left is null without a total or a rate and 0 once
all is done; of a shard's events the newest counts, of equal times the last noted; lines that aren't JSON are rows of nulls and count nowhere; fields that aren't in SCHEMA aren't read.
"""

from __future__ import annotations

import json
import threading
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from weftline.sources.published import file_system

SCHEMA = "ts timestamp, event string, run string, number long, name string, shard int, status string, error string, batch long, rows long, bytes long, seconds double, total long"


class Journal(StreamingQueryListener):
    """Events of one run, noted by its steps or heard from its streams."""

    def __init__(self, folder: str, run: str | None = None, total: int | None = None):
        self.folder, self.run, self.total = folder.rstrip("/"), run or uuid.uuid4().hex, total
        self.number, self.lock = 0, threading.Lock()

    def note(self, event: str, **fields: object) -> None:
        now = datetime.now(UTC)
        with self.lock:
            number, self.number = self.number, self.number + 1
        line = {"ts": now.strftime("%Y-%m-%dT%H:%M:%S.%fZ"), "event": event, "run": self.run, "number": number, "total": self.total} | fields
        system, inside = file_system(f"{self.folder}/day={now:%Y-%m-%d}")
        system.create_dir(inside, recursive=True)
        with system.open_output_stream(f"{inside}/{self.run}-{number:09d}.json", compression=None) as out:
            out.write(json.dumps({k: v for k, v in line.items() if v is not None}).encode() + b"\n")

    def onQueryStarted(self, event) -> None:
        self.note("start", name=event.name or str(event.id))

    def onQueryProgress(self, event) -> None:
        own = event.progress
        self.note("tick", name=own.name or str(own.id), batch=own.batchId, rows=own.numInputRows, seconds=own.durationMs.get("triggerExecution", 0) / 1000)

    def onQueryIdle(self, event) -> None:
        """Nothing happened, so nothing is noted."""

    def onQueryTerminated(self, event) -> None:
        self.note("end", name=str(event.id), status="failed" if event.exception else "ok", error=event.exception)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All events, with the day they are filed under."""
    return spark.read.schema(f"{SCHEMA}, day date").json(folder)


def rates(events: DataFrame) -> DataFrame:
    """Each tick with the run's rows so far (done), seconds since its first event (elapsed), rows an hour since then and in this tick, and seconds left."""
    order = Window.partitionBy("run").orderBy("ts", "number")
    passed = (F.unix_micros("ts") - F.unix_micros(F.min("ts").over(order))) / 1e6
    done = F.sum(F.when(F.col("event") == "tick", F.coalesce("rows", F.lit(0))).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    seen = events.where("ts is not null").select("run", "number", "ts", "event", "rows", "seconds", "total", done.alias("done"), passed.alias("elapsed"))
    rate = F.when(F.col("elapsed") >= 1, F.col("done") * 3600 / F.col("elapsed"))
    left = F.when(F.col("total") > F.col("done"), F.col("total") - F.col("done")).when(F.col("total").isNotNull(), 0)
    ticks = seen.where("event = 'tick'").withColumn("rate", rate)
    return ticks.select(
        "run", "number", "ts", "rows", "done", "elapsed", "rate",
        F.try_divide(F.col("rows") * 3600, F.col("seconds")).alias("tick_rate"),
        F.when(left == 0, F.lit(0.0)).otherwise(F.try_divide(left * 3600, "rate")).alias("seconds_left"),
    )


def shards(events: DataFrame) -> DataFrame:
    """The newest outcome of each shard of each run: run, shard, status, error, rows."""
    newest = F.max_by(F.struct("status", "error", "rows"), F.struct("ts", "number")).alias("last")
    return events.where("event = 'shard' and shard is not null and ts is not null").groupBy("run", "shard").agg(newest).select("run", "shard", "last.*")


def summary(events: DataFrame) -> DataFrame:
    """A row for each run: rows, ticks, shards by outcome, and whether it ended."""
    outcome = lambda s: F.count_if(F.col("status") == s)
    tick = F.col("event") == "tick"
    totals = events.where("ts is not null").groupBy("run").agg(F.sum(F.when(tick, F.col("rows")).otherwise(0)).alias("rows"), F.count_if(tick).alias("ticks"), F.bool_or(F.col("event") == "end").alias("ended"))
    by_shard = shards(events).groupBy("run").agg(outcome("ok").alias("ok"), outcome("failed").alias("failed"), outcome("skipped").alias("skipped"))
    return totals.join(by_shard, "run", "left").na.fill(0, ["ok", "failed", "skipped"])


def compact(spark: SparkSession, folder: str, day: str, into: str) -> None:
    """The events of a day as one file under another folder, in the same layout."""
    read(spark, folder).where(F.col("day") == F.lit(day).cast("date")).drop("day").coalesce(1).write.mode("overwrite").json(f"{into.rstrip('/')}/day={day}")
