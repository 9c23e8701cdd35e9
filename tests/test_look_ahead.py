"""Sliding turns against a plain walk over a list, and the run journal."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from weftline import queries
from weftline.operators import look_ahead
from weftline.streaming import journal


def plain(rows, workers, batch):
    """(number, host) rows in the order of turns: whole rounds are recounted at every step, with lists only."""
    out, held, served, at = [], [], set(), 0
    while True:
        while at < len(rows) and len({h for _, h in held}) < workers and len(held) < 16 * batch:
            held += rows[at : at + batch]
            at += batch
        if not held:
            return out
        if all(h in served for _, h in held):
            served = set()
        known = [h for h in order_of(held, out, served)]
        host = known[0]
        row = next(r for r in held if r[1] == host)
        held.remove(row)
        served.add(host)
        out.append(row)
        if not any(h == host for _, h in held):
            arrivals.pop(host)
            served.discard(host)


arrivals: dict = {}


def order_of(held, out, served):
    """Hosts that still have a turn in this round, in the order in which they came to be held."""
    for _, host in held:
        arrivals.setdefault(host, len(arrivals) + len(out) * 1_000_000)
    return sorted({h for _, h in held if h not in served}, key=lambda h: arrivals[h])


@pytest.mark.parametrize("hosts,workers,batch", [(1, 4, 3), (3, 8, 5), (40, 4, 10), (200, 16, 7), (5, 1, 1)])
def test_walk(hosts, workers, batch):
    rng = random.Random(hosts)
    rows = [(i, "hot" if rng.random() < 0.35 else rng.randrange(hosts)) for i in range(600)]
    arrivals.clear()
    assert list(look_ahead.walk(iter(rows), workers, batch)) == [n for n, _ in plain(rows, workers, batch)]


def test_held_rows_are_bounded():
    """A host with all the rows is never held whole."""
    most, held = 0, look_ahead.Held()
    read = iter((i, "hot") for i in range(10_000))
    put = held.put

    class Counted(look_ahead.Held):
        def put(self, host, number):
            nonlocal most
            super().put(host, number)
            most = max(most, self.n)

    look_ahead.Held, original = Counted, look_ahead.Held
    try:
        assert list(look_ahead.walk(read, 8, 20)) == list(range(10_000))
    finally:
        look_ahead.Held = original
    assert put and most <= 20 * 17


def test_spread(spark):
    rng = random.Random(5)
    rows = [(p, i, rng.choice(["hot", None, *"abcdefgh"]), f"x{i}") for p in (0, 1, None) for i in range(3000)]
    frame = spark.createDataFrame(rows, "part int, seq int, host string, extra string").repartition(5)
    got = look_ahead.spread(frame, "host", "seq", "part", workers=4, batch=16).collect()
    assert sorted((r["part"] is None, r["part"], r["seq"], r["extra"]) for r in got if r["part"] is not None) == sorted((False, p, i, x) for p, i, _, x in rows if p is not None)
    for p in (0, 1, None):
        own = sorted((r for r in got if r["part"] == p), key=lambda r: r["turn"])
        assert [r["turn"] for r in own] == list(range(3000))
        arrivals.clear()
        assert [r["seq"] for r in own] == [n for n, _ in plain([(i, h) for q, i, h, _ in rows if q == p], 4, 16)]
        assert [r["turn"] for r in got if r["part"] == p] == list(range(3000))
    assert look_ahead.spread(frame.limit(0), "host", "seq", "part", 4, 16).count() == 0
    with pytest.raises(ValueError):
        look_ahead.spread(frame.withColumn("turn", F.lit(1)), "host", "seq", "part", 4, 16)


def test_query(spark, sf_dir):
    """The registered query, whole, against the plain walk."""
    got = queries.queries()["spread_sliding"](spark, sf_dir).collect()
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id").orderBy("event_id").collect()
    assert len(got) == len(events)
    for part in {r["part"] for r in got}:
        arrivals.clear()
        own = [(r["event_id"], r["user_id"]) for r in events if r["event_id"] // 4096 == part]
        assert [r["event_id"] for r in sorted((r for r in got if r["part"] == part), key=lambda r: r["turn"])] == [n for n, _ in plain(own, 8, 64)]


def test_journal_of_a_stream(spark, tmp_path):
    folder, source, out = (str(tmp_path / n) for n in ("journal", "in", "out"))
    spark.range(300).repartition(3).write.parquet(source)
    heard = journal.Journal(folder, run="r1", total=600)
    spark.streams.addListener(heard)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-m").queryName("copy").trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(heard)
    heard.note("shard", shard=0, status="failed", error="lost")
    heard.note("shard", shard=0, status="ok", rows=5)
    heard.note("shard", shard=1, status="skipped")
    events = journal.read(spark, folder)
    kinds = [r["event"] for r in events.orderBy("number").collect()]
    assert kinds[0] == "start" and kinds.count("end") == 1 and kinds.count("tick") >= 3
    assert {r["name"] for r in events.where("event = 'tick'").collect()} == {"copy"}
    last = journal.rates(events).orderBy(F.desc("number")).first()
    assert last["done"] == 300 and (last["seconds_left"] is None) == (last["rate"] is None)
    row = journal.summary(events).first()
    assert (row["rows"], row["ended"], row["ok"], row["failed"], row["skipped"]) == (300, True, 1, 0, 1)
    assert {(r["shard"], r["status"], r["rows"]) for r in journal.shards(events).collect()} == {(0, "ok", 5), (1, "skipped", None)}
    day = str(events.first()["day"])
    journal.compact(spark, folder, day, str(tmp_path / "joined"))
    assert journal.read(spark, str(tmp_path / "joined")).count() == events.count()


def test_odd_journals(spark, tmp_path):
    folder = tmp_path / "j" / "day=2024-01-01"
    folder.mkdir(parents=True)
    lines = [
        {"ts": "2024-01-01T00:00:00Z", "event": "start", "run": "a", "number": 0},
        {"ts": "2024-01-01T00:00:10Z", "event": "tick", "run": "a", "number": 1, "rows": 50, "seconds": 10.0, "total": 150, "more": 1},
        {"ts": "2024-01-01T00:00:20Z", "event": "tick", "run": "a", "number": 2, "rows": 100, "seconds": 0.0, "total": 150},
        {"ts": "2024-01-01T00:00:00Z", "event": "tick", "run": "b", "number": 0},
        {"event": "tick", "run": "c"},
    ]
    (folder / "x.json").write_text("\n".join([*map(json.dumps, lines), "{broken", ""]))
    events = journal.read(spark, str(tmp_path / "j"))
    got = {(r["run"], r["number"]): r for r in journal.rates(events).collect()}
    first, second, bare = got["a", 1], got["a", 2], got["b", 0]
    assert (first["done"], first["rate"], first["tick_rate"], first["seconds_left"]) == (50, 18000.0, 18000.0, 20.0)
    assert (second["done"], second["rate"], second["tick_rate"], second["seconds_left"]) == (150, 27000.0, None, 0.0)
    assert (bare["done"], bare["rate"], bare["seconds_left"]) == (0, None, None) and len(got) == 3
    assert journal.rates(events.limit(0)).count() == 0
