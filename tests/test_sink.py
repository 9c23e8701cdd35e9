"""Published files, the capture sink, linked records and the other forms of archives."""

from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from weftline.functions import hashes, html
from weftline.sources import archives, published, sink, tables


def shards_of(folder):
    return [os.path.join(folder, f) for f in sorted(os.listdir(folder)) if f.endswith(".parquet")]


def test_published(tmp_path):
    folder = str(tmp_path / "p")
    os.makedirs(f"{folder}/below")
    job, other = published.new_job(), published.new_job()
    names = [published.new_name(j, ".gz") for j in (job, job, other)]
    for name in [*names, "foreign.gz", "below/foreign.gz", "x.txt"]:
        open(f"{folder}/{name}", "w").close()
    assert published.listing(folder, ".gz")[0] == [f"{folder}/below/foreign.gz", f"{folder}/foreign.gz"]
    assert published.publish(folder, names[:2], job)
    assert not published.publish(folder, names, job)  # what was published under a key stays as it is
    seen, left = published.listing(f"file://{folder}", ".gz")
    assert set(seen) == {f"file://{folder}/{n}" for n in (*names[:2], "foreign.gz", "below/foreign.gz")}
    assert left == [f"file://{folder}/{names[2]}"]
    published.discard(folder, [names[2], "never.gz"])
    assert published.listing(folder, ".gz")[1] == []
    assert published.listing(str(tmp_path / "none"), ".gz") == ([], [])


def test_shards_close_by_encoded_bytes(tmp_path):
    """Every shard but a task's last has its bytes; none is longer than them by more than a row group; rows keep their order."""
    folder, target, group = str(tmp_path / "s"), 20_000, 5_000
    os.makedirs(folder)
    made = sink.Shards(folder, published.new_job(), target, group)
    values = [os.urandom(n) if n else None for n in [10, 0, 300, 9_000, 1, 70_000, 4_999, 5_000, 5_001, *range(1, 400)]]
    for at in range(0, len(values), 50):
        made.add(pa.RecordBatch.from_pydict({"n": pa.array(range(at, min(at + 50, len(values)))), "body": pa.array(values[at : at + 50], pa.binary())}))
    made.finish()
    paths = [f"{folder}/{n}" for n in made.names]
    assert len(paths) > 3
    assert pa.concat_tables([pq.read_table(p) for p in paths]).to_pylist() == [{"n": i, "body": v} for i, v in enumerate(values)]
    for path in paths:
        meta = pq.read_metadata(path)
        sizes = [meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)]
        assert sum(sizes[:-1]) < target + 1000 * len(sizes)
    assert all(os.path.getsize(p) >= target for p in paths[:-1])


def test_sink(spark, tmp_path):
    sink.register(spark)
    folder = str(tmp_path / "sink")
    rows = spark.range(2000, numPartitions=3).select("id", F.sha2(F.col("id").cast("string"), 256).alias("payload"), F.when(F.col("id") % 2 == 0, F.array("id")).alias("names"), F.lit(1).alias("__row"))
    options = {"target_bytes": "20000", "group_bytes": "8000"}
    for _ in range(2):
        rows.write.format("captures_sink").mode("append").options(**options).save(folder)
    assert len(os.listdir(f"{folder}/_published")) == 2 and len(shards_of(folder)) > 6
    back = sink.read(spark, folder, rows.schema)
    assert back.exceptAll(rows).exceptAll(rows).count() == 0 and back.count() == 4000
    rows.limit(0).write.format("captures_sink").mode("append").save(folder)
    assert len(os.listdir(f"{folder}/_published")) == 3 and sink.read(spark, folder, rows.schema).count() == 4000
    assert sink.read(spark, str(tmp_path / "none"), "a int").count() == 0
    # what a lost task leaves is never read
    os.link(shards_of(folder)[0], f"{folder}/{published.new_name(published.new_job(), '.parquet')}")
    assert sink.read(spark, folder, rows.schema).count() == 4000
    assert published.sweep(folder, ".parquet") == 1 and published.sweep(folder, ".parquet") == 0
    assert sink.read(spark, folder, rows.schema).count() == 4000


def test_failed_job_shows_nothing(spark, tmp_path):
    """A job of which a task fails half-way publishes nothing; what its killed tasks still write after the abort isn't read and can be swept."""
    sink.register(spark)
    archives.register(spark)
    folder, archive = str(tmp_path / "sink"), str(tmp_path / "archive")
    broken = F.when(F.col("id") == 1900, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long")
    rows = spark.range(2000, numPartitions=2).select(broken.alias("id"))
    with pytest.raises(Exception, match="broken"):
        rows.write.format("captures_sink").mode("append").option("target_bytes", "500").option("group_bytes", "100").save(folder)
    assert not os.path.exists(f"{folder}/_published") and sink.read(spark, folder, "id long").count() == 0
    with pytest.raises(Exception, match="broken"):
        rows.select(F.col("id").cast("string").alias("url"), F.lit(b"x").alias("block")).write.format("warc").mode("append").option("max_bytes", "500").save(archive)
    assert archives.read_warc(spark, archive).count() == 0


def test_tasks_and_jobs_clear_up(tmp_path):
    folder = str(tmp_path / "s")
    batch = pa.RecordBatch.from_pydict({"a": list(range(100))})

    def broken():
        yield batch
        raise RuntimeError("lost")

    options = {"path": folder, "target_bytes": "10", "group_bytes": "80"}
    writer, other = sink._Writer(options), sink._Writer(options)
    with pytest.raises(RuntimeError):
        writer.write(broken())
    assert shards_of(folder) == []
    other.commit([other.write(iter([batch]))])
    sealed = shards_of(folder)
    writer.write(iter([batch]))  # a task whose message never arrived
    assert len(shards_of(folder)) == 2 * len(sealed) == 20
    writer.abort([None])
    assert shards_of(folder) == sealed


def test_batch_again(tmp_path):
    """A batch of a stream that is committed again keeps the first list; the second try's shards are deleted."""
    folder = str(tmp_path / "s")
    os.makedirs(folder)
    batch = pa.RecordBatch.from_pydict({"a": [1, 2, 3]})
    for expected in (1, 1):
        writer = sink.CaptureSink.streamWriter(type("S", (DataSource,), {"name": classmethod(lambda c: "s")})({"path": folder}), None, False)
        writer.commit([writer.write(iter([batch])), None], 7)
        assert len(shards_of(folder)) == expected
    assert os.listdir(f"{folder}/_published") == ["stream-7.json"]
    writer.commit([writer.write(iter([batch]))], 8)
    assert len(published.listing(folder, ".parquet")[0]) == 2


def test_sink_stream(spark, tmp_path):
    sink.register(spark)
    source, folder, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for turn in range(2):
        spark.range(turn * 100, turn * 100 + 100).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        stream.writeStream.format("captures_sink").option("path", folder).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    assert sorted(os.listdir(f"{folder}/_published")) == ["stream-0.json", "stream-1.json"]
    assert sorted(r["id"] for r in sink.read(spark, folder, "id long").collect()) == list(range(200))


def test_pairs(spark, tmp_path):
    """Odd rows: no request, an empty block, nulls, a row longer than a file."""
    archives.register(spark)
    folder = str(tmp_path / "w")
    ok = b"HTTP/1.1 200 OK\r\n\r\n"
    rows = [("http://a/", b"GET / HTTP/1.1\r\n\r\n", ok + b"one", None, "1.2.3.4"), ("http://b/", None, ok + b"two", "length", None), ("http://c/", b"GET /c\r\n\r\n", None, None, None), ("http://d/", b"GET /d\r\n\r\n", ok + os.urandom(5000), "time", None)]
    frame = spark.createDataFrame(rows, "url string, request binary, block binary, truncated string, ip string").coalesce(1)
    frame.write.format("warc").mode("append").option("max_bytes", "2000").save(folder)
    records = archives.read_warc(spark, folder).cache()
    got = {(r["type"], r["url"]): r for r in records.where("type <> 'warcinfo'").collect()}
    assert len(got) == 7
    infos = {r["filename"]: r["record_id"] for r in records.where("type = 'warcinfo'").collect()}
    assert len(infos) == 2
    for (kind, url), r in got.items():
        assert r["warcinfo_id"] == infos[r["filename"]]
        other = got.get(("request" if kind == "response" else "response", url))
        assert r["concurrent_to"] == (other["record_id"] if other else "")
        assert other is None or other["filename"] == r["filename"]
        assert r["block_digest"] == archives.digest(bytes(r["block"] or b""))
    assert got["response", "http://a/"]["payload_digest"] == archives.digest(b"one") and got["response", "http://a/"]["ip"] == "1.2.3.4"
    assert (got["response", "http://b/"]["truncated"], got["response", "http://a/"]["truncated"]) == ("length", "")
    assert {r["url"] for r in archives.pairs(records).collect()} == {"http://a/", "http://c/", "http://d/"}
    records.unpersist()


def test_sha1_base32(spark):
    data = [b"", b"abc", os.urandom(3000), None]
    got = spark.createDataFrame([(d,) for d in data], "d binary").select("d", hashes.sha1_base32(F.col("d")).alias("h")).collect()
    assert [r["h"] for r in got] == [archives.digest(d) if d is not None else None for d in data]


def test_convert_as(spark, tmp_path):
    folder = tmp_path / "x"
    folder.mkdir()
    (folder / "t.wet.gz").write_bytes(archives.member({"WARC-Type": "conversion", "WARC-Target-URI": "http://a/"}, b" text "))
    records = archives.read_warc(spark, str(folder))
    assert [r["text"] for r in archives.convert_as(records, archives.kind_of("t.wet.gz"), html.markdown).collect()] == ["text"]
    assert archives.convert_as(records, "wat", html.markdown).dtypes[-2:] == [("links", "string"), ("links_count", "int")]
    assert [(r["type"], r["title"]) for r in archives.convert_as(records, "warc", html.markdown).collect()] == [("conversion", "")]
    with pytest.raises(ValueError):
        archives.convert_as(records, "zip", html.markdown)


def test_headed(spark):
    rows = spark.createDataFrame([("a", 1), ("long|er", None), ("two\nlines", 30)], "x string, `n.b` int").coalesce(1)
    lines = lambda how: [r["value"] for r in tables.headed(rows, how).collect()]
    assert lines("table") == lines("auto") == ["x          n.b", "a          1", "long|er", "two lines  30"]
    simple = rows.select("x", F.col("`n.b`").alias("n"))
    assert [r["value"] for r in tables.headed(simple, "markdown").collect()][:3] == ["| x | n |", "| --- | --- |", "| a | 1 |"]
    assert [r["value"] for r in tables.headed(simple, "csv").collect()][:2] == ["x,n", "a,1"]
    assert [r["value"] for r in tables.headed(simple.limit(0), "tsv").collect()] == ["x\tn"]
    assert [r["value"] for r in tables.headed(simple.limit(0), "table").collect()] == ["x  n"]
