"""The work list as a stream: batches, a kill and a resume, foreign checkpoints, shards, and what a resumed run reads."""

from __future__ import annotations

import json
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from weftline.streaming import worklist


@pytest.fixture()
def listed(tmp_path):
    """Three parts of 25, 0 and 30 rows, in row groups of 10; part 10 comes after part 9."""
    folder = tmp_path / "list"
    folder.mkdir()
    for name, start, n in (("part-2.parquet", 0, 25), ("part-9.parquet", 25, 0), ("part-10.parquet", 25, 30)):
        rows = pa.table({"domain": [f"d{i}.example" for i in range(start, start + n)], "value": list(range(n)), "part": ["x"] * n}, schema=pa.schema([("domain", pa.string()), ("value", pa.int64()), ("part", pa.string())]))
        pq.write_table(rows, folder / name, row_group_size=10)
    return str(folder)


def run(spark, folder, checkpoint, fail_at=None, **how):
    """The batches that a query takes until there is no more, or until one fails."""
    taken = []

    def take(batch, number):
        rows = [(r["part"], r["row"], r["value"], r["url"]) for r in batch.collect()]
        if number == fail_at:
            raise RuntimeError("killed")
        taken.append(rows)

    query = worklist.read(spark, folder, checkpoint, **how).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return taken


EXPECTED = [(0, i, f"d{i}.example", f"https://d{i}.example/") for i in range(25)] + [(2, i, f"d{25 + i}.example", f"https://d{25 + i}.example/") for i in range(30)]


def test_batches_in_order(spark, listed, tmp_path):
    taken = run(spark, listed, str(tmp_path / "c"), rows_per_batch=12)
    assert [len(t) for t in taken] == [12, 12, 12, 12, 7]
    assert [r for t in taken for r in sorted(t)] == EXPECTED


def test_kill_and_resume(spark, listed, tmp_path):
    """The batch that was killed comes again, whole; what was finished before doesn't."""
    checkpoint = str(tmp_path / "c")
    with pytest.raises(Exception, match="killed"):
        run(spark, listed, checkpoint, fail_at=2, rows_per_batch=12)
    state = json.loads((tmp_path / "c" / "worklist.json").read_text())
    assert (state["part"], state["row"]) == (2, 11)
    again = run(spark, listed, checkpoint, rows_per_batch=20)
    assert [sorted(t) for t in again] == [EXPECTED[24:36], EXPECTED[36:]]
    assert run(spark, listed, checkpoint) == []
    pq.write_table(pa.table({"domain": ["new.example"]}), f"{listed}/part-11.parquet")
    assert run(spark, listed, checkpoint) == [[(3, 0, "new.example", "https://new.example/")]]


def test_foreign_checkpoints_are_refused(spark, listed, tmp_path):
    checkpoint = str(tmp_path / "c")
    run(spark, listed, checkpoint, shard=0, shards=2, rows_per_batch=12)
    for how in ({"shard": 1, "shards": 2}, {"shard": 0, "shards": 3}, {"column": "url", "shard": 0, "shards": 2}):
        with pytest.raises(Exception, match="the checkpoint is of"):
            run(spark, listed, checkpoint, **how)


def test_shards_part_the_list(spark, listed, tmp_path):
    """Every row is in one shard, as the column function deals it."""
    found = Counter(r for k in range(3) for t in run(spark, listed, str(tmp_path / f"c{k}"), shard=k, shards=3) for r in t)
    assert found == Counter(EXPECTED)
    from pyspark.sql import functions as F

    from weftline.functions import hashes

    values = spark.createDataFrame([(r[2],) for r in EXPECTED], "value string")
    dealt = {r["value"]: r["s"] for r in values.select("value", hashes.shard(F.col("value"), 3).alias("s")).collect()}
    assert all(dealt[r[2]] == 1 for t in run(spark, listed, str(tmp_path / "c4"), shard=1, shards=3) for r in t)


def test_a_resumed_run_reads_its_row_groups_only(listed):
    reader = worklist.WorkListReader({"path": listed, "rows_per_batch": "7"})
    reader.list_parts()
    planned = reader.partitions(reader.offset(2, 13), reader.offset(2, 24))
    assert [(p.group, p.start, p.stop) for p in planned] == [(1, 13, 20), (2, 20, 24)]
    assert [r for p in planned for b in reader.read(p) for r in b.column("row").to_pylist()] == list(range(13, 24))
    assert reader.groups.keys() == {2}  # no other part was opened


def test_edges(spark, tmp_path):
    """No folder, nulls and repeated rows, odd options."""
    assert run(spark, str(tmp_path / "none"), str(tmp_path / "c1")) == [[]]
    folder = tmp_path / "urls"
    folder.mkdir()
    pq.write_table(pa.table({"url": ["http://a/", None, "http://a/"]}), folder / "list.parquet")
    assert sorted(run(spark, str(folder), str(tmp_path / "c2"), column="url")[0], key=repr) == [(0, 0, "http://a/", "http://a/"), (0, 1, None, None), (0, 2, "http://a/", "http://a/")]
    for odd in ({"column": "x"}, {"shard": "3", "shards": "3"}, {"rows_per_batch": "0"}):
        with pytest.raises(ValueError, match="a work list has"):
            worklist.WorkListReader({"path": str(folder), **odd})
    assert worklist.part_order("a/part-10.parquet") > worklist.part_order("a/part-9.parquet") > worklist.part_order("z/list.parquet")
