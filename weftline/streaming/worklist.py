"""A published work list as a streaming source: parts are read in order, a batch at a time, and a run goes on where the last one stopped.

    stream = worklist.read(spark, path, checkpoint, column="domain", shard=1, shards=3, rows_per_batch=1_000_000)
    stream.writeStream.foreachBatch(...).option("checkpointLocation", checkpoint).start()

An offset is a part and a row in it, counted before the shard's filter, with the identity of what it points into. Its size doesn't depend on the list's. A
batch is planned from the footers of the parts it touches: a task reads one column of one row group, so going on at a row reads nothing before
its row group. Rows come at least once: a batch that was planned and not finished is planned again as it was.

Spark tells a resumed source where it stands only when it plans a batch, so the end of the last planned batch is also kept in the checkpoint's
folder (`worklist.json`), written before the batch runs. A checkpoint of another list, column or shard is refused.

Edge cases: parts are ordered by the first number in their names, those without one first, then by name; parts that are added at the end while a
stream runs are read in their turn; empty parts and row groups are passed; null values are rows with a null url, in the shard of the empty string; the first batch of a list
without rows is empty; repeated rows stay. A
list without parts yields nothing. Other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from weftline.operators.dedup import fnv64_all

SCHEMA = "part int, row long, value string, url string"
ARROW = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("value", pa.string()), ("url", pa.string())])


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def part_order(path: str) -> tuple[int, str]:
    """By the first number in a name, -1 without one, then by the whole path."""
    digits = re.search(r"[0-9]+", posixpath.basename(path))
    return (int(digits[0]) if digits else -1), path


@dataclass
class Rows(InputPartition):
    """Some rows of one row group: `first` is the number in the part of the group's first row."""

    part: int
    path: str
    group: int
    first: int
    start: int
    stop: int


class WorkListReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.column = options["path"].rstrip("/"), options.get("column", "domain")
        self.shard, self.shards = int(options.get("shard", 0)), int(options.get("shards", 1))
        self.most, self.state = int(options.get("rows_per_batch", 1_000_000)), options.get("state")
        if self.column not in ("domain", "url") or not 0 <= self.shard < self.shards or self.most < 1:
            raise ValueError("a work list has a column domain or url, a shard of at most as many as there are, and batches of a row at least")
        self.paths: list[str] = []
        self.groups: dict[int, list[int]] = {}
        self.at = self.load()

    # where the stream stands

    def offset(self, part: int, row: int) -> dict:
        return {"source": f"{self.folder}#{self.column}", "shard": self.shard, "shards": self.shards, "part": part, "row": row}

    def own(self, offset: dict) -> tuple[int, int]:
        """The place of an offset, which must be of this work."""
        mine = self.offset(0, 0)
        for name in ("source", "shard", "shards"):
            if offset[name] != mine[name]:
                raise ValueError(f"the checkpoint is of {offset['source']}, shard {offset['shard']} of {offset['shards']}; this is {mine['source']}, shard {mine['shard']} of {mine['shards']}")
        return offset["part"], offset["row"]

    def load(self) -> tuple[int, int]:
        if self.state:
            system, path = file_system(self.state)
            if system.get_file_info(path).type == fs.FileType.File:
                with system.open_input_stream(path) as file:
                    return self.own(json.loads(file.read()))
        return 0, 0

    def save(self, offset: dict) -> None:
        """Whole or not at all: written beside its place and moved there."""
        if self.state:
            system, path = file_system(self.state)
            system.create_dir(posixpath.dirname(path), recursive=True)
            with system.open_output_stream(f"{path}.new") as file:
                file.write(json.dumps(offset).encode())
            system.move(f"{path}.new", path)

    # what the list holds

    def list_parts(self) -> None:
        system, path = file_system(self.folder)
        found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        self.paths = sorted((f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".parquet") and not posixpath.basename(f.path).startswith(("_", "."))), key=part_order)

    def sizes(self, part: int) -> list[int]:
        """Rows of each row group of a part, from its footer."""
        if part not in self.groups:
            system, _ = file_system(self.folder)
            with system.open_input_file(self.paths[part]) as file:
                meta = pq.ParquetFile(file).metadata
                self.groups[part] = [meta.row_group(k).num_rows for k in range(meta.num_row_groups)]
        return self.groups[part]

    def after(self, part: int, row: int, n: int) -> tuple[int, int]:
        """The place n rows on, or the end."""
        while part < len(self.paths):
            left = sum(self.sizes(part)) - row
            if n < left:
                return part, row + n
            part, row, n = part + 1, 0, n - max(left, 0)
        return part, 0

    # what Spark asks

    def initialOffset(self) -> dict:
        return self.offset(0, 0)

    def latestOffset(self) -> dict:
        self.list_parts()
        return self.offset(*self.after(*self.at, self.most))

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        (part, row), stop = self.own(start), self.own(end)
        if not self.paths:
            self.list_parts()
        found = []
        while part < len(self.paths) and (part, row) < stop:
            first, last = 0, stop[1] if part == stop[0] else sum(self.sizes(part))
            for group, size in enumerate(self.sizes(part)):
                a, b = max(row, first), min(last, first + size)
                if a < b:
                    found.append(Rows(part, self.paths[part], group, first, a, b))
                first += size
            part, row = part + 1, 0
        self.at = stop
        self.save(end)
        return found

    def read(self, rows: Rows) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.folder)
        with system.open_input_file(rows.path) as file:
            column = pq.ParquetFile(file).read_row_group(rows.group, columns=[self.column]).column(0)
        values = pa.chunked_array(column).slice(rows.start - rows.first, rows.stop - rows.start).combine_chunks().cast(pa.string())
        at = pa.array(range(rows.start, rows.stop), pa.int64())
        if self.shards > 1:
            keep = pa.array(fnv64_all([(v or "").encode() for v in values.to_pylist()]) % np.uint64(self.shards) == self.shard)
            values, at = values.filter(keep), at.filter(keep)
        url = pc.binary_join_element_wise("https://", values, "/", "") if self.column == "domain" else values
        yield pa.RecordBatch.from_arrays([pa.array([rows.part] * len(at), pa.int32()), at, values, url.cast(pa.string())], schema=ARROW)


class WorkList(DataSource):
    @classmethod
    def name(cls) -> str:
        return "worklist"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> WorkListReader:
        return WorkListReader(dict(self.options))


def read(spark: SparkSession, path: str, checkpoint: str, column: str = "domain", shard: int = 0, shards: int = 1, rows_per_batch: int = 1_000_000) -> DataFrame:
    """part, row, value and url of a work list, as a stream whose query uses this checkpoint."""
    spark.dataSource.register(WorkList)
    options = {"column": column, "shard": shard, "shards": shards, "rows_per_batch": rows_per_batch, "state": f"{checkpoint.rstrip('/')}/worklist.json"}
    return spark.readStream.format("worklist").options(**{k: str(v) for k, v in options.items()}).load(path)
