"""A capture sink: Parquet shards that close at a size of encoded bytes, by as many writers as there are partitions, sealed together.

    sink.register(spark)
    captures.repartition(64).write.format("captures_sink").mode("append").option("target_bytes", 1 << 30).save(folder)
    stream.writeStream.format("captures_sink").option("path", folder).option("checkpointLocation", mark).start()
    sink.read(spark, folder)

A shard has no footer until it is closed, so a place to go on from is a sealed shard: a job, or a batch of a stream, seals all its shards by one list
(`published`) once every writer is done. A batch that comes again after a crash finds its list and is dropped. Memory is one row group a task: rows are held until
their payload is `group_bytes`; a shard closes when its encoded bytes reach `target_bytes`, so it is longer by at most one row group and the footer.

Edge cases: any columns, whatever their names; nulls count nothing; repeated rows stay; a row longer than a group is a group of its own; a job without rows seals an empty list and no
shard; only appending is offered. A job that fails deletes what its tasks wrote; what one still writes afterwards is in no list, never read, and can be deleted by `published.sweep`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from weftline.sources import published


def payload(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of each row: the lengths of its texts and binaries, and an even share of all other columns."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        else:
            sizes += -(-column.nbytes // max(1, batch.num_rows))
    return sizes


class Shards:
    """The shards of one task."""

    def __init__(self, folder: str, job: str, target: int, group: int):
        self.folder, self.job, self.target, self.group = folder, job, target, group
        self.names: list[str] = []
        self.held: list[pa.RecordBatch] = []
        self.bytes_held = 0
        self.stream = self.writer = None

    def add(self, batch: pa.RecordBatch) -> None:
        ends, start = np.cumsum(payload(batch)), 0
        base = -self.bytes_held
        while (stop := int(np.searchsorted(ends, base + self.group)) + 1) <= len(ends):
            self.held.append(batch.slice(start, stop - start))
            self.flush()
            start, base = stop, int(ends[stop - 1])
        if start < len(ends):
            self.held.append(batch.slice(start))
            self.bytes_held = int(ends[-1]) - base

    def flush(self) -> None:
        """Writes what is held as a row group, and closes the shard once it is long enough."""
        rows, self.held, self.bytes_held = pa.Table.from_batches(self.held), [], 0
        if self.writer is None:
            system, inside = published.file_system(self.folder)
            system.create_dir(inside, recursive=True)
            self.names.append(published.new_name(self.job, ".parquet"))
            self.stream = system.open_output_stream(f"{inside}/{self.names[-1]}", compression=None)
            self.writer = pq.ParquetWriter(self.stream, rows.schema, compression="zstd")
        self.writer.write_table(rows, row_group_size=rows.num_rows)
        if self.stream.tell() >= self.target:
            self.close()

    def close(self) -> None:
        if self.writer is not None:
            self.writer.close()
            self.stream.close()
            self.stream = self.writer = None

    def finish(self) -> None:
        if self.held:
            self.flush()
        self.close()


@dataclass
class Sealed(WriterCommitMessage):
    names: list[str]


def names_of(messages: list[Sealed | None]) -> list[str]:
    return [n for m in messages if m is not None for n in m.names]


class _Settings:
    """What a writer carries to its tasks."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.job = options["path"].rstrip("/"), published.new_job()
        self.target, self.group = int(options.get("target_bytes", 1 << 30)), int(options.get("group_bytes", 32 << 20))
        self.series = options.get("series", "stream")
        if self.target < 1 or self.group < 1:
            raise ValueError("target_bytes and group_bytes are at least 1")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Sealed:
        shards = Shards(self.folder, self.job, self.target, self.group)
        try:
            for batch in batches:
                shards.add(batch)
            shards.finish()
        except BaseException:
            shards.close()
            published.discard(self.folder, shards.names)
            raise
        return Sealed(shards.names)


class _Writer(_Settings, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        published.publish(self.folder, names_of(messages), self.job)

    def abort(self, messages: list) -> None:
        published.discard_job(self.folder, self.job, ".parquet")


class _StreamWriter(_Settings, DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:
        names = names_of(messages)
        if not published.publish(self.folder, names, f"{self.series}-{batchId}"):
            published.discard(self.folder, names)

    def abort(self, messages: list, batchId: int) -> None:
        published.discard_job(self.folder, self.job, ".parquet")


class CaptureSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captures_sink"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a capture sink only appends")
        return _Writer(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CaptureSink)


def read(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """All sealed rows, whatever else lies in the folder."""
    files, _ = published.listing(folder, ".parquet")
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
