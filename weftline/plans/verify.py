"""Verifying and recounting published shards from their Parquet footers, and a library's manifest from its files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources.archives import file_system


def verify_shards(paths: DataFrame, columns: dict[str, str]) -> DataFrame:
    """path, status and rows of each shard (path): ok, missing, empty, truncated, corrupt, schema or unreadable.

    Only footers are read, by the tasks that hold the paths.
    """

    def look(path: str) -> tuple[str, int]:
        system, name = file_system(path)
        try:
            info = system.get_file_info(name)
            if info.type.name == "NotFound":
                return "missing", 0
            if info.size < 12:
                return "truncated", 0
            with system.open_input_file(name) as f:
                f.seek(info.size - 4)
                if f.read(4) != b"PAR1":
                    return "truncated", 0
                f.seek(0)
                meta = pq.ParquetFile(f)
                found = {x.name: str(x.type) for x in meta.schema_arrow}
                if any(found.get(c) != t for c, t in columns.items()):
                    return "schema", meta.metadata.num_rows
                groups = sum(meta.metadata.row_group(i).num_rows for i in range(meta.metadata.num_row_groups))
                if groups != meta.metadata.num_rows:
                    return "corrupt", groups
                return ("ok" if groups else "empty"), groups
        except PermissionError:
            return "no-access", 0
        except pa.ArrowInvalid:
            return "corrupt", 0
        except OSError:
            return "unreadable", 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            found = [look(p) for p in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["path", "status", "rows"])

    return paths.select("path").mapInArrow(run, "path string, status string, rows long")


def recount(verified: DataFrame) -> DataFrame:
    """Rows by status, from footers alone."""
    return verified.groupBy("status").agg(F.count("*").alias("shards"), F.sum("rows").alias("rows"))


def verify_totals(verified: DataFrame, ledger: DataFrame) -> DataFrame:
    """passed, failed, rows and shards whose ledger (path, rows) tells another number."""
    rows = verified.join(ledger.select("path", F.col("rows").alias("told")), "path", "left")
    return rows.agg(
        F.count_if(F.col("status") == "ok").alias("passed"),
        F.count_if(F.col("status") != "ok").alias("failed"),
        F.sum("rows").alias("rows"),
        F.count_if(F.col("told").isNotNull() & (F.col("told") != F.col("rows"))).alias("mismatched"),
    )


def scan_library(spark, path: str) -> DataFrame:
    """path, bytes and sha256 of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def library_differences(scanned: DataFrame, manifest: DataFrame) -> DataFrame:
    """path and status: ok, changed, missing (in the manifest alone) or unknown (on disk alone: what gc may delete)."""
    rows = scanned.select("path", F.col("sha256").alias("now")).join(manifest.select("path", F.col("sha256").alias("told")), "path", "full_outer")
    status = F.when(F.col("now").isNull(), "missing").when(F.col("told").isNull(), "unknown").when(F.col("now") == F.col("told"), "ok").otherwise("changed")
    return rows.select("path", status.alias("status"))
