"""Coalescing byte ranges, and sampling and expanding manifests."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import hashes


def coalesce_ranges(locations: DataFrame, gap: int = 1 << 20, most: int = 16 << 20) -> DataFrame:
    """filename, group_start, group_end, n: neighbours (filename, offset, length) join while the hole is at most `gap` and
    the span at most `most`.

    Where a group ends depends on where it began, so files are read in order: sorted partitions are streamed, and a task
    holds one group, not one file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: list | None = None

        def made(groups: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([g[k] for g in groups], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["filename", "group_start", "group_end", "n"])

        for batch in batches:
            done = []
            names = batch.column(0).to_pylist()
            starts = np.asarray(batch.column(1))
            ends = starts + np.asarray(batch.column(2))
            for name, start, end in zip(names, starts.tolist(), ends.tolist(), strict=True):
                if current and current[0] == name and start - current[2] <= gap and max(end, current[2]) - current[1] <= most:
                    current[2], current[3] = max(end, current[2]), current[3] + 1
                else:
                    if current:
                        done.append(current)
                    current = [name, start, end, 1]
            if done:
                yield made(done)
        if current:
            yield made([current])

    rows = locations.select("filename", F.col("offset").cast("long"), F.col("length").cast("long")).where("filename is not null and offset is not null and length is not null")
    return rows.repartition("filename").sortWithinPartitions("filename", "offset", "length").mapInArrow(run, "filename string, group_start long, group_end long, n long")


def manifest_slice(paths: DataFrame, segment: str = "", sample: float = 0.0, limit: int = 0) -> DataFrame:
    """Paths that hold the segment, of which a stable share is sampled by hash; with a limit, the first by position or path."""
    if segment:
        paths = paths.where(F.contains(F.col("path"), F.lit(segment)))
    if 0 < sample < 1:
        paths = paths.where(hashes.sample_fraction(F.col("path")) < sample)
    if limit:
        paths = paths.orderBy("position" if "position" in paths.columns else "path").limit(limit)
    return paths


def expand_ranges(spec: str, total: int) -> list[int]:
    """Numbers named by all, N, N-M or a list of these."""
    if spec.strip() == "all":
        return [*range(total)]
    found: dict[int, None] = {}
    for part in spec.split(","):
        m = re.fullmatch(r"\s*(\d+)(?:-(\d+))?\s*", part)
        if not m:
            raise ValueError(f"not a range: {part}")
        for n in range(int(m[1]), int(m[2] or m[1]) + 1):
            if n < total:
                found[n] = None
    return [*found]


def resolve_crawls(catalog: list[str], spec: str) -> list[str]:
    """Crawl ids (newest first in the catalog) named by latest, all, a year, the newest N, an id, or a list of these."""
    found: dict[str, None] = {}
    for part in (p.strip() for p in spec.split(",")):
        if part == "all":
            names = catalog
        elif part in ("latest", ""):
            names = catalog[:1]
        elif re.fullmatch(r"(19|20)\d\d", part):
            names = [c for c in catalog if f"-{part}-" in f"-{c}-"]
        elif part.isdigit():
            names = catalog[: int(part)]
        else:
            names = [c for c in catalog if c == part]
        if not names:
            raise ValueError(f"no crawl is named {part}")
        found |= dict.fromkeys(names)
    return [*found]
