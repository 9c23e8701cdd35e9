"""Turns of hosts over a work list that is read once: a sliding look-ahead, so that few rows are held and no host comes twice in a row where others wait.

Each part of the list is walked in order by one task. It reads `batch` rows at a time, until it holds rows of `workers` hosts or `batch * 16` rows, and hands out a row of
each host it holds in turn; a host that is new takes its first turn in the round that goes on. Every row comes out once.

A task holds at most `batch * 17` rows and an Arrow batch, whatever the part's length and however many of its rows are of one host; parts are the unit of parallelism, so a long list is
cut into parts (ranges of its sequence) by the caller. Rows should be places and URLs, not pages.

Edge cases: a null host is a host, a null part a part; ties in the sequence come in any order of theirs; repeated rows are rows; an empty list gives none; extra columns pass through, but one named
`turn` is refused.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

#: How many batches of rows may be held back.
BATCHES = 16


class Held:
    """Numbers of rows that were read and not handed out, by host; `now` still have a turn in this round, `later` had theirs."""

    def __init__(self) -> None:
        self.rows: dict[object, deque[int]] = {}
        self.now: deque = deque()
        self.later: deque = deque()
        self.n = 0

    def put(self, host: object, number: int) -> None:
        if host not in self.rows:
            self.rows[host] = deque()
            self.now.append(host)
        self.rows[host].append(number)
        self.n += 1

    def take(self) -> int:
        if not self.now:
            self.now, self.later = self.later, self.now
        host = self.now.popleft()
        own = self.rows[host]
        number = own.popleft()
        if own:
            self.later.append(host)
        else:
            del self.rows[host]
        self.n -= 1
        return number


def walk(rows: Iterator[tuple[int, object]], workers: int, batch: int) -> Iterator[int]:
    """Numbers in the order in which they are handed out, of rows (number, host) of one part."""
    held, more = Held(), True
    while True:
        while more and len(held.rows) < workers and held.n < batch * BATCHES:
            got = list(islice(rows, batch))
            more = len(got) == batch
            for number, host in got:
                held.put(host, number)
        if not held.n:
            return
        yield held.take()


class Rows:
    """Arrow rows by number, those handed out taken away."""

    def __init__(self, batches: Iterator[pa.RecordBatch], part: str, host: str):
        self.batches, self.part, self.host = batches, part, host
        self.table: pa.Table | None = None
        self.numbers = np.empty(0, np.int64)
        self.read = 0

    def __iter__(self) -> Iterator[tuple[object, int, object]]:
        for batch in self.batches:
            numbers = np.arange(self.read, self.read + batch.num_rows)
            self.read += batch.num_rows
            fresh = pa.Table.from_batches([batch])
            self.table = fresh if self.table is None else pa.concat_tables([self.table, fresh])
            self.numbers = np.concatenate([self.numbers, numbers])
            yield from zip(batch.column(self.part).to_pylist(), numbers.tolist(), batch.column(self.host).to_pylist(), strict=True)

    def take(self, numbers: list[int], turns: list[int]) -> list[pa.RecordBatch]:
        at = np.searchsorted(self.numbers, numbers)
        found = self.table.take(pa.array(at)).append_column("turn", pa.array(turns, pa.int64()))
        keep = np.ones(len(self.numbers), bool)
        keep[at] = False
        self.table, self.numbers = self.table.filter(pa.array(keep)).combine_chunks(), self.numbers[keep]
        return found.combine_chunks().to_batches()


def spread(rows: DataFrame, host: str, sequence: str, part: str, workers: int, batch: int) -> DataFrame:
    """Rows with `turn`, from 0 in each part: the order in which they are handed out, which is also their order in a task."""
    if workers < 1 or batch < 1 or "turn" in rows.columns:
        raise ValueError("workers and batch are at least 1, and no column is named turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, numbers, turns = Rows(batches, part, host), [], []
        for _, own in groupby(read, key=lambda r: r[0]):
            for turn, number in enumerate(walk((r[1:] for r in own), workers, batch)):
                numbers.append(number)
                turns.append(turn)
                if len(numbers) >= max(1000, len(read.numbers) // 2):
                    yield from read.take(numbers, turns)
                    numbers, turns = [], []
        if numbers:
            yield from read.take(numbers, turns)

    schema = StructType([*rows.schema.fields, StructField("turn", LongType())])
    return rows.repartition(part).sortWithinPartitions(part, sequence).mapInArrow(run, schema)
