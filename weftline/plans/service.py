"""The query surface of the service: hosts, top hosts and search, as functions that return frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import bm25, hosts

MOST_HOSTS, MOST_HITS = 10_000, 100


class Unavailable(RuntimeError):
    """The table behind a request is not loaded."""


class Service:
    def __init__(self, spark: SparkSession, records: DataFrame | None = None, index: DataFrame | None = None, forward: DataFrame | None = None):
        self.spark, self.records, self.index, self.forward = spark, records, index, forward

    def host(self, name: str) -> DataFrame:
        return self._need(self.records).where(F.col("host") == name.lower()).limit(1)

    def hosts(self, n: int = 100, tld: str = "") -> DataFrame:
        rows = self._need(self.records)
        if tld:
            rows = rows.where(hosts.under_tld(F.col("host"), tld))
        return rows.orderBy(F.asc_nulls_last("harmonic_pos"), "host").limit(max(0, min(n, MOST_HOSTS)))

    def search(self, q: str, k: int = 10) -> DataFrame:
        hits = bm25.search(self._need(self.index), q, max(1, min(k, MOST_HITS)))
        return hits if self.forward is None else bm25.attach(hits, self.forward, [c for c in self.forward.columns if c != "doc_id"])

    def health(self) -> DataFrame:
        return self.spark.createDataFrame([("ok", self.records is not None, self.index is not None)], "status string, hosts boolean, search boolean")

    @staticmethod
    def _need(table: DataFrame | None) -> DataFrame:
        if table is None:
            raise Unavailable("not loaded")
        return table
