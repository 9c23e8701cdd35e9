"""Exact and near duplicates of documents by digests and SimHash bands, and a report over both."""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.hashes import hamming
from weftline.operators.components import components
from weftline.session import cut

#: Fingerprints of a bucket that one task compares with each other, and how often a larger one is dealt again.
BLOCK, LEVELS = 4096, 3
_WORD = regex.compile(r"[\p{L}\p{Nd}]+")
#: Offset basis and prime of FNV-1a with 64 bits.
FNV_BASIS, FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


def fnv64_all(features: list[bytes]) -> np.ndarray:
    """FNV-1a of each feature, a byte position at a time for all of them."""
    sizes = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(features), np.uint8).astype(np.uint64)
    starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
    h = np.full(len(features), FNV_BASIS)
    for at in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -at))  # the features that have a byte here come first
        h[:n] = (h[:n] ^ data[starts[:n] + at]) * FNV_PRIME
    found = np.empty_like(h)
    found[order] = h
    return found


def features(text: str | None, size: int = 3) -> list[bytes]:
    """The distinct runs of `size` words of a text; its words by themselves if there are fewer."""
    words = _WORD.findall((text or "").replace("Σ", "σ").lower())
    runs = set(words) if len(words) < size else set(map(" ".join, zip(*(words[k:] for k in range(size)), strict=False)))
    return [r.encode("utf-8", "surrogatepass") for r in runs]


def fingerprints(texts: Iterable[str | None], most: int = 200_000) -> list[int]:
    """Each distinct run of words votes once on each bit; 0 without words. Runs of many texts are hashed together, about `most` at once."""
    found: list[int] = []
    runs: list[bytes] = []
    sizes: list[int] = []

    def flush() -> None:
        bits = np.unpackbits(fnv64_all(runs).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        n = np.array(sizes, np.int64)
        votes = np.zeros((len(n), 64), np.int64)
        if len(runs):
            votes[n > 0] = np.add.reduceat(bits, (np.cumsum(n) - n)[n > 0], axis=0, dtype=np.int64)
        found.extend(np.packbits(votes * 2 > n[:, None], axis=1, bitorder="little").view("<i8").ravel().tolist())
        runs.clear()
        sizes.clear()

    for text in texts:
        own = features(text)
        runs.extend(own)
        sizes.append(len(own))
        if len(runs) >= most:
            flush()
    flush()
    return found


@F.pandas_udf(T.LongType())
def simhash_column(texts: pd.Series) -> pd.Series:
    return pd.Series(fingerprints(texts), dtype="int64")


def simhash(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col and simhash, the bit pattern as a long; no shuffle."""
    return docs.select(id_col, simhash_column(text_col).alias("simhash"))


def exact_clusters(docs: DataFrame, by: str = "url") -> DataFrame:
    """digest, size, first, duplicates, saved_bytes of texts (markdown) that come more than once; empty ones are none.

    The first by `by` is kept; what the others hold is saved.
    """
    rows = docs.where(F.coalesce(F.octet_length("markdown"), F.lit(0)) > 0)
    digest = F.substring(F.sha2("markdown", 256), 1, 32)
    size = F.octet_length("markdown").cast("long")
    found = rows.groupBy(digest.alias("digest")).agg(F.count("*").alias("size"), F.min(by).alias("first"), F.sum(size).alias("bytes"), F.min(size).alias("one"))
    return found.where("size > 1").select("digest", "size", "first", (F.col("size") - 1).alias("duplicates"), (F.col("bytes") - F.col("one")).alias("saved_bytes"))


def band_masks(distance: int, bands: int = 6, bits: int = 64, level: int = 0) -> list[int]:
    """Masks of all sets of bands that `distance` changed bits can leave untouched: two near values agree under one of them.

    Each level deals the bits to the bands anew.
    """
    order = list(range(bits))
    if level:
        random.Random(level).shuffle(order)
    edges = [round(i * bits / bands) for i in range(bands + 1)]
    parts = [sum(1 << order[b] for b in range(low, high)) for low, high in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, max(1, bands - distance))]


def size_runs(rows: DataFrame, least_ratio: float) -> tuple[DataFrame, DataFrame]:
    """Documents of one fingerprint that lengths connect, as nodes (simhash, node, low, high), and the links (a, b) to their nodes.

    In a run each length is within the ratio of the next one, so a length fits some of its members if it fits its span. A
    window holds the distinct lengths of one fingerprint, not its documents.
    """
    by_size = Window.partitionBy("simhash").orderBy("bytes")
    sized = rows.groupBy("simhash", "bytes").agg(F.min("id").alias("id"))
    gaps = sized.withColumn("gap", F.coalesce((F.lag("bytes").over(by_size) < least_ratio * F.col("bytes")).cast("int"), F.lit(0)))
    placed = cut(gaps.withColumn("run", F.sum("gap").over(by_size)), "runs")
    nodes = cut(placed.groupBy("simhash", "run").agg(F.min("id").alias("node"), F.min("bytes").alias("low"), F.max("bytes").alias("high")), "nodes")
    owner = placed.join(nodes, ["simhash", "run"]).select("simhash", "bytes", "node")
    return nodes.drop("run"), rows.join(owner, ["simhash", "bytes"]).where("id <> node").select(F.col("node").alias("a"), F.col("id").alias("b"))


def bucket_pairs(rows: DataFrame, distance: int, least_ratio: float) -> DataFrame:
    """Pairs (a, b) that span each bucket of rows (bucket, node, simhash, low, high); a bucket's rows meet in one task."""

    def connect(ids: np.ndarray, prints: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int]]:
        label = np.arange(len(ids))
        for i in range(len(ids) - 1):
            near = np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= distance
            near &= np.minimum(high[i + 1 :], high[i]) >= least_ratio * np.maximum(low[i + 1 :], low[i])
            for j in (np.flatnonzero(near & (label[i + 1 :] != label[i])) + i + 1).tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    yield tuple(sorted((int(ids[i]), int(ids[j]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            now = [np.asarray(batch.column(k)) for k in range(5)] if batch is not None else None
            if held is not None:
                now = [np.concatenate([h, n]) for h, n in zip(held, now, strict=True)] if now else held
            if now is None or not len(now[0]):
                continue
            edges = np.flatnonzero(np.diff(now[0]) != 0) + 1
            starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(now[0])]])
            whole = len(starts) - (batch is not None)  # the last bucket may go on in the next batch
            found = []
            for a, b in zip(starts[:whole].tolist(), ends[:whole].tolist(), strict=True):
                if b - a > 1:
                    found += connect(now[1][a:b], now[2][a:b].view(np.uint64), now[3][a:b], now[4][a:b])
            held = [c[starts[-1] :] for c in now] if batch is not None else None
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.select("bucket", "node", "simhash", "low", "high").repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(run, "a long, b long")


def near_pairs(docs: DataFrame, distance: int = 3, least_bytes: int = 512, least_ratio: float = 0.5, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of ids that connect what all pairs of documents (id, simhash, bytes) within the distance and the ratio of lengths connect.

    Documents are one for each text; short ones are left out. Fingerprints that agree on half of the bits' bands meet in
    buckets. Up to `block` of them are compared in one task. The members of a larger bucket are compared with its first, and if that
    leaves it in parts, they are dealt as rows to buckets of other bands, which together fix more bits.
    """
    rows = docs.where((F.col("bytes") >= least_bytes) & (F.col("simhash") != 0)).select("id", "simhash", F.col("bytes").cast("long").alias("bytes"))
    nodes, inside = size_runs(cut(rows, "prints"), least_ratio)
    rows, found = nodes.withColumn("bucket", F.lit(0).cast("long")), [inside]
    for level in range(LEVELS + 1):
        signed = [m - (1 << 64) if m >> 63 else m for m in band_masks(distance, max(6, distance + 1), level=level)]
        keys = F.explode(F.array(*[F.xxhash64("bucket", F.lit(t), F.col("simhash").bitwiseAND(F.lit(m))) for t, m in enumerate(signed)]))
        rows = rows.select("node", "simhash", "low", "high", keys.alias("bucket"))
        crowded = cut(rows.groupBy("bucket").count().where(F.col("count") > block).select("bucket"), "crowded") if level < LEVELS else None
        if crowded is None or crowded.isEmpty():
            found.append(bucket_pairs(rows, distance, least_ratio))
            break
        found.append(bucket_pairs(rows.join(crowded, "bucket", "left_anti"), distance, least_ratio))
        members = cut(rows.join(crowded, "bucket"), "members")
        hubs = members.groupBy("bucket").agg(F.min_by(F.struct("node", "simhash", "low", "high"), "node").alias("hub"))
        fits = (hamming(F.col("simhash"), F.col("hub.simhash")) <= distance) & (F.least("high", "hub.high") >= least_ratio * F.greatest("low", "hub.low"))
        near = members.join(hubs, "bucket").where((F.col("node") != F.col("hub.node")) & fits).select(F.col("hub.node").alias("a"), F.col("node").alias("b"))
        found = [cut(reduce(DataFrame.unionByName, [*found, near]).distinct(), "pairs")]
        rooted = members.join(components(found[0]), "node", "left").withColumn("root", F.coalesce("root", "node"))
        parted = rooted.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("bucket")
        rows = cut(members.join(parted, "bucket", "left_semi"), "members")
    return reduce(DataFrame.unionByName, found).distinct()


def near_clusters(docs: DataFrame, distance: int = 3, least_bytes: int = 512) -> DataFrame:
    """root, size, first and duplicates of near-duplicate clusters of representatives (id, simhash, bytes)."""
    rooted = components(near_pairs(docs, distance, least_bytes)).select(F.col("node").alias("id"), "root")
    found = rooted.unionAll(rooted.select(F.col("root").alias("id"), "root").distinct())
    return found.groupBy("root").agg(F.count("*").alias("size"), F.min("id").alias("first")).select("root", "size", "first", (F.col("size") - 1).alias("duplicates"))


def sized_clusters(docs: DataFrame, distance: int = 3, least_bytes: int = 512) -> DataFrame:
    """What near_clusters gives, with bytes: what the members beyond the first hold. A cluster may have any share of the rows, so its sums are partial first."""
    rooted = components(near_pairs(docs, distance, least_bytes)).select(F.col("node").alias("id"), "root")
    members = cut(rooted.unionAll(rooted.select(F.col("root").alias("id"), "root").distinct()), "members")
    sizes = members.join(docs.select("id", F.col("bytes").cast("long").alias("bytes")), "id")
    found = sizes.groupBy("root").agg(F.count("*").alias("size"), F.min("id").alias("first"), F.sum("bytes").alias("bytes"), F.min_by("bytes", "id").alias("one"))
    return found.select("root", "size", "first", (F.col("size") - 1).alias("duplicates"), (F.col("bytes") - F.col("one")).alias("bytes"))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """id, simhash and bytes of one document for each text (id, markdown), the one of the least id; the texts that differ are fingerprinted, once each."""
    rows = docs.where(F.coalesce(F.octet_length("markdown"), F.lit(0)) > 0)
    ones = rows.groupBy(F.sha2("markdown", 256).alias("d")).agg(F.min("id").alias("id"))
    first = rows.join(ones.select(F.col("id").alias("one"), "d"), (F.col("id") == F.col("one")) & (F.sha2("markdown", 256) == F.col("d"))).dropDuplicates(["d"])
    return first.select("id", simhash_column("markdown").alias("simhash"), F.octet_length("markdown").cast("long").alias("bytes"))


def top_clusters(docs: DataFrame, top: int = 20, distance: int = 3, least_bytes: int = 512) -> DataFrame:
    """The largest clusters of documents (id, markdown): kind (exact or near), size, first and the bytes that its others hold; near ones are of different texts.

    Ties go to the least first id, then exact before near.
    """
    exact = exact_clusters(docs, "id").select(F.lit("exact").alias("kind"), "size", "first", F.col("saved_bytes").alias("bytes"))
    near = sized_clusters(cut(distinct_texts(docs), "texts"), distance, least_bytes).select(F.lit("near").alias("kind"), "size", "first", "bytes")
    return exact.unionByName(near).orderBy(F.desc("size"), "first", "kind").limit(top)


def report(docs: DataFrame, distance: int = 3, least_bytes: int = 512) -> DataFrame:
    """One row: rows, exact and near clusters, duplicates and bytes, and documents without a fingerprint (id, markdown, simhash)."""
    exact = exact_clusters(docs, "id").agg(F.count("*").alias("exact_clusters"), F.coalesce(F.sum("duplicates"), F.lit(0)).alias("exact_duplicates"), F.coalesce(F.sum("saved_bytes"), F.lit(0)).alias("exact_bytes"))
    rows = docs.where(F.coalesce(F.octet_length("markdown"), F.lit(0)) > 0)
    ones = rows.groupBy(F.sha2("markdown", 256).alias("d")).agg(F.min("id").alias("id"), F.min("simhash").alias("simhash"), F.min(F.octet_length("markdown")).alias("bytes"))
    near = near_clusters(ones, distance, least_bytes).agg(F.count("*").alias("near_clusters"), F.coalesce(F.sum("duplicates"), F.lit(0)).alias("near_duplicates"))
    total = docs.agg(F.count("*").alias("rows"), F.count_if((F.col("simhash") == 0) | F.col("simhash").isNull()).alias("no_fingerprint"))
    one = F.lit(1).alias("one")
    return total.select(one, "*").join(exact.select(one, "*"), "one").join(near.select(one, "*"), "one").drop("one")


def first_payload(rows: DataFrame, shard: str, digest: str, order: list[str], exempt: Column | None = None) -> DataFrame:
    """The first row of each payload digest within a shard; exempt rows (failed fetches, say) all stay."""
    key = F.when(exempt, F.concat_ws(" ", F.lit("exempt"), *order)).otherwise(F.col(digest)) if exempt is not None else F.col(digest)
    ranked = rows.withColumn("__key", key).withColumn("__rank", F.row_number().over(Window.partitionBy(shard, "__key").orderBy(*order)))
    return ranked.where("__rank = 1").drop("__key", "__rank")
