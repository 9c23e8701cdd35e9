"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit where over half of a text's shingle hashes have it. Fingerprints within the radius are linked,
and documents get the smallest id of their linked component.

Covering: each bit position gets a vector of radius + 1 bits, not zero; for each vector v that isn't zero, a mask keeps
the positions whose vectors have odd inner product with v. The vectors at up to `radius` differing positions leave some
v orthogonal to them all, so in that mask's table the two fingerprints collide: no pair within the radius is missed.

Only distinct fingerprints enter the tables. A bucket yields links that span the same components as all its links would;
a bucket too large for one task is dealt again as rows, by the masks of another covering, which is exact as well. Nothing is
capped.

Edge cases: texts that are null or have no word have fingerprint 0, linked like any other; fewer words than a shingle
has are one shingle; repeated rows and ids are kept; rows whose id is null get the smallest id of their component, or
null if there is none. Extra columns are dropped, so their names can't clash.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.components import components
from weftline.session import cut

BITS = 64
#: Buckets above this many fingerprints are split again, so many times: the masks of all levels leave about one bit open.
BLOCK, LEVELS = 4096, 5


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of words, joined by single spaces; A-Z count as a-z."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = [0, *(ends[:-words] + 1).tolist()]
    return np.fromiter([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; eight byte lanes are counted at once, 255 hashes deep."""
    if not len(hashes):
        return 0
    padded = np.zeros(-(-len(hashes) // 255) * 255, np.uint64)
    padded[: len(hashes)] = hashes
    blocks, lane = padded.reshape(-1, 255), np.uint64(0x0101010101010101)
    result = 0
    for k in range(8):
        lanes = ((blocks >> np.uint64(k)) & lane).sum(axis=1, dtype=np.uint64)
        counts = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(counts * 2 > len(hashes)).tolist():
            result |= 1 << (8 * byte + k)
    return result


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """id and fingerprint (the bit pattern as a long) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [majority(shingle_hashes(t.as_py(), words)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, fingerprint long")


def covering_masks(radius: int, level: int = 0) -> list[int]:
    """Masks over the bits; any two values that differ in at most `radius` of them agree under some mask.

    Each level deals the vectors to the positions anew, so that masks of two levels together fix about three quarters of the bits.
    """
    vectors = 2 ** (radius + 1) - 1
    dealt = [1 + k % vectors for k in range(BITS)]  # each vector comes about as often
    random.Random(level).shuffle(dealt)
    return [sum(1 << p for p in range(BITS) if (dealt[p] & v).bit_count() % 2) for v in range(1, vectors + 1)]


def spanning_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs of indexes of values within the radius that connect all that any such pairs connect. values: distinct uint64."""
    label, links = np.arange(len(values)), []
    for i in range(len(values) - 1):
        near = np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius) + i + 1
        for j in near[label[near] != label[i]].tolist():
            if label[j] != label[i]:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


def bucket_links(rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that span each bucket of rows (bucket, fingerprint, node); a bucket's rows meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # of the bucket that isn't complete yet

        def found(bucket: np.ndarray, prints: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
            edges = np.flatnonzero(np.diff(bucket) != 0) + 1
            starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(bucket)]])
            sizes, out = ends - starts, []
            pairs = starts[sizes == 2]
            near = pairs[np.bitwise_count(prints[pairs] ^ prints[pairs + 1]) <= radius]
            out.append(np.stack([node[near], node[near + 1]], axis=1))
            for a, b in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist(), strict=True):
                if own := spanning_links(prints[a:b], radius):
                    out.append(node[a:b][np.array(own)])
            ab = np.concatenate(out)
            if len(ab):
                yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

        for batch in batches:
            columns = [np.asarray(batch.column(k)) for k in range(3)]
            columns[1] = columns[1].view(np.uint64)
            if not len(columns[0]):
                continue
            whole = np.flatnonzero(columns[0] != columns[0][-1])
            split = whole[-1] + 1 if len(whole) else 0
            if held and (split or held[-1][0][-1] != columns[0][-1]):
                head = [np.concatenate([*(h[k] for h in held), columns[k][:split]]) for k in range(3)]
                held = []
                yield from found(*head)
            elif split:
                yield from found(*(c[:split] for c in columns))
            held.append(tuple(c[split:] for c in columns))
        if held:
            yield from found(*(np.concatenate([h[k] for h in held]) for k in range(3)))

    sorted_rows = rows.select("bucket", "fingerprint", "node").repartition("bucket").sortWithinPartitions("bucket", "fingerprint")
    return sorted_rows.mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between nodes (node, fingerprint; distinct fingerprints) that span all links within the radius.

    Buckets of up to BLOCK fingerprints are connected in a task each. The members of a larger one are compared with its first; if
    that leaves it in parts, they are dealt as rows to buckets of the next level, whose masks fix more bits. Two nodes within the
    radius share a bucket on each level until one connects them; after LEVELS of them a bucket holds a handful.
    """
    rows, found = nodes.select("node", "fingerprint", F.lit(0).cast("long").alias("bucket")), []
    for level in range(LEVELS + 1):
        signed = [m - (1 << 64) if m >> 63 else m for m in covering_masks(radius, level)]
        tables = F.explode(F.array(*[F.xxhash64("bucket", F.lit(t), F.col("fingerprint").bitwiseAND(F.lit(m))) for t, m in enumerate(signed)]))
        rows = rows.select("node", "fingerprint", tables.alias("bucket"))
        if level == LEVELS:
            found.append(bucket_links(rows, radius))
            break
        crowded = cut(rows.groupBy("bucket").count().where(F.col("count") > BLOCK).select("bucket"), "crowded")
        if crowded.isEmpty():
            found.append(bucket_links(rows, radius))
            break
        found.append(bucket_links(rows.join(crowded, "bucket", "left_anti"), radius))
        members = cut(rows.join(crowded, "bucket"), "members")
        hubs = members.groupBy("bucket").agg(F.min("fingerprint").alias("hub"), F.min_by("node", "fingerprint").alias("hub_node"))
        near = members.join(hubs, "bucket").where((F.col("node") != F.col("hub_node")) & (F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("hub"))) <= radius))
        found = [cut(reduce(DataFrame.unionByName, [*found, near.select(F.col("hub_node").alias("a"), F.col("node").alias("b"))]).distinct(), "links")]
        rooted = members.join(components(found[0]), "node", "left").withColumn("root", F.coalesce("root", "node"))
        parted = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
        rows = cut(members.join(parted, "bucket", "left_semi").select("node", "fingerprint", "bucket"), "members")
    return reduce(DataFrame.unionByName, found).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """id_col, fingerprint (16 hexadecimal digits) and component_id, the smallest id of the row's component."""
    prints = cut(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = cut(prints.groupBy("fingerprint").agg(F.min("id").alias("least")).select("fingerprint", "least", F.col("fingerprint").alias("node")), "nodes")
    roots = components(links(nodes, radius))
    rooted = nodes.join(roots, "node", "left").select("fingerprint", "least", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = rooted.join(ids, "root").select("fingerprint", "component_id")
    return prints.join(placed, "fingerprint").select(F.col("id").alias(id_col), hexadecimal("fingerprint").alias("fingerprint"), "component_id")


def hexadecimal(name: str) -> Column:
    return F.lower(F.lpad(F.hex(name), 16, "0"))
