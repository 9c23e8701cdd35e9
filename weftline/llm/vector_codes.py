"""Vector code compression: product codes by Lloyd's rounds with the filtering method.

Vectors become integers and are cut into equal parts; each part position has a codebook of `size` entries, and a vector's code is the
nearest entry of each of its parts. Rows are dealt into blocks; for each block and part position a kd-tree is built once and
written, with the bounds, sums and count of every node. In a round a tree is walked from its root, a level at a time, with the
entries that may still be nearest to something in a node: an entry goes if the corner of the node's box that lies furthest in its
direction is nearer to the entry nearest to the middle. A node with one entry left is assigned as a whole, by its cached sums;
only what is left at the leaves is compared point by point. Spark adds up the sums of all trees, and a round moves to the driver
what the codebooks themselves hold: positions * size sums.

Everything is integer arithmetic, so results depend neither on blocks nor on their order. Where squares could pass 64 bits, a block's tree
holds Python integers; sums travel as limbs of `LIMB` bits. Equal vectors end in boxes without extent, which are assigned at once however many they are.

Edge cases: rows whose vector is null or has null, infinite or NaN components are dropped, as asked; the vectors' length is that of the smallest kept
id's, and kept rows of another length have null code and error. A length that the positions don't divide is cut as evenly
as it goes. Fewer kept rows than `size` make smaller codebooks. Ties between entries go to the lower index; equal ids are ordered by vector, null
ids last. Repeated rows are each coded; an empty table gives no rows. An error, or the sum of a label's errors, of more than 64
bits is null. Extra columns are dropped, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import cut

#: Rows of a block, and its components at most (a block has one row at least); points of a leaf.
BLOCK, MOST_COMPONENTS, LEAF = 4096, 1 << 20, 16
#: Bits of a limb and how many there are: 240 bits hold a sum of 10^30 components of any 32-bit float.
LIMB, LIMBS = 40, 6
#: Labels up to this many are sent to all tasks; more are joined by a shuffle of salted rows.
FEW_LABELS, SALTS = 1 << 16, 16
MOST = (1 << 63) - 1


def edges(length: int, positions: int) -> list[int]:
    """Where the parts of a vector begin and end."""
    return [length * k // positions for k in range(positions + 1)]


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly, for a scale that is a power of two."""
    return int(np.floor(x * scale)) if abs(x) < 2.0**40 else int(x) * scale


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """Rows of floats as integers, of 64 bits where squared distances fit."""
    wide = np.abs(vectors).max(initial=0.0) * scale
    if vectors.shape[1] * (4 * wide + 4) ** 2 < 2.0**61:
        return np.floor(vectors * scale).astype(np.int64)
    found = np.empty(vectors.shape, object)
    found.flat = [whole(float(x), scale) for x in vectors.flat]
    return found


@dataclass
class Tree:
    """A kd-tree over points: `order` says which row each point is; level k has 2^k nodes, node i from point n * i >> k on."""

    order: np.ndarray
    points: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]
    total: list[np.ndarray]

    def starts(self, level: int) -> np.ndarray:
        return len(self.points) * np.arange((1 << level) + 1) >> level


def grow(points: np.ndarray) -> Tree:
    """Halves nodes at the median of their widest side down to leaves of some LEAF points."""
    n = len(points)
    depth = max(0, (n // LEAF).bit_length() - 1) if points.shape[1] else 0
    order = np.arange(n)
    for level in range(depth):
        start = n * np.arange((1 << level) + 1) >> level
        here = points[order]
        side = (np.maximum.reduceat(here, start[:-1]) - np.minimum.reduceat(here, start[:-1])).argmax(1)
        node = np.repeat(np.arange(1 << level), np.diff(start))
        key = here[np.arange(n), side[node]]
        if key.dtype == object:
            key = np.unique(key, return_inverse=True)[1]
        order = order[np.lexsort((key, node))]
    here, start = points[order], (n * np.arange((1 << depth) + 1) >> depth)[:-1]
    low, high, total = ([f.reduceat(here, start)] for f in (np.minimum, np.maximum, np.add))
    for _ in range(depth):
        for nodes, f in ((low, np.minimum), (high, np.maximum), (total, np.add)):
            nodes.insert(0, f(nodes[0][::2], nodes[0][1::2]))
    return Tree(order, here, low, high, total)


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    step = points[:, None, :] - entries[None]
    return (step * step).sum(2)


def nearest(square: np.ndarray, may: np.ndarray) -> np.ndarray:
    """The first of the smallest distances among the entries that may be."""
    top = square.max(initial=0) + 1
    return np.where(may, square, top).argmin(1)


def filtered(tree: Tree, entries: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Level, nodes and the entry that each is assigned to as a whole; at last, with level -1, the points and entries of what is left."""
    k, width = entries.shape
    node, may = np.zeros(1, np.int64), np.ones((1, k), bool)
    for level in range(len(tree.low)):
        low, high = tree.low[level][node], tree.high[level][node]
        best = nearest(distances(low + high, 2 * entries), may)
        mine = entries[best]
        # Of the corner furthest towards an entry: how much nearer the best entry is than that one.
        corner = np.where(entries[None] > mine[:, None], high[:, None], low[:, None])
        apart = ((entries[None] - mine[:, None]) * (entries[None] + mine[:, None] - 2 * corner)).sum(2) if width else np.zeros(may.shape, np.int64)
        may &= (apart < 0) | ((apart == 0) & (np.arange(k) < best[:, None]))
        may[np.arange(len(node)), best] = True
        alone = may.sum(1) == 1
        if alone.any():
            yield level, node[alone], best[alone]
        node, may = node[~alone], may[~alone]
        if not len(node):
            return
        if level + 1 < len(tree.low):
            node, may = np.concatenate([2 * node, 2 * node + 1]), np.concatenate([may, may])
    start = tree.starts(len(tree.low) - 1)
    size = start[node + 1] - start[node]
    point = np.repeat(start[node], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    yield -1, point, nearest(distances(tree.points[point], entries), np.repeat(may, size, 0))


def sums(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of the points that are nearest to each entry."""
    k = len(entries)
    count, total = np.zeros(k, np.int64), np.zeros(entries.shape, tree.points.dtype)
    for level, place, entry in filtered(tree, entries):
        if level < 0:
            np.add.at(total, entry, tree.points[place])
            np.add.at(count, entry, 1)
        else:
            start = tree.starts(level)
            np.add.at(total, entry, tree.total[level][place])
            np.add.at(count, entry, start[place + 1] - start[place])
    return count, total


def assigned(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, and its squared distance."""
    found = np.zeros(len(tree.points), np.int64)
    for level, place, entry in filtered(tree, entries):
        if level < 0:
            found[place] = entry
        else:
            start = tree.starts(level)
            size = start[place + 1] - start[place]
            found[np.repeat(start[place], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.repeat(entry, size)
    step = tree.points - entries[found]
    code, error = np.empty(len(found), np.int64), np.empty(len(found), step.dtype)
    code[tree.order], error[tree.order] = found, (step * step).sum(1)
    return code, error


def packed(trees: list[Tree]) -> bytes:
    return zstandard.compress(pickle.dumps(trees, 5), 1)


def unpacked(data: bytes) -> list[Tree]:
    return pickle.loads(zstandard.decompress(data))


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label and vector (doubles) of the rows whose vector is whole."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


def plant(kept: DataFrame, length: int, positions: int, scale: int) -> DataFrame:
    """Blocks of rows: their ids and labels, and the trees of all part positions."""
    bounds = edges(length, positions)
    most = max(1, min(BLOCK, MOST_COMPONENTS // max(length, 1)))
    schema = kept.select(F.array("id").alias("ids"), F.array("label").alias("labels")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                n = part.num_rows
                vectors = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(n, length)
                trees = packed([grow(integers(vectors[:, a:b], scale)) for a, b in zip(bounds, bounds[1:])])
                rows = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column(c)) for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays([*rows, pa.array([trees], pa.binary())], names=["ids", "labels", "trees"])

    return kept.mapInArrow(run, schema.add("trees", "binary"))


def limbs(values: np.ndarray) -> np.ndarray:
    """Integers as LIMBS limbs each; the highest has the sign."""
    found = []
    for _ in range(LIMBS - 1):
        found.append((values & ((1 << LIMB) - 1)).astype(np.int64))
        values = values >> LIMB
    return np.stack([*found, values.astype(np.int64)], -1)


def refined(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = [np.zeros(len(b), np.int64) for b in books], [0] * len(books)
        for batch in batches:
            for data in batch.column(0):
                for k, tree in enumerate(unpacked(data.as_py())):
                    count, total = sums(tree, fitting(books[k], tree))
                    counts[k] += count
                    totals[k] = totals[k] + limbs(total)
        for k, (count, total) in enumerate(zip(counts, totals, strict=True)):
            if count.any():
                flat = total.reshape(len(count), -1)
                columns = [pa.array([k] * len(count), pa.int32()), pa.array(range(len(count)), pa.int32()), pa.array(count), pa.array(list(flat), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["position", "entry", "n", "total"])

    partial = blocks.select("trees").mapInArrow(run, "position int, entry int, n long, total array<long>")
    each = partial.select("position", "entry", "n", F.posexplode("total").alias("limb", "part"))
    added = each.groupBy("position", "entry", "limb").agg(F.sum("n").alias("n"), F.sum("part").alias("part"))
    found, totals = [b.copy() for b in books], {}
    for row in added.collect():  # LIMBS times as many rows as the codebooks have integers
        n, total = totals.get((row.position, row.entry, row.limb // LIMBS), (0, 0))
        totals[row.position, row.entry, row.limb // LIMBS] = row.n, total + (row.part << LIMB * (row.limb % LIMBS))
    for (position, entry, place), (n, total) in totals.items():
        if n:
            found[position][entry, place] = total // n
    return found


def fitting(book: np.ndarray, tree: Tree) -> np.ndarray:
    """A codebook (Python integers) in 64 bits, where the tree and the distances to it fit them; else the tree gets Python integers."""
    if tree.points.dtype != object:
        wide = max((abs(int(x)) for x in (*book.flat, *tree.low[0].flat, *tree.high[0].flat)), default=0)
        if book.shape[1] * (4 * wide + 4) ** 2 < 1 << 62:
            return book.astype(np.int64)
        tree.points = tree.points.astype(object)
        tree.low, tree.high, tree.total = ([x.astype(object) for x in nodes] for nodes in (tree.low, tree.high, tree.total))
    return book


def coded(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """id, label, code and error (decimal) of every row of the blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = [assigned(tree, fitting(books[p], tree)) for p, tree in enumerate(unpacked(batch.column("trees")[k].as_py()))]
                codes = np.stack([c for c, _ in found], 1).astype(np.uint8).tobytes().hex()
                errors = [sum(map(int, x)) for x in zip(*(e for _, e in found), strict=True)]
                size = 2 * len(found)
                columns = [pa.array([codes[i : i + size] for i in range(0, len(codes), size)]), pa.array([e if e <= MOST else None for e in errors], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, batch.column("labels")[k].values, *columns], names=["id", "label", "code", "error"])

    schema = blocks.select(F.get("ids", F.lit(0)).alias("id"), F.get("labels", F.lit(0)).alias("label")).schema
    return blocks.mapInArrow(run, schema.add("code", "string").add("error", "long"))


def label_errors(rows: DataFrame) -> DataFrame:
    """rows with label_error, the sum of error over all rows of the same label. A label may have any share of the rows: sums are added up before the
    shuffle, and go to the rows by broadcast or, if there are many, to salted rows."""
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    fits = F.when(total <= Decimal(MOST), total).cast("long")
    by_label = cut(rows.groupBy(F.col("label").alias("own")).agg(F.when(F.count("*") == F.count("error"), fits).alias("label_error")), "labels")
    if by_label.count() <= FEW_LABELS:
        return rows.join(F.broadcast(by_label), rows["label"].eqNullSafe(by_label["own"])).drop("own")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    copies = by_label.withColumn("own_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, salted["label"].eqNullSafe(copies["own"]) & (F.col("salt") == F.col("own_salt"))).drop("own", "salt", "own_salt")


def first_entries(kept: DataFrame, size: int, positions: int, scale: int) -> tuple[int, list[np.ndarray]]:
    """The vectors' length, and the parts of the smallest ids' vectors."""
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector")
    head = first.limit(1).collect()
    length = len(head[0].vector) if head else 0
    rows = [r.vector for r in first.where(F.size("vector") == length).limit(size).collect()] if head else []
    bounds = edges(length, positions)
    values = np.empty((len(rows), length), object)
    for k, row in enumerate(rows):
        values[k, :] = [whole(x, scale) for x in row]
    return length, [values[:, a:b] for a, b in zip(bounds, bounds[1:])]


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.flat).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", size: int = 16, positions: int = 8, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """id_col, code, error, label_error and codebooks_sha256 of every kept row; at most 256 entries to a codebook."""
    kept = kept_vectors(vectors, id_col, vector_col, label_col)
    length, books = first_entries(kept, size, positions, scale)
    blocks = cut(plant(kept.where(F.size("vector") == length), length, positions, scale), "trees")
    for _ in range(rounds if len(books[0]) else 0):
        books = refined(blocks, books)
    odd = kept.where(F.size("vector") != length).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    rows = cut(coded(blocks, books).unionByName(odd), "codes")
    return label_errors(rows).select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
