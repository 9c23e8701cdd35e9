"""SimHash near-duplicates for a Jaccard similarity of word shingles: covering first, an exact join for what it can't reach.

A document is the set of the XXH64 hashes of its runs of `words` words. Two are linked if the Jaccard similarity of their
sets, counted exactly, is `least` or more; groups are what links connect, and one row of each group stays.

1. The covering LSH of `simhash` finds fingerprints within `radius` bits. Its candidates are counted exactly, and the
   links among them connect most of a large group of near copies before anything else is compared.
2. At a similarity of 0.8 two fingerprints differ in 10 of 64 bits on average, and a covering of that radius needs thousands of
   tables. So the links that the fingerprints miss come from a prefix join, which misses none: with each set ordered
   from rare to frequent shingles, sets of that similarity share one of their first n - ceil(least * n) + 1. Where the
   first shared shingle stands bounds what can be shared at all, so most pairs need no comparison.

Any order of the shingles gives the same links; rare ones first keeps buckets small. Spark counts all shingles in
tasks and adds up those a task saw twice; of the frequent ones at most MOST are kept (8 MB), the others count as rare.

In each bucket all are compared with one member, the one with the fewest rare shingles: of near copies that is the text they
were made from. Pairs of different groups that still share a bucket are compared then, all of them. Rows of the
bucket's largest group meet only the others, so large groups cost comparisons by member and not by pair.

Edge cases: texts that are null or have no word are equal to one another; fewer words than a shingle has are one shingle; ties
go to the smaller id, then the smaller hash of the text; rows without an id stay only where no row of the group has one; repeated
rows (same id and text) stay or go together; an empty table gives no rows. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import simhash
from weftline.operators.components import components
from weftline.session import cut

#: Nodes up to this many (24 bytes each) are broadcast to the texts; beyond it texts and nodes are shuffled.
FEW = 1 << 19
#: Bits of a set's parities.
PARITIES = 1024
#: Shingles that are told from rare ones: at least FREQUENT texts have them, and there are at most MOST.
FREQUENT, MOST = 32, 1 << 20
#: Sets whose sizes are within a class of this ratio share buckets; and rounding in comparisons of counts.
CLASS, SLACK = 1.05, 1e-9


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    return np.unique(simhash.shingle_hashes(text, words))


def frequent_shingles(docs: DataFrame, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the most frequent shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            found, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            held.clear()
            again = n > 1
            yield pa.RecordBatch.from_arrays([pa.array(found[again].view(np.int64)), pa.array(n[again])], names=["shingle", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.append(shingles(text.as_py(), words))
                size += len(held[-1])
                if size >= 4_000_000:
                    yield from flush()
                    size = 0
        yield from flush()

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = cut(counts.where(F.col("n") >= FREQUENT), "frequent")
    scale = sorted(((r["k"], r["count"]) for r in counts.groupBy(F.floor(F.log2("n") * 4).alias("k")).count().collect()), reverse=True)
    kept, least = 0, None
    for k, n in scale:  # whole classes of counts, the most frequent first
        if kept + n > MOST:
            break
        kept, least = kept + n, k
    rows = (counts.where(F.floor(F.log2("n") * 4) >= least) if least is not None else counts.limit(0)).toArrow()
    found, n = (np.asarray(rows.column(c).combine_chunks(), np.int64) for c in ("shingle", "n"))
    order = np.argsort(found.view(np.uint64))
    return found.view(np.uint64)[order], n[order]


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, least: float) -> DataFrame:
    """Of each row id, version (a hash of the text), node (a hash of the set), n (its size), fingerprint, and the first shingles
    of the set from rare to frequent; common: the share of its shingles that are frequent; parity: for each of PARITIES bins of
    the hashes whether the set has an odd number there. Sets differ by as many shingles at least as parities do."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, text_col, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        for batch in batches:
            rows = []
            for text in batch.column(2):
                hashes = simhash.shingle_hashes(text.as_py(), words)
                own = np.unique(hashes)
                n, times = len(own), np.zeros(len(own), np.int64)
                if n and len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    times = np.where(known[at] == own, counts[at], 0)
                first = np.lexsort((own, times))[: n - int(np.ceil(least * n - SLACK)) + 1]
                node = xxhash.xxh64_intdigest(own.tobytes(), 7)
                odd = np.packbits(np.bincount((own % PARITIES).astype(np.int64), minlength=PARITIES) & 1).view(np.int64)
                rows.append((node, n, simhash.majority(hashes), own[first].view(np.int64), float((times > 0).mean()) if n else 0.0, odd))
            node, n, prints, first, common, odd = zip(*rows, strict=True) if rows else ((),) * 6
            ends = np.concatenate([[0], np.cumsum([len(x) for x in first])])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *first])))
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            columns = [batch.column(0), batch.column(1), signed(node), pa.array(n, pa.int64()), signed(prints), lists, pa.array(common, pa.float64()), pa.array(odd, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "version", "node", "n", "fingerprint", "first", "common", "parity"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, version long, node long, n long, fingerprint long, first array<long>, common double, parity array<long>")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose similarity is `least` or more. Only texts that some pair needs are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), words).view(np.int64) for t in batch.column(1)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["node", "set"])

    pairs = cut(pairs, "pairs")
    wanted = cut(nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", "first_id", "version"), "wanted")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    if wanted.count() <= FEW:
        wanted = F.broadcast(wanted)
    texts = rows.join(wanted, (rows["version"] == wanted["version"]) & rows["id"].eqNullSafe(wanted["first_id"])).select("node", "text")
    sets = cut(texts.mapInArrow(run, "node long, set array<long>").dropDuplicates(["node"]), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    counted = both.select("a", "b", shared.alias("shared"), (F.size("set_a") + F.size("set_b")).alias("total"))
    return cut(counted.where(F.col("shared") >= least * (F.col("total") - F.col("shared")) - SLACK).select("a", "b"), "links")


def possible(n_a: str, at_a: str, n_b: str, at_b: str, least: float):
    """Whether sets of these sizes whose shared shingle stands at these places can be similar, if it is the first they share."""
    total = F.col(n_a) + F.col(n_b)
    return F.least(F.col(n_a) - F.col(at_a), F.col(n_b) - F.col(at_b)) >= least / (1 + least) * total - SLACK


def rooted(slots: DataFrame, links: DataFrame) -> DataFrame:
    """slots with the root of each node's group."""
    return slots.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))


def parted(slots: DataFrame) -> DataFrame:
    """The slots of buckets that hold several groups, with most: the group that the bucket has most members of."""
    groups = slots.groupBy("key", "root").agg(F.count("*").alias("n"))
    several = groups.groupBy("key").agg(F.max_by("root", "n").alias("most"), F.count("*").alias("groups")).where("groups > 1").select("key", "most")
    return cut(slots.join(several, "key"), "parted")


def hub_pairs(slots: DataFrame, least: float) -> DataFrame:
    """Each member of a bucket with the member that has the fewest rare shingles."""
    hubs = slots.groupBy("key").agg(F.max(F.struct("common", "node", "n", "at", "root")).alias("hub")).select("key", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("node", "n", "at", "root")])
    met = slots.join(hubs, "key").where((F.col("root") != F.col("hub_root")) & possible("n", "at", "hub_n", "hub_at", least))
    return met.select(F.least("node", "hub_node").alias("a"), F.greatest("node", "hub_node").alias("b")).distinct()


def all_pairs(slots: DataFrame, least: float) -> DataFrame:
    """The pairs of different groups that share a bucket and can be similar; most: the bucket's largest group."""
    size_class = lambda n: F.floor(F.log(n) / float(np.log(CLASS)) + SLACK).cast("int")
    # The larger set of a pair looks for smaller ones: how small and how large they can be follows from its size and place.
    low = F.greatest(F.lit(1), F.ceil(least * F.col("n") - SLACK))
    high = F.least(F.col("n"), F.floor((F.col("n") - F.col("at")) * (1 + least) / least - F.col("n") + SLACK))
    names = ("node", "n", "at", "root")
    inner = F.col("root") == F.col("most")
    smaller = slots.select("key", size_class(F.col("n")).alias("class"), inner.alias("inner"), *[F.col(c).alias(f"{c}_b") for c in names])
    larger = slots.where(high >= low).select("key", F.explode(F.sequence(size_class(low), size_class(high))).alias("class"), inner.alias("inner"), *[F.col(c).alias(f"{c}_a") for c in names])
    ordered = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") > F.col("node_b")))
    fit = (F.col("root_a") != F.col("root_b")) & ordered & possible("n_a", "at_a", "n_b", "at_b", least)
    met = [
        one.drop("inner").join(other.drop("inner"), ["key", "class"]).where(fit).select("node_a", "node_b")
        for one, other in ((larger, smaller.where("not inner")), (larger.where("not inner"), smaller.where("inner")))
    ]
    pairs = met[0].unionAll(met[1])
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def similar_links(docs: DataFrame, prints: DataFrame, nodes: DataFrame, id_col: str, text_col: str, words: int, least: float, radius: int) -> DataFrame:
    """Links (a, b) between nodes that connect all nodes whose similarity is `least` or more."""
    how = (nodes, docs, id_col, text_col, words, least)
    sizes = nodes.select("node", "n", "parity")

    def alike(pairs: DataFrame) -> DataFrame:
        """The pairs that their parities don't rule out."""
        both = pairs.join(sizes.toDF("a", "n_a", "parity_a"), "a").join(sizes.toDF("b", "n_b", "parity_b"), "b")
        differ = F.aggregate(F.zip_with("parity_a", "parity_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
        shared = (F.col("n_a") + F.col("n_b") - differ) / 2
        return both.where(shared >= least / (1 + least) * (F.col("n_a") + F.col("n_b")) - SLACK).select("a", "b")

    by_print = nodes.where("n > 0").groupBy("fingerprint").agg(F.min("node").alias("least"))
    same = nodes.where("n > 0").join(by_print, "fingerprint").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    covered = simhash.links(by_print.select("fingerprint", F.col("least").alias("node")), radius)
    links = verified(same.unionByName(covered), *how)

    slots = prints.select("node", F.posexplode("first").alias("at", "key"))
    shared = slots.groupBy("key").count().where("count > 1").select("key")
    slots = cut(slots.join(shared, "key").distinct().join(nodes.select("node", "n", "common"), "node"), "slots")
    links = links.unionByName(verified(alike(hub_pairs(parted(rooted(slots, links)), least)), *how))
    return links.unionByName(verified(alike(all_pairs(parted(rooted(slots, links)), least)), *how))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, radius: int = 4) -> DataFrame:
    """Of each group the rows with its smallest id (null only if no row has one) and, of that id, the text of least hash."""
    prints = cut(signatures(docs, id_col, text_col, words, least), "signatures")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("first_id"), "version")
    # Rows of one node have one set: only the fingerprint may differ, as repeats count in it.
    about = F.min(F.struct("fingerprint", "common", "parity")).alias("about")
    nodes = cut(prints.groupBy("node", "n").agg(about, F.min(order).alias("first")).select("node", "n", "about.*", "first.*"), "nodes")
    roots = components(similar_links(docs, prints, nodes, id_col, text_col, words, least, radius))
    first = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("none", "first_id", "version")).alias("first"))
    kept = first.select(F.col("first.first_id").alias("kept_id"), F.col("first.version").alias("kept_version"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("version"))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("version") == F.col("kept_version"))
    return rows.join(kept, same, "left_semi").select("row.*")
