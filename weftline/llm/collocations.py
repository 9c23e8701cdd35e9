"""Phrase collocation mining: contiguous phrases of several words that stand together more often than their parts suggest.

Texts are split into pieces and equal pieces are counted once, with their multiplicity. Chunks of different pieces count their own
phrases, weighted by multiplicity, and send them to hash buckets: one compressed table for each chunk and bucket, so a phrase, however
frequent, is sent once by a chunk and no bucket gets more than its share. Each bucket adds up what all chunks have sent in DuckDB, which
spills to the task's own temporary folder, and returns the phrases that are frequent. That is done for words, then for pairs of words,
then for longer phrases: a phrase can only be frequent if the shorter ones inside it are, so a chunk sends only those whose parts may be.
It tells that by a bit for each hash of a frequent part: FILTER bits whatever the corpus, so a full filter lets more through but
loses nothing. What follows is plain joins over the frequent phrases: every way to cut a candidate asks for the counts of its parts
(a request shuffled to where the part is), candidates that a longer one absorbs go, and the best of each language stay.

A part is at least as frequent as the phrase it is cut from, so the frequent phrases have all parts. Scores are integer divisions
of decimals, exact beyond 64 bits.

Edge cases: a null text is empty; a null language is `und`, like that string; pieces without a word count nothing; words and pieces may have any length
(a chunk works on slices of PLACES words that overlap). Ties are ordered by phrase, in byte order. Repeated rows count each. An empty
table gives no rows. Extra columns are dropped, so their names can't clash. A language whose phrases are all rare has no rows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from functools import reduce

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of pieces in a chunk; places of a chunk at which phrases are counted in one go; memory of a bucket's tables; bits of the filter.
CHUNK, PLACES, MEMORY, FILTER = 1 << 23, 1 << 20, "256MB", 1 << 26
#: Parts in which a language's phrases are ranked.
PARTS = 32
U64 = np.uint64
COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, piece (words joined by single spaces) and n, how often it stands in all texts."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    parts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.explode(F.split(text, r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    words = parts.select("lang", F.trim(F.regexp_replace("piece", "[\x20\x09]+", " ")).alias("piece"))
    return words.where("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("n"))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(31))


class Chunk:
    """The words of some pieces one after the other; a word's number is its place in the sorted dictionary."""

    def __init__(self, langs: pa.Array, texts: pa.Array, weights: np.ndarray):
        coded = langs.dictionary_encode()
        self.langs, piece_lang = coded.dictionary, coded.indices.to_numpy()
        data = np.frombuffer(("\n".join(texts.to_pylist()) + "\n").encode(), np.uint8)
        ends = np.flatnonzero((data == 32) | (data == 10))
        last = data[ends] == 10
        # Every word with the blank after it, as one array over the same bytes.
        data = np.where(data == 10, np.uint8(32), data)
        offsets = np.concatenate([[0], ends + 1]).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        names = words.dictionary
        order = pc.sort_indices(names).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.names = names.take(pa.array(order))
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.names.to_pylist()), U64, len(order))
        self.words = rank[words.indices.to_numpy()]
        piece = np.concatenate([[0], np.cumsum(last)[:-1]]) if len(last) else np.zeros(0, np.int64)
        self.lang, self.weight = piece_lang[piece], weights[piece]
        self.left = np.flatnonzero(last)[piece] - np.arange(len(piece)) + 1  # words up to the end of the piece
        self.lang_keys = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in self.langs.to_pylist()), U64, len(self.langs))
        self.small = float(self.weight.sum(dtype=float)) < 2.0**52  # then sums of weights are exact as floats

    def keys(self, place: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the phrases of `size` words at these places."""
        key = self.lang_keys[self.lang[place]]
        for j in range(size):
            key = mixed(key + self.hashes[self.words[place + j]])
        return key

    def may(self, start: int, stop: int, part: int, bits: np.ndarray | None) -> np.ndarray:
        """At which places a phrase of `part` words stands that may be frequent; `stop` may lie beyond the words."""
        fits = np.zeros(stop - start, bool)
        place = np.flatnonzero(self.left[start:stop] >= part) + start
        if bits is not None:
            bit = self.keys(place, part) % U64(FILTER)
            place = place[(bits[(bit >> U64(3)).astype(np.int64)] >> (bit & U64(7)).astype(np.uint8) & 1).astype(bool)]
        fits[place - start] = True
        return fits

    def phrases(self, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """One place and the weight of each different phrase of `size` words at these places."""
        code, base, most = self.lang[place].astype(np.int64), len(self.names), len(self.langs)
        for j in range(size):
            if most * base >= 1 << 62:
                different, code = np.unique(code, return_inverse=True)
                most = len(different)
            code, most = code * base + self.words[place + j], most * base
        different, first, inverse = np.unique(code, return_index=True, return_inverse=True)
        if self.small:
            return place[first], np.bincount(inverse, self.weight[place], len(different)).astype(np.int64)
        n = np.zeros(len(different), np.int64)
        np.add.at(n, inverse, self.weight[place])
        return place[first], n

    def tables(self, buckets: int, part: int, sizes: Iterable[int], bits: np.ndarray | None) -> Iterator[tuple[int, pa.RecordBatch]]:
        """A bucket and the counts that it gets, of phrases of these sizes whose parts may all be frequent."""
        for start in range(0, len(self.words), PLACES):
            stop = min(start + PLACES, len(self.words))
            fits = self.may(start, stop + max(sizes), part, bits)
            for size in sizes:
                all_fit = fits[: stop - start] & (self.left[start:stop] >= size)
                for j in range(1, size - part + 1) if part else ():
                    all_fit &= fits[j : stop - start + j]
                place, n = self.phrases(np.flatnonzero(all_fit) + start, size)
                bucket = (self.keys(place, size) % U64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                place, n, bounds = place[order], n[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
                text = self.names.take(pa.array(self.words[place]))
                for j in range(1, size):
                    text = pc.binary_join_element_wise(text, self.names.take(pa.array(self.words[place + j])), pa.scalar("", pa.large_string()))
                text, lang = pc.utf8_rtrim(text, " ").cast(pa.string()), self.langs.take(pa.array(self.lang[place]))
                for b, (i, j) in enumerate(zip(bounds, bounds[1:])):
                    if i < j:
                        yield b, pa.RecordBatch.from_arrays([lang[i:j], text[i:j], pa.array(n[i:j])], schema=COUNTED)


def key_of(lang: str, phrase: str) -> int:
    """The hash of one phrase, as a chunk has it, as a signed number."""
    key = np.array([xxhash.xxh3_64_intdigest(lang)], U64)
    for word in phrase.split(" "):
        key = mixed(key + U64(xxhash.xxh3_64_intdigest(word + " ")))
    return int(key.view(np.int64)[0])


def to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def requests(buckets: int, part: int, sizes: tuple[int, ...], packed: bytes | None):
    """Chunks of pieces; for each bucket what it should count. `packed` is the filter of frequent phrases of `part` words."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
        held, size = [], 0
        for batch in batches:
            begin, sizes = 0, np.cumsum(pc.binary_length(batch.column("piece")).to_numpy())
            while begin < batch.num_rows:
                done = int(sizes[begin - 1]) if begin else 0
                end = max(begin + 1, int(np.searchsorted(sizes, done + CHUNK - size, "right")))
                held.append(batch.slice(begin, end - begin))
                size, begin = size + int(sizes[end - 1]) - done, end
                if size >= CHUNK or end < batch.num_rows:
                    yield made(held)
                    held, size = [], 0
        if held:
            yield made(held)

    def made(held: list[pa.RecordBatch]) -> Chunk:
        table = pa.Table.from_batches(held).combine_chunks()
        lang, piece = (table.column(c).combine_chunks() for c in ("lang", "piece"))
        return Chunk(lang, piece, table.column("n").to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if packed is None else np.frombuffer(zstandard.decompress(packed), np.uint8)
        for chunk in chunks(batches):
            for bucket, batch in chunk.tables(buckets, part, sizes, bits):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([to_bytes(batch)], pa.binary())], names=["bucket", "counts"])

    return run


def added_up(least: int):
    """The buckets of a task: the phrases that are frequent in all, with their hashes, and, with a null phrase, each language's count of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column("counts"):
                    yield from pa.ipc.open_stream(data.as_py())

        with tempfile.TemporaryDirectory(prefix="counts-") as folder, duckdb.connect(f"{folder}/counts.db") as db:
            db.execute(f"SET memory_limit = '{MEMORY}'; SET threads = 1; SET temp_directory = '{folder}'; SET preserve_insertion_order = false")
            db.register("sent", pa.RecordBatchReader.from_batches(COUNTED, sent()))
            db.execute("CREATE TABLE counts AS SELECT lang, phrase, sum(n) AS n FROM sent GROUP BY lang, phrase")
            found = db.sql(f"SELECT lang, phrase, n::BIGINT AS n FROM counts WHERE n >= {least} UNION ALL SELECT lang, NULL, sum(n)::BIGINT FROM counts GROUP BY lang")
            for batch in found.to_arrow_reader(1 << 14).cast(COUNTED):
                keys = [None if p is None else key_of(x, p) for x, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*COUNTED.names, "key"])

    return run


def filter_of(found: DataFrame) -> bytes:
    """A bit for each hash, compressed: at most FILTER / 64 words reach the driver."""
    place = F.col("key").bitwiseAND(F.lit(FILTER - 1))
    words = found.where("key IS NOT NULL").groupBy(F.shiftrightunsigned(place, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("bits"))
    rows = words.toArrow()
    bits = np.zeros(FILTER // 64, "<i8")
    bits[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return zstandard.compress(bits.tobytes(), 1)


def phrase_counts(docs: DataFrame, least: int = 30, longest: int = 4, text_col: str = "text", lang_col: str = "lang", buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Phrases (lang, phrase, n) of at most `longest` words that stand `least` times at least; and all words of each language (lang, n)."""
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once, found, bits = cut(pieces(docs, text_col, lang_col), "pieces"), [], None
    for part, sizes in ((0, (1,)), (1, (2,)), (2, tuple(range(3, longest + 1)))):
        if sizes and sizes[0] <= longest:
            sent = once.mapInArrow(requests(buckets, part, sizes, bits), "bucket int, counts binary")
            found.append(cut(sent.repartitionById(buckets, "bucket").mapInArrow(added_up(least), "lang string, phrase string, n long, key long"), "phrases"))
            bits = filter_of(found[-1])
    counts = reduce(DataFrame.unionByName, found).where("phrase IS NOT NULL").select("lang", "phrase", "n")
    return counts, found[0].where("phrase IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))


def part(words: Column, start: int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(counts: DataFrame, longest: int = 4) -> DataFrame:
    """lang, phrase, a, l, r and score of every phrase of two words and more, by its lowest cut."""
    words = F.split("phrase", " ", -1)
    phrases = counts.select("lang", "phrase", F.col("n").alias("a"), words.alias("words")).where(F.size("words") >= 2)
    cuts = phrases.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    asked = cuts.select("lang", "phrase", "a", F.explode(F.array(
        F.struct((2 * F.col("k")).alias("slot"), part(F.col("words"), 1, F.col("k")).alias("part")),
        F.struct((2 * F.col("k") + 1).alias("slot"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ").alias("part")),
    )).alias("x")).select("lang", "phrase", "a", "x.*")
    answers = asked.join(counts.select("lang", F.col("phrase").alias("part"), "n"), ["lang", "part"])
    slots = [F.max(F.when(F.col("slot") == s, F.col("n"))).alias(f"s{s}") for s in range(2, 2 * longest)]
    known = answers.groupBy("lang", "phrase", "a").agg(*slots)
    wide = "cast(a as decimal(19, 0)) * 2000000 div (cast(s{0} as decimal(19, 0)) + cast(s{1} as decimal(19, 0)))"
    cut_of = [
        F.when(F.col(f"s{2 * k}").isNotNull(), F.struct(F.expr(wide.format(2 * k, 2 * k + 1)).alias("score"), F.lit(k).alias("k"), F.col(f"s{2 * k}").alias("l"), F.col(f"s{2 * k + 1}").alias("r")))
        for k in range(1, longest)
    ]
    lowest = F.array_min(F.filter(F.array(*cut_of), lambda c: c.isNotNull()))
    return known.withColumn("cut", lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def absorbed(counts: DataFrame, share: int = 80) -> DataFrame:
    """lang and phrase of what stands inside a longer phrase with at least `share` percent of its count."""
    longer = counts.select("lang", "n", F.split("phrase", " ", -1).alias("words")).where(F.size("words") >= 3)
    sizes = F.sequence(F.lit(2), F.size("words") - 1)
    inner = F.flatten(F.transform(sizes, lambda s: F.transform(F.sequence(F.lit(1), F.size("words") - s + 1), lambda i: F.array_join(F.slice("words", i, s), " "))))
    most = longer.select("lang", F.explode(inner).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    both = most.join(counts, ["lang", "phrase"])
    return both.where(f"cast(longer as decimal(19, 0)) * 100 >= cast(n as decimal(19, 0)) * {share}").select("lang", "phrase")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, longest: int = 4, share: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n and score."""
    counts, totals = phrase_counts(docs, least, longest, text_col, lang_col)
    found = scored(counts, longest).join(absorbed(counts, share), ["lang", "phrase"], "left_anti")
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    # A language may have most phrases: parts of it are ranked first, and only their best come together.
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    best = found.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
