"""Best-fit packing of token sequences by minimum bin slack.

Only lengths decide a packing, so the planner sees how many pieces there are of each length: at most `capacity` numbers,
whatever the corpus holds. Per bin it takes the longest length left and finds, by subset-sum dynamic programming over a
bitset of reachable sums, the fullest combination of the lengths that are left, or one of long lengths that is fuller than all but a small slack
(the plan with the fewest sequences over a few slacks counts); the combination is then taken out as often as the counts allow. Each such step uses up a length or leaves less of it than one more bin would need, so the
number of combinations is bounded by capacity * log2(pieces), and a combination has at most 63 lengths of 1..2048.

Pieces then take their slots: a piece's rank within its length is counted in parts (by a hash of its key), so that no
length, however common, meets in one task.

Edge cases: a null text is empty and has one token, the end id; repeated rows are packed each; pieces of one document
are numbered from 0; very long texts are encoded whole, then cut. Pieces of equal length take their slots by id, piece and digest; equal
ones are alike. Extra columns are dropped, so their names can't clash. An empty table gives no rows.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import worker
from weftline.session import cut

#: Words whose ids a worker remembers, and characters of the longest of them: both bound their bytes.
REMEMBERED, LONGEST = 500_000, 64
#: ASCII marks that the pre-tokenizer splits from a word that ends in a letter.
MARKS = ".,!?;:*$%&#|"


class Encoder:
    """Ids of texts as the tokenizers library gives them, for tokenizers that drop white space and normalise within words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        from weftline.llm.bpe import byte_chars

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.stand_in = {b: c for c, b in byte_chars().items()}
        self.words: dict[str, bytes] = {}

    def fresh(self, word: str) -> bytes:
        core = word.rstrip(MARKS)
        if core != word and core and core[-1].isalpha() and core[-1].lower().isalpha() and unicodedata.is_normalized("NFC", core):
            return self.ids(core) + self.ids(word[len(core) :])
        if word.isalpha() and "Σ" not in word and unicodedata.is_normalized("NFC", word):
            low = word.lower()
            if low != word:
                return self.ids(low)
            if not word.isascii():
                low = low.encode().decode("latin-1").translate(self.stand_in)
            ids = [t.id for t in self.model.tokenize(low)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def ids(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = self.fresh(word)
            if len(word) <= LONGEST:
                if len(self.words) >= REMEMBERED:
                    self.words.clear()
                self.words[word] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids. Words are what white space leaves: no token, normal form or special string crosses it."""
        if not text:
            return b""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # split() takes these for white space, the tokenizer doesn't
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        get, slow = self.words.get, self.ids
        return b"".join([get(w) or slow(w) for w in text.split()])


def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return worker.only(("encoder", path), lambda: Encoder(path))


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids) of each document's ids and the end id, cut at the capacity."""
    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    size = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows: list[tuple] = []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = own.encode(text) + end_id.to_bytes(4, "little")
                    for k in range(0, len(ids), size):
                        one = ids[k : k + size]
                        rows.append((key, k // size, k // 4, len(one) // 4, zlib.crc32(one)) + ((np.frombuffer(one, "<i4"),) if keep_ids else ()))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * keep_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def fullest(counts: dict[int, int], room: int, slack: int = 0) -> list[tuple[int, int]]:
    """(length, times) whose sum is at most `slack` below the largest one up to room; of such combinations, one with long lengths."""
    reach, steps, inside = 1, [], (1 << (room + 1)) - 1
    for length in sorted(counts):
        left = min(counts[length], room // length)
        if left <= 0:
            continue
        times = 1
        while left > 0:
            take = min(times, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & inside
            left -= take
            times *= 2
    most = reach.bit_length() - 1
    least, chosen = max(0, most - slack), {}
    for length, take, before in reversed(steps):
        size = length * take
        low = max(0, least - size)
        if size <= most and before >> low & ((1 << (most - size - low + 1)) - 1):  # the rest can still end between the two
            chosen[length] = chosen.get(length, 0) + take
            most, least = most - size, low
    return list(chosen.items())


#: Slacks that are tried in turn. A bin that may stay a little emptier takes longer lengths and leaves the short ones, which fill later bins.
SLACKS = (0, 1, 4, 16, 64)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, first sequence, pieces in a sequence, offset) for each rank of each length, from 0.

    Of the plans by each slack, the one with the fewest sequences; none further is made once one has as few as the sum of lengths allows.
    """
    least = -(-sum(k * n for k, n in histogram.items()) // capacity)
    best: tuple[int, list] | None = None
    for slack in SLACKS:
        found = plan_with(histogram, capacity, slack)
        if best is None or found[0] < best[0]:
            best = found
        if best[0] <= least:
            break
    return best[1]


def plan_with(histogram: dict[int, int], capacity: int, slack: int) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """Sequences and slots of the plan with one slack."""
    left = {k: n for k, n in histogram.items() if n > 0}
    used, slots, sequence = dict.fromkeys(left, 0), [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        combination = dict(fullest(left, capacity - longest, slack))
        left[longest] += 1
        combination[longest] = combination.get(longest, 0) + 1
        times, offset = min(left[k] // m for k, m in combination.items()), 0
        for k, m in sorted(combination.items(), reverse=True):
            slots.append((k, used[k], sequence, m, offset))
            offset += k * m
            used[k] += times * m
            left[k] -= times * m
            if not left[k]:
                del left[k]
        sequence += times
    return sequence, slots


def pack(cut_pieces: DataFrame, capacity: int = 2048, rows_in_part: int = 20_000) -> DataFrame:
    """cut_pieces (id, piece, length, ...) with sequence_id and offset. cut_pieces is read three times: pass a written table."""
    by_length = cut_pieces.groupBy("length").count()
    histogram = {r["length"]: r["count"] for r in by_length.collect()}  # at most `capacity` rows
    slots = np.array(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 5)
    starts = (slots[:, 0] << 44) | slots[:, 1]
    shared = cut_pieces.sparkSession.sparkContext.broadcast((starts, slots))
    parts = max(8, sum(histogram.values()) // rows_in_part)

    rows = cut_pieces.withColumn("part", F.pmod(F.xxhash64("id", "piece"), F.lit(parts)))
    counts = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "part").orderBy("id", "piece", "start", "ids_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(inside) - 1).join(first, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("first")).drop("first", "part")
    names = [c for c in ranked.columns if c != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, slots = shared.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(c), np.int64) for c in ("length", "rank"))
            slot = slots[np.searchsorted(starts, (length << 44) | rank, "right") - 1] if len(length) else np.zeros((0, 5), np.int64)
            turn, place = np.divmod(rank - slot[:, 1], np.maximum(slot[:, 3], 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(slot[:, 2] + turn), pa.array(slot[:, 4] + place * length)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{n}` {t}" for n, t in ranked.select(names).dtypes)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece of a document: id_col, piece, start, length, ids_crc32, sequence_id, offset."""
    table = cut(pieces(docs, tokenizer, id_col, text_col, capacity, end_id), "pieces")
    return pack(table, capacity).withColumnRenamed("id", id_col)
