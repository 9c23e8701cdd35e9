"""Language-model scoring with a weighted back-off automaton.

Tokens are words and one end for each text. The states are the root, the start, and every n-gram of up to `order` - 1
tokens that training text goes on after. A state has an arc for each token seen after it; its failure arc leads to the
n-gram without its first token, in the end to the root, which has an arc for each word and one loop for all unknown ones. With
c for counts, weights are log10 of

    p(v | root) = (c(v) + 1) / (N + V + 1)          p(v | s) = (c(s v) + m p(v | s')) / (c(s) + m)      s' : s without its first token

on arcs, and of m / (c(s) + m) on failure arcs (a Dirichlet prior around the shorter context; m = `scale` * c ** `power`
for contexts of one token, `first` / c + c ** `growth` for longer ones, so that what was seen once counts little and what was
seen again counts much). An arc leads to the longest state that its history ends in. A text is read once from left to right:
a token takes its state's arc, or failure arcs until a state has one. Texts are read side by side, and very long ones in parts
that start with the last `order` - 1 tokens of the part before, which lead to the same state.

The automaton grows with the corpus, so no task holds all of it. Texts are packed into blocks and blocks dealt into chunks of
some megabytes. A chunk sends the hashes and training counts of its different n-grams, packed, to the hash buckets; a
bucket sums what all chunks have sent and answers each with the sums; with these a chunk builds the part of the automaton
that its own texts can reach. An n-gram, however frequent, is sent once by a chunk, so no bucket gets more than its share.
The number of buckets grows with the text, so what one holds stays the same.

Words are told apart by 44 bits and their bucket, longer n-grams by 24 bits more than number those that a chunk sends to a bucket (8 more
for many chunks): about one in 2^24 / chunks shares a count.

Edge cases: a null or empty text is its end token alone; with no training text all counts are zero and N is 0; a null id is
in the training part; repeated rows are scored and, if in the training part, counted each; an empty table gives no rows. Texts
of any length are read whole; one text is in one task. Extra columns are dropped, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.language import held_out

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
END, START = U64(0x1B873593CC9E2D51), U64(0x85EBCA6B27D4EB2F)
SLICE = 1 << 20
#: Groups up to this many are placed one to a partition.
MOST_SPREAD = 4096
#: Bytes of text in a block; tokens of a text that are read in one go.
BLOCK, PART = 1 << 18, 1024
#: Bits of a word's hash beside its bucket's, and bytes of them that are packed as they are.
WORD_BITS, WORD_LOW = 44, 4


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: list[np.ndarray] = [np.ones(1, np.uint64)]


def powers(n: int) -> np.ndarray:
    if len(_powers[0]) < n:
        size = max(n, 4096)
        _powers[0] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, BASE)]))
    return _powers[0]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of data; read in slices that end at white space."""
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        raw = np.frombuffer(data, np.uint8, end - at, at)
        inside = np.concatenate([[False], (raw != 32) & ((raw < 9) | (raw > 13)), [False]])
        change = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = change[::2], change[1::2]
        if len(first):
            size = last - first
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            letters = raw[inside[1:-1]].astype(np.uint64) + U64(1)
            sums = np.add.reduceat(letters * powers(int(size.max()))[place], np.cumsum(size) - size)
            hashes.append(mix(sums + size.astype(np.uint64) * U64(0xD6E8FEB86659FD93)))
            starts.append(first + at)
        at = end
    none = np.zeros(0, np.int64)
    return np.concatenate([none.view(np.uint64), *hashes]), np.concatenate([none, *starts])


def narrow(numbers: np.ndarray) -> bytes:
    """Numbers from 0 in the fewest bytes each, compressed: most are one."""
    most = int(numbers.max(initial=0))
    return zstandard.compress(numbers.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if most < 1 << 8 * int(t[2]))).tobytes(), 1)


def widened(packed: bytes, n: int) -> np.ndarray:
    data = zstandard.decompress(packed, max_output_size=8 * n) if n else b""
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def counted(keys: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys (below 2^63), sorted, and how often each is trained on."""
    both = np.sort(keys << U64(1) | trained.astype(np.uint64))
    own = both >> U64(1)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    return own[first], np.add.reduceat((both & U64(1)).astype(np.int64), first) if len(own) else first


def pack_sorted(values: np.ndarray, low: int) -> tuple[bytes, bytes]:
    """Sorted numbers: `low` bytes of each, and above them a bit for each number and each step."""
    high = (values >> U64(8 * low)).astype(np.int64)
    bits = np.zeros(int(high[-1]) + len(values) if len(values) else 0, np.uint8)
    bits[high + np.arange(len(values))] = 1
    lows = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low]).tobytes()
    return lows, np.packbits(bits).tobytes()


def unpack_sorted(lows: bytes, bits: bytes, low: int) -> np.ndarray:
    n = len(lows) // low
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :low] = np.frombuffer(lows, np.uint8).reshape(-1, low)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))[:n] - np.arange(n)
    return wide.view("<u8").ravel() | high.astype(np.uint64) << U64(8 * low)


class Chunk:
    """The tokens of some texts, each text after a start, and their different words and longer n-grams."""

    def __init__(self, texts: list[bytes | None], trains: np.ndarray, order: int, width: int):
        texts = [(t or b"").lower() for t in texts]
        hashes, starts = word_hashes(b"\n".join(texts))
        begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        doc = np.searchsorted(begin, starts, "right") - 1
        self.order, self.width = order, width
        self.n_tokens = np.bincount(doc, minlength=len(texts)) + 1
        sizes = self.n_tokens + 1
        self.last = np.cumsum(sizes) - 1
        self.start = self.last - self.n_tokens
        self.tokens = np.empty(int(sizes.sum()), np.uint64)
        self.tokens[np.arange(len(doc)) + 2 * doc + 1] = hashes >> U64(1)
        self.tokens[self.last], self.tokens[self.start] = END >> U64(1), START >> U64(1)
        self.at = (np.arange(len(self.tokens)) - np.repeat(self.start, sizes)).astype(np.int32)
        self.trained = np.repeat(trains, sizes)

    def long_keys(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length from two, the places where such n-grams end and their hashes of `width` bits."""
        own = self.tokens
        for k in range(1, self.order):
            own = np.concatenate([own[:1], mix(own[:-1] * U64(3) + U64(k)) + self.tokens[1:]])
            place = np.flatnonzero(self.at >= k)
            yield place, mix(own[place] + U64(k)) >> U64(64 - self.width)

    def requests(self, bits: int, low: int) -> Iterator[tuple]:
        """bucket, packed hashes and counts of words, packed hashes and counts of longer n-grams; one for each bucket."""
        real = self.at > 0
        words, word_counts = counted(self.tokens[real] >> U64(63 - WORD_BITS - bits), self.trained[real])
        long = list(self.long_keys())
        grams, gram_counts = counted(np.concatenate([k for _, k in long]), np.concatenate([self.trained[p] for p, _ in long])) if long else (words[:0], word_counts[:0])
        edges = np.arange(1, 1 << bits)
        inside = self.width - bits
        ones = np.split(np.arange(len(words)), np.searchsorted(words >> U64(WORD_BITS), edges))
        more = np.split(np.arange(len(grams)), np.searchsorted(grams >> U64(inside), edges))
        for bucket, (a, b) in enumerate(zip(ones, more, strict=True)):
            alone, packed = (pack_sorted(x & U64((1 << n) - 1), k) for x, n, k in ((words[a], WORD_BITS, WORD_LOW), (grams[b], inside, low)))
            yield (bucket, *alone, narrow(word_counts[a]), *packed, narrow(gram_counts[b]))

    def number(self, bits: int) -> None:
        """Nodes number the n-grams: 0 is the root, then the words, the start, and the longer ones; node[k] has for each place
        the node of the k + 1 tokens that end there (-1: the text is shorter)."""
        real = self.at > 0
        self.words, inverse = np.unique(self.tokens[real] >> U64(63 - WORD_BITS - bits), return_inverse=True)
        self.end = int(np.searchsorted(self.words, END >> U64(64 - WORD_BITS - bits))) + 1
        self.node = np.full((self.order, len(self.tokens)), -1, np.int32)
        self.node[0, real] = inverse + 1
        self.node[0, self.start] = len(self.words) + 1
        long = list(self.long_keys())
        self.grams, inverse = np.unique(np.concatenate([np.zeros(0, np.uint64), *(k for _, k in long)]), return_inverse=True)
        del self.tokens, self.trained
        for k, (place, _) in enumerate(long, 1):
            mine, inverse = inverse[: len(place)], inverse[len(place) :]
            self.node[k, place] = mine + len(self.words) + 2


class Automaton:
    """The part that a chunk's texts reach: for each node the arc that its last token takes, and the state it leads to."""

    def __init__(self, chunk: Chunk, word_totals: np.ndarray, gram_totals: np.ndarray, tokens: int, different: int, prior: tuple[float, float, float, float]):
        node, first = chunk.node, len(chunk.words) + 2
        size = first + len(chunk.grams)
        texts = word_totals[chunk.end - 1] if len(word_totals) else 0
        count = np.concatenate([[tokens], word_totals, [texts], gram_totals]).astype(float)
        scale, power, once, growth = prior
        seen, place = np.unique(np.maximum(count[first:], 1).astype(np.int64), return_inverse=True)  # few are different
        mass = np.concatenate([scale * np.maximum(count[:first], 1) ** power, (once / seen + seen**growth)[place]])
        # The failure arcs of states.
        self.back = np.where(count > 0, np.log10(mass / (count + mass)), 0.0)
        self.suffix, source, label, level = (np.zeros(size, t) for t in (np.int32, np.int32, np.int32, np.int8))
        for k in range(1, chunk.order):
            place = np.flatnonzero(node[k] >= 0)
            gram = node[k, place]  # all places of an n-gram say the same
            self.suffix[gram], source[gram], label[gram], level[gram] = node[k - 1, place], node[k - 1, place - 1], node[0, place], k
        # The arcs, shorter contexts first.
        p = np.zeros(size)
        p[1 : first - 1] = (word_totals + 1.0) / (tokens + different + 1.0)
        for k in range(1, chunk.order):
            of = np.flatnonzero(level == k)
            p[of] = (count[of] + mass[source[of]] * p[self.suffix[of]]) / (count[source[of]] + mass[source[of]])
        self.weight = np.log10(np.where(p > 0, p, 1.0))
        self.root = np.concatenate([[0.0], self.weight[1 : first - 1], [0.0]])
        self.known = count[:first] > 0
        # Where arcs lead: to the n-gram itself if it is a state, else to its longest ending that is one.
        longest = level < chunk.order - 1
        self.target = np.where(longest & (count > 0), np.arange(size, dtype=np.int32), self.suffix)
        while len(short := np.flatnonzero((self.target > 0) & (count[self.target] == 0))):
            self.target[short] = self.suffix[self.target[short]]
        self.target[label == chunk.end] = 0  # nothing goes on after the end
        arcs = np.flatnonzero((level > 0) & (count > 0)).astype(np.int32)
        del mass, p, longest, count
        keys = source[arcs].astype(np.int64) << 32 | label[arcs]
        order = np.argsort(keys)
        self.keys, self.arcs = keys[order], arcs[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states that these tokens lead to from these states, and the weights on the way."""
        state, weight = state.copy(), np.zeros(len(state))
        todo = np.flatnonzero(state > 0)
        at_root = np.flatnonzero(state == 0)
        while len(todo):
            keys = state[todo].astype(np.int64) << 32 | word[todo]
            at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
            hit = self.keys[at] == keys if len(self.keys) else np.zeros(len(todo), bool)
            took = self.arcs[at[hit]] if len(self.keys) else at[:0]
            weight[todo[hit]] += self.weight[took]
            state[todo[hit]] = self.target[took]
            todo = todo[~hit]
            weight[todo] += self.back[state[todo]]
            state[todo] = self.suffix[state[todo]]
            at_root = np.concatenate([at_root, todo[state[todo] == 0]])
            todo = todo[state[todo] > 0]
        weight[at_root] += self.root[word[at_root]]
        state[at_root] = np.where(self.known[word[at_root]], word[at_root], 0)
        return state, weight

    def scores(self, chunk: Chunk) -> np.ndarray:
        """The log10 probability of each text: one traversal, all texts side by side."""
        word, warm = chunk.node[0], chunk.order - 1
        parts = -(-chunk.n_tokens // PART)
        text = np.repeat(np.arange(len(parts)), parts)
        part = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = chunk.start[text] + 1 + part * PART
        end = np.minimum(begin + PART, chunk.last[text] + 1)
        # A part starts in the start's state, or warms up on the tokens before it from the root.
        at, state = np.where(part > 0, begin - warm, begin), np.where(part > 0, 0, len(chunk.words) + 1)
        state = np.where(self.known[state], state, 0).astype(np.int32)
        order = np.argsort(at - end, kind="stable")  # the longest first: those that still read are a head of the arrays
        at, begin, end, state, text = (x[order] for x in (at, begin, end, state, text))
        sums, reading = np.zeros(len(at)), len(at)
        for _ in range(int((end - at).max(initial=0))):
            while reading and at[reading - 1] >= end[reading - 1]:
                reading -= 1
            now = at[:reading]
            state[:reading], weight = self.step(state[:reading], word[now])
            sums[:reading] += np.where(now >= begin[:reading], weight, 0.0)
            at[:reading] += 1
        return np.bincount(text, sums, minlength=len(parts))


def spread_keys(spark: SparkSession, n: int) -> list[int]:
    """n different keys, the i-th of which Spark's hash partitioning deals to partition i of n: no task gets two groups.

    Beyond MOST_SPREAD groups plain numbers will do. This only places work; results don't depend on it.
    """
    if n > MOST_SPREAD:
        return list(range(n))
    key = F.col("id").cast("int")
    rows = spark.range(n * 20, numPartitions=1).groupBy(F.pmod(F.hash(key), F.lit(n)).alias("p")).agg(F.min(key).alias("k")).collect()
    known = {r["p"]: r["k"] for r in rows}
    return [known.get(i, -1 - i) for i in range(n)]


def blocks(docs: DataFrame, id_col: str, text_col: str, modulus: int, remainder: int, chunks: int) -> DataFrame:
    """chunk and the ids, parts and compressed texts of some rows; blocks are dealt by a hash of their first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
            cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // BLOCK)) + 1 if len(texts) else []
            rows = []
            for at in filter(len, np.split(np.arange(len(texts)), cuts)):
                a, b = int(at[0]), int(at[-1]) + 1
                lengths = np.array([-1 if t is None else len(t) for t in texts[a:b]], "<i8")
                raw = b"".join(t or b"" for t in texts[a:b])
                ids = batch.column("id").slice(a, b - a).to_pylist()
                rows.append((batch.column("deal")[a].as_py() % chunks, ids, batch.column("held_out").slice(a, b - a).to_pylist(), lengths.tobytes(), len(raw), zstandard.compress(raw, 3)))
            kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.int64(), pa.binary()]
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["chunk", "ids", "held_out", "lengths", "size", "texts"])

    held = F.coalesce(held_out(id_col, modulus, remainder), F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held_out"), F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 40)).alias("deal"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "chunk int, ids array<long>, held_out array<boolean>, lengths binary, size long, texts binary")


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2, order: int = 4,
    scale: float = 6.0, power: float = 0.85, first: float = 8.0, growth: float = 0.8, chunk_bytes: int = 6 << 20,
) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs.

    chunk_bytes: text in a chunk; a task takes about twenty times that. Chunks times buckets are the questions asked, so
    for tens of TB a chunk should have 64 MB or more.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // chunk_bytes))
    bits = min(19, max(3, (chunks - 1).bit_length()))
    places = spread_keys(spark, 1 << bits)
    low = 3 if chunks <= 1 << 14 else 4
    expected = max(1, min(size, chunk_bytes) * (order - 1) // 6 >> bits)
    width = min(63, bits + 8 * low + expected.bit_length())
    deal = F.col("chunk") if chunks > MOST_SPREAD else F.get(F.lit(spread_keys(spark, chunks)), F.col("chunk"))
    rows = blocks(docs, id_col, text_col, modulus, remainder, chunks).withColumn("chunk", deal).repartition(chunks, "chunk")

    def read(table: pa.Table) -> tuple[Chunk, list[int | None], np.ndarray]:
        """The chunk, ids and parts of the rows; blocks are ordered by what they hold."""
        blocks_, texts, ids, held = [], [], [], []
        for packed, lengths, own, parts, raw_size in zip(*(table.column(c).to_pylist() for c in ("texts", "lengths", "ids", "held_out", "size")), strict=True):
            blocks_.append((packed, lengths, own, parts, raw_size))
        for packed, lengths, own, parts, raw_size in sorted(blocks_, key=lambda x: (x[0], x[1], str(x[2]))):
            raw, sizes = zstandard.decompress(packed, max_output_size=raw_size), np.frombuffer(lengths, "<i8")
            ends = np.cumsum(np.maximum(sizes, 0))
            texts += [raw[b - max(n, 0) : b] for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            ids += own
            held += parts
        return Chunk(texts, ~np.array(held, bool), order, width), ids, np.array(held, bool)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        columns = list(zip(*read(table)[0].requests(bits, low), strict=True))
        kinds = [pa.int32(), *[pa.binary()] * 6]
        made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        same = pa.array([key[0].as_py()] * len(columns[0]), pa.int32())
        return pa.Table.from_arrays([same, pa.array(places, pa.int32()), *made], names=["chunk", "place", "bucket", "word_lows", "word_highs", "word_counts", "lows", "highs", "gram_counts"])

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        def sums(hashes: list[np.ndarray], counts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
            _, place = np.unique(np.concatenate(hashes), return_inverse=True)
            total = np.bincount(place, np.concatenate([widened(c, len(h)) for c, h in zip(counts, hashes, strict=True)])).astype(np.int64)
            ends = np.cumsum([len(h) for h in hashes])[:-1]
            return [narrow(total[p]) for p in np.split(place, ends)], total

        column = lambda c: table.column(c).to_pylist()
        unpacked = lambda a, b, low: [unpack_sorted(x, y, low) for x, y in zip(column(a), column(b), strict=True)]
        words, total = sums(unpacked("word_lows", "word_highs", WORD_LOW), column("word_counts"))
        grams, _ = sums(unpacked("lows", "highs", low), column("gram_counts"))
        same = lambda x, kind: pa.array([int(x)] * len(words), kind)
        arrays = [table.column("chunk").combine_chunks(), table.column("bucket").combine_chunks(), pa.array(words, pa.binary()), pa.array(grams, pa.binary())]
        return pa.Table.from_arrays([*arrays, same(total.sum(), pa.int64()), same((total > 0).sum(), pa.int64())], names=["chunk", "bucket", "words", "grams", "tokens", "different"])

    def finish(texts: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("bucket")
        chunk, ids, held = read(texts)
        chunk.number(bits)
        buckets = np.arange(1 << bits)

        def gathered(name: str, of: np.ndarray) -> np.ndarray:
            n = np.bincount(of.astype(np.int64), minlength=len(buckets))
            return np.concatenate([widened(b, k) for b, k in zip(answers.column(name).to_pylist(), n.tolist(), strict=True)])

        tokens, different = (sum(answers.column(c).to_pylist()) for c in ("tokens", "different"))
        word_totals = gathered("words", chunk.words >> U64(WORD_BITS))
        machine = Automaton(chunk, word_totals, gathered("grams", chunk.grams >> U64(width - bits)), tokens, different, (scale, power, first, growth))
        word = chunk.node[0]
        sums = lambda x: np.add.reduceat(np.where(word > len(chunk.words), 0, x[word]), chunk.start) if len(word) else x[:0]
        columns = [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), *map(pa.array, (chunk.n_tokens, sums(machine.known.astype(np.int64)), np.full(len(ids), tokens, np.int64), sums(machine.root), machine.scores(chunk)))]
        return pa.Table.from_arrays(columns, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    asked = rows.groupBy("chunk").applyInArrow(ask, "chunk int, place int, bucket int, word_lows binary, word_highs binary, word_counts binary, lows binary, highs binary, gram_counts binary")
    answered = asked.repartition(1 << bits, "place").groupBy("place").applyInArrow(answer, "chunk int, bucket int, words binary, grams binary, tokens long, different long")
    scored = rows.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(finish, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("id", id_col)
