"""Quality rules: counts over words and lines, and perplexity under a character n-gram model of the document's language.

The model is over runs of ORDER characters. A character is told by 12 bits: below U+1000 (Latin, Greek, Cyrillic, Hebrew,
Arabic, the Indic scripts) its code point, above it a hash, but all white space in lines is one blank and all digits are one. Spark counts the runs
by language over all documents; modified Kneser-Ney smoothing turns the counts into sorted arrays of keys (language, run)
with log-probabilities and back-off weights, which are broadcast while there are at most MOST different runs. Beyond that the same
model is made and asked as tables: counts of counts, continuation counts and context sums are aggregations, each order's probabilities a join
with the order below, and chunks of texts send the different runs that they hold to where the probabilities are and get these back. Results don't
depend on the way. Each value of `lang` has a model and a band of its own, null as well.

The counts cover all documents, so marks that many texts have are as probable as they are frequent. What tells noise
apart is the log-perplexity by letter: that of the whole text over its characters that are in words and aren't marks. Marks and
blanks cost what the model says, but don't dilute the mean of the rest, however probable a run of them is.

Documents whose log-perplexity is outside their language's band are rejected. A band reaches from the quartiles
`spread` interquartile ranges (at least `least_reach` in natural logs) outwards; quartiles are taken over the documents that
pass the plain rules, from exact counts of steps of a thousandth.

Edge cases: null and empty texts have no words and fail the plain rules; repeated rows are judged each, and alike; a language
without any passing document rejects nothing by its band; an empty table gives no rows. Texts are read whole, in slices
of a bounded size. Extra columns are dropped by `judge` and kept by `keep_good`, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import worker
from weftline.session import cut

ORDER, SYMBOL_BITS = 4, 12
SYMBOLS = 1 << SYMBOL_BITS
GRAM_BITS = ORDER * SYMBOL_BITS
MARKS = "#*$%&|<>"
#: Different runs of a model that is broadcast (a matter of the plan only), and runs that a task counts before it passes them on; languages, by
#: number (further ones share 0); characters that are worked on at once, and those of a chunk.
MOST, HELD, LANGUAGES, SLICE, CHUNK = 1 << 21, 1 << 21, 1 << 15, 1 << 17, 1 << 22
#: Rows of a batch that are Python strings at once.
ROWS = 500
BLANK, LINE, DIGIT = 32, 10, 48

_table: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    """The symbols of a text, 12 bits each."""
    if not _table:
        points = np.arange(0x110000, dtype=np.uint64)
        hashed = (points * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SYMBOL_BITS)).astype(np.uint16)
        table = np.where(points < SYMBOLS, points.astype(np.uint16), hashed)
        chars = [chr(c) for c in range(0x3100)]  # there is neither white space nor a digit of a decimal system beyond that one needs to fold
        table[[c for c, x in enumerate(chars) if x.isspace() and x != "\n"]] = BLANK
        table[[c for c, x in enumerate(chars) if x.isdigit()]] = DIGIT
        _table.append(table)
    return _table[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A run of ORDER symbols for each character of each text (line ends stand before a text), and the characters of each."""
    parts, sizes = [], np.array([len(t or "") for t in texts], np.int64)
    before = np.full(ORDER - 1, LINE, np.uint16)
    for t in texts:
        parts += [before, symbols(t or "")]
    s = np.concatenate([before[:0], *parts]).astype(np.int64)
    if not len(s):
        return s, sizes
    key = s.copy()
    for k in range(1, ORDER):
        key[k:] |= s[:-k] << k * SYMBOL_BITS
    inside = np.ones(len(s), bool)
    starts = np.cumsum(sizes + ORDER - 1) - sizes - ORDER + 1
    for k in range(ORDER - 1):
        inside[starts + k] = False
    return key[inside], sizes


def word_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    marks = sum(text.count(c) for c in MARKS)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        inside = np.zeros(len(words), bool)
        for i, w in enumerate(windows):
            if times[w] > 1:
                inside[i : i + 3] = True
        repeated = int(inside.sum())
    return len(words), chars, marks, len(lines) - len(set(lines)), repeated


def slices(languages: list[int], texts: list[str | None]) -> Iterator[tuple[list[int], list[str | None]]]:
    """Some rows at a time, and parts of very long texts never: a text is one row."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE:
            yield languages[at : i + 1], texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield languages[at:], texts[at:]


def count_grams(docs: DataFrame) -> DataFrame:
    """key (language number above a run) and n over all rows of docs (language, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for languages, texts in (some for at in range(0, batch.num_rows, ROWS) for some in slices(*(batch.column(k).slice(at, ROWS).to_pylist() for k in (0, 1)))):
                found, sizes = grams(texts)
                new, n = np.unique(np.repeat(np.array(languages, np.int64) << GRAM_BITS, sizes) | found, return_counts=True)
                keys, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([counts, n])).astype(np.int64)
                if len(keys) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])
                    keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])

    return docs.select("language", "text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """keys[k]: sorted (language, run of k + 1 symbols); logs[k]: log-probabilities; backs[k]: back-off logs of contexts."""

    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backs: list[np.ndarray]

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Natural logs for keys (language above a run), backing off where the model lacks one."""
        language = keys >> GRAM_BITS
        out, todo, weight = np.zeros(len(keys)), np.arange(len(keys)), np.zeros(len(keys))
        for order in range(ORDER, 0, -1):
            bits = order * SYMBOL_BITS
            key = (language[todo] << bits) | (keys[todo] & ((1 << bits) - 1))
            found, at = _find(self.keys[order - 1], key)
            out[todo[found]] = weight[found] + self.logs[order - 1][at[found]]
            todo, weight, key = todo[~found], weight[~found], key[~found]
            known, at = _find(self.contexts[order - 1], key >> SYMBOL_BITS)
            weight[known] += self.backs[order - 1][at[known]]
        out[todo] = weight - np.log(SYMBOLS)
        return out

    def costs(self, languages: list[int], texts: list[str | None]) -> np.ndarray:
        """Minus the natural log of each text's probability under its language's model."""
        found, sizes = grams(texts)
        keys, place = np.unique(np.repeat(np.array(languages, np.int64) << GRAM_BITS, sizes) | found, return_inverse=True)
        each = np.concatenate([[0.0], np.cumsum(-self.log_probabilities(keys)[place])])
        ends = np.cumsum(sizes)
        return each[ends] - each[ends - sizes]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What is taken off counts of one, two and more, by how many runs stand once to four times; fixed values where these don't say."""
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(a, 0.05), b - 0.05) for a, b in zip((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), (1, 2, 3), strict=True)]


def kneser_ney(key: np.ndarray, n: np.ndarray) -> Model:
    """Modified Kneser-Ney over counts of runs: lower orders count the distinct symbols seen before. Keys hold the language."""
    order = np.argsort(key)
    keys, counts = [*[None] * (ORDER - 1), key[order].astype(np.int64)], [*[None] * (ORDER - 1), n[order].astype(float)]
    for k in range(ORDER - 2, -1, -1):
        bits, above = (k + 1) * SYMBOL_BITS, keys[k + 1]
        shorter = (above >> (bits + SYMBOL_BITS) << bits) | (above & ((1 << bits) - 1))
        keys[k], c = np.unique(shorter, return_counts=True)
        counts[k] = c.astype(float)
    logs, contexts, backs, lower = [], [], [], None
    for k in range(ORDER):
        c, discount = counts[k], np.zeros(len(keys[k]))
        own = keys[k] >> (k + 1) * SYMBOL_BITS  # sorted, as the language is above
        edges = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            d = discounts(*(int((c[a:b] == x).sum()) for x in (1, 2, 3, 4)))
            discount[a:b] = np.where(c[a:b] <= 1, d[0], np.where(c[a:b] <= 2, d[1], d[2]))
        context, inverse = np.unique(keys[k] >> SYMBOL_BITS, return_inverse=True)
        total, freed = np.bincount(inverse, c), np.bincount(inverse, discount)
        gamma = freed / total
        if lower is None:
            below = np.full(len(c), 1 / SYMBOLS)
        else:
            bits = k * SYMBOL_BITS
            below = lower[np.searchsorted(keys[k - 1], (own << bits) | (keys[k] & ((1 << bits) - 1)))]
        p = (c - discount) / total[inverse] + gamma[inverse] * below
        logs.append(np.log(p).astype(np.float32))
        contexts.append(context)
        backs.append(np.log(gamma).astype(np.float32))
        lower = p
    return Model(keys, logs, contexts, backs)


def language_numbers(docs: DataFrame) -> dict[str, int]:
    """A number from 1 for each language, by frequency; more than LANGUAGES of them share 0 with null."""
    rows = docs.where("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES - 1).collect()
    return {r["lang"]: i + 1 for i, r in enumerate(rows)}


def numbered(numbers: dict[str, int]) -> Column:
    if not numbers:
        return F.lit(0)
    pairs = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, F.coalesce("lang", F.lit(""))), F.lit(0))


def counted(docs: DataFrame, numbers: dict[str, int]) -> DataFrame:
    """The counts of all rows of docs (text, lang)."""
    return cut(count_grams(docs.select(numbered(numbers).alias("language"), "text")), "grams")


def lower_order(above: DataFrame, k: int) -> DataFrame:
    """Runs of k + 1 symbols and how many different symbols stand before them, from the runs of k + 2."""
    bits = (k + 1) * SYMBOL_BITS
    key = F.shiftleft(F.shiftright("key", bits + SYMBOL_BITS), bits).bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << bits) - 1)))
    return above.groupBy(key.alias("key")).agg(F.count("*").alias("n"))


def log_costs(counts: DataFrame) -> DataFrame:
    """key and cost (minus the log-probability) of every run of ORDER symbols: the model of kneser_ney as tables."""
    levels = [counts.select("key", "n")]
    for k in range(ORDER - 2, -1, -1):
        levels.insert(0, cut(lower_order(levels[0], k), "runs"))
    lower = None
    for k, level in enumerate(levels):
        language = F.shiftright("key", (k + 1) * SYMBOL_BITS).cast("int")
        few = level.where("n <= 4").groupBy(language.alias("language"), "n").count().collect()  # at most four for each language
        said: dict[int, dict[int, int]] = {}
        for r in few:
            said.setdefault(r["language"], {})[r["n"]] = r["count"]
        known = [(x, *map(float, discounts(*(c.get(i, 0) for i in (1, 2, 3, 4))))) for x, c in said.items()]
        taken = level.sparkSession.createDataFrame(known, "language int, d1 double, d2 double, d3 double")
        rows = level.withColumn("language", language).join(F.broadcast(taken), "language", "left")  # at most LANGUAGES rows
        fixed = discounts(0, 0, 0, 0)
        take = F.when(F.col("n") == 1, F.coalesce("d1", F.lit(fixed[0]))).when(F.col("n") == 2, F.coalesce("d2", F.lit(fixed[1]))).otherwise(F.coalesce("d3", F.lit(fixed[2])))
        rows = rows.select("key", "n", take.alias("d"), F.shiftright("key", SYMBOL_BITS).alias("context"))
        sums = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("freed"))
        rows = rows.join(sums, "context")
        if lower is None:
            rows = rows.withColumn("below", F.lit(1 / SYMBOLS))
        else:
            bits = k * SYMBOL_BITS
            shorter = F.shiftleft(F.shiftright("key", bits + SYMBOL_BITS), bits).bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << bits) - 1)))
            rows = rows.withColumn("shorter", shorter).join(lower.toDF("shorter", "below"), "shorter")
        p = (F.col("n") - F.col("d")) / F.col("total") + F.col("freed") / F.col("total") * F.col("below")
        lower = cut(rows.select("key", p.alias("p")), "probabilities")
    return lower.select("key", (-F.log("p")).cast("float").alias("cost"))


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STEPS = 1000


def version() -> Column:
    """Tells rows of one id apart: whatever a verdict depends on."""
    return F.xxhash64("text", "lang")


SCORED = "id long, version long, language int, " + ", ".join(f"{f} long" for f in FIELDS) + ", log_perplexity double"


def with_counts(own: list[pa.Array], texts: list[str | None], costs: np.ndarray) -> pa.RecordBatch:
    """Rows of SCORED: id, version and language, the counts of texts, and their costs by letter."""
    counts = [word_counts(t) for t in texts]
    letters = np.array([max(1, c[1] - c[2]) for c in counts])
    columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(5)]
    return pa.RecordBatch.from_arrays([*own, *columns, pa.array(costs / letters, pa.float64())], names=["id", "version", "language", *FIELDS, "log_perplexity"])


def keys_of(languages: list[int], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The run of each character of texts, with their languages, and the characters of each text."""
    found, sizes = grams(texts)
    return np.repeat(np.array(languages, np.int64) << GRAM_BITS, sizes) | found, sizes


def scored_by_tables(rows: DataFrame, costs: DataFrame) -> DataFrame:
    """Rows (id, version, language, text) by a model that may be too large for one place: chunks of texts ask for the costs of their different runs."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 40
        for batch in batches:
            at, size, texts = 0, 0, batch.column(3)
            lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for i, length in enumerate(lengths):
                size += length
                if size >= CHUNK or i + 1 == batch.num_rows:
                    part, n, edge = batch.slice(at, i + 1 - at), n + 1, pa.array([0, i + 1 - at], pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *(pa.ListArray.from_arrays(edge, c) for c in part.columns)], names=["chunk", *names])
                    at, size = i + 1, 0

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                keys = np.unique(keys_of(batch.column("language")[k].as_py(), batch.column("text")[k].as_py())[0])
                for i in range(0, len(keys), 1 << 16):
                    own = keys[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), batch.column("chunk")[k].as_py())), pa.array(own)], names=["chunk", "key"])

    def answered(texts: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(keys := known.column("key").to_numpy())
        keys, cost = keys[order], known.column("cost").to_numpy()[order].astype(float)
        found = []
        for k in range(texts.num_rows):
            own = {c: texts.column(c)[k].values for c in names}
            costs, said = [np.zeros(0)], own["text"].to_pylist()
            for languages, some in slices(own["language"].to_pylist(), said):
                runs, sizes = keys_of(languages, some)
                each, ends = np.concatenate([[0.0], np.cumsum(cost[np.searchsorted(keys, runs)])]), np.cumsum(sizes)
                costs.append(each[ends] - each[ends - sizes])
            found.append(with_counts([own[c] for c in names[:3]], said, np.concatenate(costs)))
        return pa.Table.from_batches(found)

    names = ["id", "version", "language", "text"]
    packed = cut(rows.mapInArrow(chunks, "chunk long, id array<long>, version array<long>, language array<int>, text array<string>"), "chunks")
    answers = packed.mapInArrow(asked, "chunk long, key long").join(costs, "key").select("chunk", "key", "cost")
    return packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(answered, SCORED)


def scored(docs: DataFrame, id_col: str) -> DataFrame:
    """id, version (a hash of text and lang), language, the counts and log_perplexity (by letter) of each row, written in the shared folder."""
    numbers = language_numbers(docs)
    counts = counted(docs, numbers)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), version().alias("version"), numbered(numbers).alias("language"), "text")
    if counts.count() > MOST:
        return cut(scored_by_tables(rows, log_costs(counts)), "quality")
    table = counts.toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(kneser_ney(*(table.column(c).to_numpy() for c in ("key", "n"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts, languages = part.column(3).to_pylist(), part.column(2).to_pylist()
                costs = np.concatenate([model.costs(*some) for some in slices(languages, texts)])
                yield with_counts([part.column(k) for k in range(3)], texts, costs)

    return cut(rows.mapInArrow(run, SCORED), "quality")


def bands(rows: DataFrame, spread: float, least_reach: float) -> DataFrame:
    """language, low and high, from the quartiles of log_perplexity of rows; a language has some ten thousand steps at most."""
    steps = rows.groupBy("language", F.floor(F.col("log_perplexity") * STEPS).alias("step")).agg(F.count("*").alias("n"))
    upto, whole = Window.partitionBy("language").orderBy("step"), Window.partitionBy("language")
    shares = steps.select("language", "step", (F.sum("n").over(upto) / F.sum("n").over(whole)).alias("share"))
    quartile = lambda q: F.min(F.when(F.col("share") >= q, (F.col("step") + 0.5) / STEPS))
    reach = F.greatest(spread * (F.col("q3") - F.col("q1")), F.lit(least_reach))
    return shares.groupBy("language").agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3")).select("language", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def judged(docs: DataFrame, id_col: str, spread: float = 4.0, least_reach: float = 0.4) -> DataFrame:
    """What `scored` gives, with base_failed and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = scored(docs, id_col).withColumn("base_failed", failed)
    known = cut(bands(rows.where("not base_failed"), spread, least_reach), "bands")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return rows.join(known, "language", "left").withColumn("kept", ~F.col("base_failed") & inside).drop("low", "high")


def judge(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """id_col, the counts, base_failed, kept, log_perplexity and language for each row of docs (id, text, lang)."""
    return judged(docs, id_col, **how).select(F.col("id").alias(id_col), *FIELDS, "base_failed", "kept", "log_perplexity", "language")


def keep_good(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs that are kept, each by its own verdict: ids may be null or shared by different texts."""
    kept = judged(docs, id_col, **how).where("kept").select("id", "version").distinct().toDF("kept_id", "kept_version")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), version().alias("version"))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("version") == F.col("kept_version"))
    return rows.join(kept, same, "left_semi").select("row.*")
