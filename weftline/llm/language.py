"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are runs of 1 to 3 characters of the lower-cased text in which all that isn't a letter is one space; they are
hashed into 2^15 slots, weighted by the inverse document frequency over all training rows (Spark sums what each task
counted) and scaled to unit length. Follow-the-regularised-leader with an elastic-net penalty fits one sparse weight vector
per language on a bounded sample of the training rows: at most `sample` rows in all, those of least hash per language. A
temperature that minimises the log loss on a fifth of that sample, held back from fitting, then calibrates the scores.

What is broadcast has languages x slots weights: every label that is not null is learned.

Edge cases: null texts and texts without a letter are `und` with score 0; rows without a label train nothing; without any
labelled row every text is `und`. Ties between languages go to the first in alphabetical order. Repeated rows are predicted
each; a null id is never held out; an empty table gives no rows; texts are read whole, however long. Extra columns pass through `predict`,
but for those named like a result; `identify` drops them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import worker
from weftline.llm.bpe import numbered

SLOTS = 1 << 15
ORDERS = (1, 2, 3)
UNKNOWN = "und"


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text has that remainder; a null id has not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        char = chr(c)
        if char.isalpha():
            low = char.lower()
            table[c] = ord(low[0])
    return table


_table: list[np.ndarray] = []


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots (ascending) and counts of the n-grams of a whole text; empty if it has no letter."""
    none = (np.zeros(0, np.int64), np.zeros(0))
    if not text:
        return none
    if not _table:
        _table.append(_letters())
    points = _table[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    space = points == 32
    if space.all():
        return none
    points = points[~(space & np.concatenate([[False], space[:-1]]))].astype(np.uint64)
    points = np.concatenate([[np.uint64(32)], points, [np.uint64(32)]])
    found, key = [], np.zeros(len(points), np.uint64)
    for n in ORDERS:
        if len(points) < n:
            break
        key = key[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(n)
        found.append((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49))
    total = np.bincount(np.concatenate(found).view(np.int64), minlength=SLOTS)
    slots = np.flatnonzero(total)
    return slots, total[slots].astype(float)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # languages x (slots + 1); the last is the bias
    temperature: float
    floor: float = 0.0  # the score that nearly all texts of known languages have

    def vector(self, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        values = (1 + np.log(counts)) * self.idf[slots]
        return values / max(np.sqrt((values * values).sum()), 1e-12)

    def logits(self, slots: np.ndarray, values: np.ndarray) -> np.ndarray:
        return self.weights[:, slots] @ values + self.weights[:, -1]

    def predict(self, text: str | None) -> tuple[str, float]:
        slots, counts = grams(text)
        if not len(slots) or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(slots, self.vector(slots, counts)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows of texts (text) each slot occurs, and rows that have any. At most 2^15 + 1 numbers arrive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        df = np.zeros(SLOTS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                slots, _ = grams(text.as_py())
                df[slots] += 1
                df[SLOTS] += len(slots) > 0
        n = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(df[n])], names=["slot", "n"])

    total = np.zeros(SLOTS + 1)
    for row in texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        total[row["slot"]] = row["n"]
    return total[:-1], int(total[-1])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Per-coordinate FTRL-proximal with softmax gradients; weights stay sparse under the l1 penalty."""
    z, n = np.zeros((languages, SLOTS + 1)), np.zeros((languages, SLOTS + 1))
    rng = np.random.default_rng(7)

    def weight(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            slots, values, label = rows[i]
            at, x = np.append(slots, SLOTS), np.append(values, 1.0)
            zs, ns = z[:, at], n[:, at]
            w = weight(zs, ns)
            p = softmax(w @ x)
            p[label] -= 1
            g = p[:, None] * x[None, :]
            grown = ns + g * g
            z[:, at] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / alpha * w
            n[:, at] = grown
    return weight(z, n)


def train(labelled: DataFrame, sample: int = 4000, most_slots: int = 2000, epochs: int = 5, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.001) -> Model:
    """A model from rows (id, text, lang). Document frequencies cover all rows.

    sample bounds the rows that are fitted, and most_slots the features of a fitted row (its most frequent): together what goes
    to the driver, at 12 bytes each. Texts are predicted by all their features.
    """
    rows = labelled.where("lang is not null and text is not null")
    counts = labelled.where("lang is not null").groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return Model([], np.zeros(SLOTS), np.zeros((0, SLOTS + 1)), 1.0)
    df, total = document_frequencies(rows)
    idf = np.log((1 + total) / (1 + df)) + 1
    each = max(2, sample // len(languages))
    # A third of the rows may share one language: a threshold on the hash bounds what is sorted, then the least are taken.
    share = {r["lang"]: min(1.0, 3.0 * each / r["count"] + 1e-3) for r in counts}
    order = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 40))
    picked = rows.select("id", "text", "lang", order.alias("o")).where(
        F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(int(share[k] * (1 << 40))))])[F.col("lang")] > F.col("o")
    )
    least = Window.partitionBy("lang").orderBy("o", "id")  # Spark keeps `each` rows of each task before it shuffles
    bounded = picked.withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= each)

    def most(slots: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kept = np.sort(np.argsort(-counts, kind="stable")[:most_slots])
        return slots[kept], counts[kept]

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [most(*grams(t.as_py())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([s.astype(np.int32) for s, _ in found], pa.list_(pa.int32())), pa.array([c.astype(np.float32) for _, c in found], pa.list_(pa.float32()))], names=["lang", "o", "slots", "counts"])

    fitted = bounded.select("text", "lang", "o").mapInArrow(featurise, "lang string, o long, slots array<int>, counts array<float>").toArrow().combine_chunks()
    model = Model(languages, idf, np.zeros((len(languages), SLOTS + 1)), 1.0)
    index = {k: i for i, k in enumerate(languages)}
    labels, places = fitted.column("lang").to_pylist(), fitted.column("o").to_pylist()
    column = lambda name: [np.asarray(x.values) for x in fitted.column(name)]
    slots, counts = column("slots"), column("counts")
    data = [(slots[i], model.vector(slots[i], counts[i]), index[labels[i]]) for i in sorted(range(len(labels)), key=lambda i: (places[i], labels[i])) if len(slots[i])]
    model.weights = ftrl([r for i, r in enumerate(data) if i % 5], len(languages), epochs, alpha, beta, l1, l2)
    check = data[::5]
    logits = [(model.logits(s, v), y) for s, v, y in check]
    loss = lambda t: -sum(np.log(max(softmax(x / t)[y], 1e-12)) for x, y in logits)
    model.temperature = float(min(np.geomspace(0.05, 5, 41), key=loss)) if logits else 1.0
    model.floor = min(0.5, float(np.quantile([softmax(x / model.temperature).max() for x, _ in logits], 0.001))) if logits else 0.0
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs (its text column becomes no part of the result) with label and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    keep = [c for c in names if c.lower() not in (text_col.lower(), label.lower(), score.lower())]  # as Spark compares names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            batch = batch.rename_columns(names)
            found = [model.predict(t.as_py()) for t in batch.column(text_col)]
            made = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, label, score])

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes if n in keep)
    return numbered(docs).mapInArrow(run, f"{fields + ', ' if fields else ''}`{label}` string, `{score}` double")


def identify(docs: DataFrame, modulus: int = 4, remainder: int = 2, **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text, lang)."""
    rows = docs.select("doc_id", "text", "lang", held_out("doc_id", modulus, remainder).alias("held_out"))
    model = train(rows.where("not held_out").select(F.col("doc_id").alias("id"), "text", "lang"), **how)
    return predict(rows.select("doc_id", "held_out", "text"), model)


def keep_languages(docs: DataFrame, least: float | None = None, **how) -> DataFrame:
    """The rows of docs whose language is known with a score of at least `least`; a row without a known language goes.

    By default that is the score that all but a thousandth of the labelled rows held back from fitting have, and half at most.
    """
    rows = docs.where(~held_out("doc_id", 4, 2)).select(F.col("doc_id").alias("id"), "text", "lang")
    model = train(rows, **how)
    least = model.floor if least is None else least
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(place)]
            yield batch.filter(pa.array([k != UNKNOWN and s >= least for k, s in found], pa.bool_()))

    return numbered(docs).mapInArrow(run, docs.schema)
