"""Languages by trigrams: profiles counted in Spark for each label, and the out-of-place distance of a text to each of them.

A text's words (runs of letters, in lower case, of its prose) are padded with a blank at each side and cut into runs of three characters. A
profile is the `size` most frequent trigrams in their order; ties go by the trigram. The distance of a text to a label is the sum,
over the text's own profile, of how many places a trigram stands apart in both, or `size` where the label lacks it. The nearest label is the
text's language, and how much farther the second is, as a share, the confidence.

Training is one aggregation with partial counts in each task. Texts meet the profiles inside their own row, so a text of any length is neither
shuffled nor split; profiles travel in blocks of BLOCK labels, `size` trigrams each.

Edge cases: rows without a label don't train; a text of under 40 characters of prose, without letters, or null has no language ('') and
confidence 0; with one label only the confidence is 1; without any label nothing has a language. Ties between labels go to the first
by name. Repeated rows count each; an empty table gives no rows. Extra columns pass through; those named as the results are replaced.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import language_sample

SIZE, LEAST_PROSE = 300, 40
#: Labels whose profiles one function holds: a few hundred KB each hundred.
BLOCK = 1024
NEAREST = "struct<first: string, distance: long, second: long>"


def words(text: Column) -> Column:
    """Runs of letters of a text's prose, in lower case."""
    return F.regexp_extract_all(F.lower(language_sample(text)), F.lit(r"(\p{L}+)"), F.lit(1))


def trigrams(words: Column) -> Column:
    """All trigrams of padded words."""
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: F.substr(w, i, F.lit(3)))))


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang", size: int = SIZE) -> DataFrame:
    """label, trigram and place (from 0) of each label's profile."""
    each = docs.where(F.col(label_col).isNotNull()).select(F.col(label_col).alias("label"), F.explode(words(F.col(text_col))).alias("word"))
    different = each.groupBy("label", "word").agg(F.count("*").alias("times"))  # a word is cut once, however often it stands in the texts
    runs = different.select("label", "times", F.explode(trigrams(F.array("word"))).alias("trigram"))
    counts = runs.groupBy("label", "trigram").agg(F.sum("times").alias("n"))
    order = Window.partitionBy("label").orderBy(F.desc("n"), "trigram")
    return counts.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < size).select("label", "trigram", "place")


def own_profile(found: list[str], size: int) -> list[str]:
    """The most frequent trigrams of a text's words, in order."""
    counts: Counter[str] = Counter()
    for word, n in Counter(found).items():
        word = f" {word} "
        for i in range(len(word) - 2):
            counts[word[i : i + 3]] += n
    return [t for t, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]


def nearest_of(profiles: pd.DataFrame, size: int):
    """A function of a text's words: the nearest of these labels, its distance and the second's."""
    labels = sorted(profiles["label"].unique())
    row = {t: k for k, t in enumerate(profiles["trigram"].unique())}
    places = np.full((len(row) + 1, len(labels)), size, np.int32)
    places[profiles["trigram"].map(row), np.searchsorted(labels, profiles["label"])] = profiles["place"]

    def nearest(found) -> tuple[str | None, int | None, int | None]:
        own = own_profile([] if found is None else list(found), size)
        if not own:
            return None, None, None
        here = places[[row.get(t, len(row)) for t in own]]
        apart = np.where(here == size, size, np.abs(here - np.arange(len(own), dtype=np.int32)[:, None])).sum(0)
        first = int(apart.argmin())
        return labels[first], int(apart[first]), int(np.delete(apart, first).min()) if len(labels) > 1 else None

    @F.pandas_udf(NEAREST)
    def column(words: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([nearest(w) for w in words], columns=["first", "distance", "second"]).astype({"distance": "Int64", "second": "Int64"})

    return column


def identify(docs: DataFrame, profiles: DataFrame, text_col: str = "text", size: int = SIZE) -> DataFrame:
    """docs with language, language_confidence and language_distance (null without a language)."""
    names = ("language", "language_confidence", "language_distance")
    kept = [c for c in docs.columns if c.lower() not in names]
    known = profiles.toPandas()  # `size` rows a label
    labels = sorted(known["label"].unique())
    prose = F.char_length(F.trim(language_sample(F.col(text_col)))) >= LEAST_PROSE
    mine = F.when(prose, words(F.col(text_col)))
    blocks = [nearest_of(known[known["label"].isin(labels[k : k + BLOCK])], size)(mine) for k in range(0, len(labels), BLOCK)]
    if not blocks:
        return docs.select(*kept, F.lit("").alias(names[0]), F.lit(0.0).alias(names[1]), F.lit(None).cast("long").alias(names[2]))
    best = F.array_sort(F.filter(F.array(*[F.struct(b["distance"].alias("distance"), b["first"].alias("first"), b["second"].alias("second")) for b in blocks]), lambda b: b["first"].isNotNull()))
    rows = docs.select(F.struct(*kept).alias("row"), best.alias("best"))
    one, other = F.get("best", F.lit(0)), F.get("best", F.lit(1))
    second = F.least(one["second"], other["distance"])
    share = F.when(second.isNull(), 1.0).when(second == 0, 0.0).otherwise((second - one["distance"]) / second)
    found = F.size("best") > 0
    return rows.select(
        *[F.col("row").getField(c).alias(c) for c in kept],
        F.when(found, one["first"]).otherwise("").alias(names[0]),
        F.when(found, share).otherwise(0.0).alias(names[1]),
        F.when(found, one["distance"]).alias(names[2]),
    )
