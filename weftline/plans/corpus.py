"""From archive pages to a document corpus: payload dedup, extraction, language, fingerprints, and what was kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import hashes, html
from weftline.functions.text import language_sample
from weftline.operators import dedup


def documents(pages: DataFrame, extractor: str = "simple", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, url, host, html_length, markdown_length, markdown and simhash of pages (url, html); equal payloads of a shard once.

    The columns to keep pass through and, after the URL, say which of equal payloads comes first: several pages may have one URL.
    """
    rows = pages.withColumn("payload", F.sha2("html", 256)).withColumn("shard", F.coalesce(F.col("shard") if "shard" in pages.columns else F.lit(0), F.lit(0)))
    ones = dedup.first_payload(rows, "shard", "payload", ["url", *keep])
    made = ones.select(
        *keep,
        hashes.markdown_doc_id(F.col("url")).alias("doc_id"),
        "url",
        F.octet_length("html").cast("long").alias("html_length"),
        html.extractor(extractor)(F.col("html")).alias("markdown"),
    )
    return made.withColumns({"markdown_length": F.octet_length("markdown").cast("long"), "simhash": dedup.simhash_column("markdown")})


def language_gate(language, confidence, want: str, least: float = 0.8):
    """Rows of the wanted language with enough confidence; all if none is wanted, none without a language."""
    if not want:
        return F.lit(True)
    return F.coalesce((language != "") & (language == want) & (confidence >= least), F.lit(False))


#: Frequent short words by language, for a detector without a trained model.
COMMON = {
    "en": "the of and to in is that it was for on with as by at from this",
    "fr": "le la les de des du et un une en que qui est pour dans au sur par",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht",
    "es": "el la los las de que y en un una por con para es se del lo como",
}


def _let(value, use):
    """use(value) with value worked out once, however often it is used: columns are else inlined wherever they stand."""
    return F.transform(F.array(value), use)[0]


def _counts(found):
    """How many words are in each list of COMMON, in its order."""

    def of(words: list[str]):
        return F.size(F.filter(found, lambda w: w.isin(*words)))

    return F.array(*[of(v.split()) for v in COMMON.values()])


def _best(known, hits):
    each = [hits[k] for k in range(len(COMMON))]
    total, best, code = sum(each, F.lit(0)), F.greatest(*each), F.lit("")
    for k, n in reversed(list(zip(COMMON, each, strict=True))):
        code = F.when((n == best) & (best > 0), k).otherwise(code)
    return F.struct(F.when(known, code).otherwise("").alias("code"), F.when(known, F.coalesce(F.try_divide(best, total), F.lit(0.0))).otherwise(0.0).alias("confidence"))


def detect_language(text):
    """(code, confidence) by frequent words of a cleaned sample; ('', 0) under 40 characters."""

    def of_sample(sample):
        known = F.char_length(F.trim(sample)) >= 40
        found = F.regexp_extract_all(F.lower(sample), F.lit(r"(\p{L}+)"), F.lit(1))
        return _let(_let(found, _counts), lambda hits: _best(known, hits))

    return _let(language_sample(text), of_sample)


def with_language(docs: DataFrame, text: str = "markdown") -> DataFrame:
    rows = docs.withColumn("__l", detect_language(F.col(text)))
    return rows.select(*docs.columns, F.col("__l.code").alias("language"), F.col("__l.confidence").alias("language_confidence"))


def language_histogram(docs: DataFrame) -> DataFrame:
    """Documents by language, before any is dropped."""
    return docs.groupBy("language").agg(F.count("*").alias("n"))


def outcomes(docs: DataFrame) -> DataFrame:
    """Successes and failures in one frame: a failed fetch stays a row with its error, so counts count attempts."""
    return docs.select("*", F.when(F.coalesce("error", F.lit("")) != "", "failed").otherwise("ok").alias("outcome"))
