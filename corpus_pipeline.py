"""The corpus pipeline: stages over documents (doc_id, text, lang, source, n_chars), each written and read again by the next.

Language ID, quality rules and line dedup drop what they reject, near-duplicate removal keeps one document of each group, and packing
returns the sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import language, lines, packing, quality, similar
from weftline.llm.queries import tokenizer
from weftline.session import cut, small_batches, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known."""
    small_batches(spark)
    return language.keep_languages(docs.select(*COLUMNS))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the plain rules and whose perplexity is inside their language's band."""
    small_batches(spark)
    return quality.keep_good(docs.select(*COLUMNS))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on many sites; n_chars follows the text."""
    small_batches(spark)
    return lines.dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-duplicates: five-word shingles, Jaccard similarity of 0.8 or more."""
    small_batches(spark)
    return similar.keep_one(docs.select(*COLUMNS), words=5, least=0.8)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    small_batches(spark)
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near_duplicates", near_duplicates_stage),
    ("packing", packing_stage),
]
#: SQL has no language model, perplexity or tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
