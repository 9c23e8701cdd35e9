"""A BM25 index as two tables, and top-k search over it."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import ranking, text

#: Values of the hash by which a written index is sorted.
BUCKETS = 1 << 16


def _runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, doc_id, tf, dl and first, which one posting of each row of docs has.

    Equal tokens are neighbours once sorted, so that a token's count is the distance between two starts. No filter asks for the
    tokens: it would be pushed below them and make them a second time.
    """
    toks = docs.select(F.col(id_col).alias("doc_id"), F.sort_array(text.tokens(F.col(text_col))).alias("tokens"))
    at = lambda name, i: F.get(F.col(name), i)
    starts = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: (i == 0) | (at("tokens", i) != at("tokens", i - 1)))
    begun = toks.select("doc_id", "tokens", F.size("tokens").cast("long").alias("dl"), F.when(F.size("tokens") > 0, starts).alias("starts"))
    run = lambda start, k: F.struct(at("tokens", start).alias("term"), (F.coalesce(at("starts", k + 1).cast("long"), F.col("dl")) - start).alias("tf"))
    rows = begun.select("doc_id", "dl", F.posexplode(F.transform("starts", run)).alias("k", "run"))
    return rows.select("run.term", "doc_id", "run.tf", "dl", (F.col("k") == 0).alias("first"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, doc_id, tf and dl for each different token of each row of docs; documents without tokens have none. No shuffle."""
    return _runs(docs, id_col, text_col).drop("first")


def statistics(index: DataFrame) -> DataFrame:
    """One row: documents, tokens, and the mean length rounded to 4 places."""
    lengths = index.groupBy("doc_id").agg(F.max("dl").alias("dl"))
    rows = lengths.agg(F.count("*").alias("documents"), F.sum("dl").alias("tokens"))
    return rows.select("documents", "tokens", F.round(F.col("tokens") / F.col("documents"), 4).alias("mean_length"))


def terms(index: DataFrame) -> DataFrame:
    """term and df."""
    return index.groupBy("term").agg(F.count("*").alias("df"))


def _slot(buckets: int):
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("slot")


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> None:
    """Postings in files that each hold a part of docs, sorted by a hash of the term, so that a query reads only its terms' pages, and
    the collection's statistics beside them. Nothing is shuffled but one row a document, for the statistics; a frequent term is in all files.
    """
    rows = _runs(docs, id_col, text_col).select("*", _slot(buckets))
    rows.sortWithinPartitions("slot").write.mode("overwrite").parquet(path)  # one number as the key is a radix sort
    statistics(docs.sparkSession.read.parquet(path).where("first")).write.mode("overwrite").parquet(f"{path.rstrip('/')}.statistics")


def read_statistics(spark, path: str):
    """The row of a written index's statistics."""
    return spark.read.parquet(f"{path.rstrip('/')}.statistics").first()


def read_index(spark, path: str, query: str, buckets: int = BUCKETS) -> DataFrame:
    """The postings of the query's terms: pages by the term's slot. Equalities, paired so that they don't nest deeply, are pushed
    down however many they are; a long IN is only as a range.
    """
    wanted = query_terms(spark, query).select("term", _slot(buckets)).collect()  # a query's words
    index = spark.read.parquet(path)
    slots = [F.col("slot") == s for s in sorted({r["slot"] for r in wanted})] or [F.lit(False)]
    while len(slots) > 1:
        slots = [reduce(or_, slots[i : i + 2]) for i in range(0, len(slots), 2)]
    return index.where(slots[0] & F.col("term").isin(*[r["term"] for r in wanted])).drop("slot", "first")


def query_terms(spark, query: str) -> DataFrame:
    """term and times: repeated words count again."""
    one = spark.range(1).select(F.explode(text.tokens(F.lit(query))).alias("term"))
    return one.groupBy("term").agg(F.count("*").alias("times"))


def search(index: DataFrame, query: str, k: int = 10, documents: int | None = None, mean_length: float | None = None) -> DataFrame:
    """The k best documents: doc_id and score, rounded to 6 places; ties go to the lower id.

    Only the query's postings are read after the collection's statistics, which may be given.
    """
    if documents is None or mean_length is None:
        stats = statistics(index).first()
        documents, mean_length = stats["documents"], stats["mean_length"] or 0.0
    wanted = query_terms(index.sparkSession, query)
    rows = index.join(F.broadcast(wanted), "term")  # a query has few words
    frequency = rows.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.round(ranking.bm25_idf(F.lit(documents), F.col("df")), 6)
    score = F.sum(F.col("times") * F.col("idf") * ranking.bm25_tf(F.col("tf"), F.col("dl"), F.lit(float(mean_length))))
    found = rows.join(F.broadcast(frequency.select("term", idf.alias("idf"))), "term").groupBy("doc_id").agg(F.round(score, 6).alias("score"))
    return found.orderBy(F.desc("score"), "doc_id").limit(k)


def attach(hits: DataFrame, forward: DataFrame, columns: list[str]) -> DataFrame:
    """Hits with their documents' columns."""
    return hits.join(forward.select("doc_id", *columns), "doc_id", "left")
