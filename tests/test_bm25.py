"""BM25 indexes: how they are built, and odd documents."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from tests.oracle import same_rows
from weftline import queries
from weftline.operators import bm25


def test_texts_become_tokens_once(spark, sf_dir):
    rows = bm25.postings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.split("PushedFilters")[0].count("regexp_extract_all") == 1


def test_index_is_written_without_a_shuffle_of_postings(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3).localCheckpoint()
    path = str(tmp_path / "i")
    bm25.write_index(docs, path)
    files = sorted((tmp_path / "i").glob("*.parquet"))
    assert len(files) == 3  # a part of docs each
    for file in files:
        slots = [r["slot"] for r in spark.read.parquet(str(file)).coalesce(1).select("slot").collect()]
        assert slots == sorted(slots)
    written = spark.read.parquet(path)
    assert written.select("term", "doc_id", "tf", "dl").exceptAll(bm25.postings(docs)).isEmpty()
    assert written.count() == bm25.postings(docs).count()


def test_queries_of_many_words(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = str(tmp_path / "i")
    bm25.write_index(docs, path)
    index = bm25.postings(docs)
    words = [r["term"] for r in bm25.terms(index).orderBy(F.desc("df"), "term").limit(30).collect()]
    query, stats = " ".join(words), bm25.read_statistics(spark, path)
    read = bm25.read_index(spark, path, query)
    found = bm25.search(read, query, 50, stats["documents"], stats["mean_length"])
    assert found.collect() == bm25.search(index, query, 50).collect()
    assert bm25.read_index(spark, path, "the of").isEmpty()  # no tokens
    many = " ".join(f"w{i}" for i in range(1500))
    assert bm25.read_index(spark, path, f"{many} {words[0]}").count() == index.where(F.col("term") == words[0]).count()


def test_odd_documents_equal_the_sql(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "the of and"), (4, "thing"), (5, "Thing THING what's"), (6, "a b c"), (7, "x" * 51 + " oder"), (8, "é ñandú 42 42 what"), (9, "\n\t thing,oder;thing")]
    folder = tmp_path / "odd"
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(folder / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    for name in ("bm25_postings", "bm25_terms", "bm25_statistics", "bm25_search"):
        same_rows(queries.queries()[name](spark, str(folder)), con, queries.oracle_sql()[name])
