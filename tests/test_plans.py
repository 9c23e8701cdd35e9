"""What is worked out once, and what is counted before it is joined."""

from __future__ import annotations

from weftline import queries
from weftline.operators import trigrams


def plan(spark, sf_dir, name):
    return queries.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_a_text_are_looked_up_once(spark, sf_dir):
    assert plan(spark, sf_dir, "language_detect").count("regexp_extract_all(") == 1


def test_customers_are_counted_before_they_meet_suppliers(spark, sf_dir):
    assert "Aggregate [c_nationkey" in plan(spark, sf_dir, "sql_outer_joins")


def test_words_are_counted_before_they_are_cut(spark, sf_dir):
    docs = spark.createDataFrame([("en", "the the the")], "lang string, text string")
    assert "Aggregate [label#" in (made := trigrams.train(docs)._jdf.queryExecution().optimizedPlan().toString()) and made.count("word#") > 0


def test_batches_of_pages_are_small(spark, sf_dir):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        queries.queries()["html_extract"](spark, sf_dir)
        assert int(spark.conf.get(key).rstrip("bB")) <= 4 << 20
    finally:
        spark.conf.set(key, before)
