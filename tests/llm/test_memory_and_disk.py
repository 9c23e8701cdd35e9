"""What keeps executors small: batches by bytes, and workers that let go."""

from __future__ import annotations

import pyarrow as pa

import corpus_pipeline
from weftline.llm import packing, worker
from weftline.llm.queries import tokenizer


def test_workers_let_go_of_what_other_operators_held():
    first = packing.encoder(tokenizer("word_bpe_49k.json"))
    assert packing.encoder(tokenizer("word_bpe_49k.json")) is first
    worker.release()
    assert packing.encoder(tokenizer("word_bpe_49k.json")) is not first


def test_batches_of_the_pipeline_are_small(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('word ', 2000) AS text", "'en' AS lang", "'s' AS source", "10000L AS n_chars").coalesce(1)
        corpus_pipeline.quality_stage(spark, docs, "")
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()
        assert max(r["n"] for r in sizes) < 5 << 20
    finally:
        spark.conf.set(key, before)
