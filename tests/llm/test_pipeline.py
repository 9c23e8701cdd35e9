"""The pipeline's stages on the small tables, each on its predecessor's result."""

from __future__ import annotations

import random
from itertools import combinations

from weftline.llm.queries import OP8_SQL, queries


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    from weftline.session import cut

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        assert docs.columns == names and docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == before > 0
    assert packed.select("doc_id", "piece", "length").exceptAll(corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "length")).isEmpty()


def test_empty(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def brute_groups(sets: dict, least: float = 0.8) -> dict:
    """The smallest id of each id's group, by comparing all pairs."""
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both >= least * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: find(i) for i in sets}


def test_near_duplicates_stage_is_brute_force(spark, sf_dir):
    """Copies with words changed here and there, at all similarities around 0.8, and a chain of them."""
    import corpus_pipeline

    rng, docs = random.Random(4), spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    texts = {i: r["text"] for i, r in rows.items()}
    for i in list(rows)[:60]:
        found = (texts[i] or "").split()
        for k in range(6):  # each a change of the one before
            for at in rng.sample(range(len(found)), min(len(found), len(found) * rng.randint(0, 5) // 100)):
                found[at] = f"w{rng.randint(0, 999)}"
            texts[10**6 + 10 * i + k] = " ".join(found)
    runs = lambda w: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else {()}
    want = brute_groups({i: runs("".join(c.lower() if c.isascii() else c for c in t or "").encode().split()) for i, t in texts.items()})
    both = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in texts.items()], docs.schema)
    kept = corpus_pipeline.near_duplicates_stage(spark, both, sf_dir).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values()))
    assert len(set(want.values())) < len(want) - 100


def test_near_duplicates_stage_edges(spark, sf_dir):
    import corpus_pipeline

    rows = [(None, "no id here", "en", "a", 1), (3, "a b c d e f g", "en", "a", 1), (3, "another text under that id", "en", "a", 1), (None, "A b c d e f  g", "en", "a", 1), (5, None, "en", "a", None), (6, " ", "en", "a", 1)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    kept = corpus_pipeline.near_duplicates_stage(spark, docs, sf_dir).select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(None, "no id here"), (3, "a b c d e f g"), (3, "another text under that id"), (5, None)]))


def test_lines_sql(spark, sf_dir):
    from tests.oracle import connect, same_rows

    sf = f"{sf_dir}/../sf0.01"
    same_rows(queries()["op8_lines"](spark, sf), connect(sf), OP8_SQL)
