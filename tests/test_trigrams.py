"""Trigram profiles and distances against their definition, held-out accuracy, and the edges."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from weftline.operators import trigrams


def slow_profile(texts, size):
    counts = Counter(f" {w} "[i : i + 3] for t in texts for w in "".join(c if c.isalpha() else " " for c in t.lower()).split() for i in range(len(w)))
    return sorted(counts, key=lambda t: (-counts[t], t))[:size]


def slow_distance(own, other, size):
    return sum(abs(k - other.index(t)) if t in other else size for k, t in enumerate(own))


TEXTS = [
    ("en", "the cat sat on the mat and the dog looked at the other cat for a while"),
    ("en", "there is nothing that the weather of this month has not brought to them"),
    ("fr", "le chat est sur le tapis et le chien regarde un autre chat pendant une heure"),
    ("fr", "il ne reste rien de ce que les jours de pluie ont apporté aux champs d'été"),
    ("de", "die Katze sitzt auf der Matte und der Hund schaut der anderen Katze lange zu"),
]
ASKED = ["what is there that the others have not looked at in this weather", "les autres chats regardent la pluie sur les champs pendant l'été", "der Hund und die Katze sitzen lange auf der anderen Matte"]


def test_profiles_and_distances_are_the_definition(spark, monkeypatch):
    size = 40
    docs = spark.createDataFrame([*TEXTS, (None, "no label here " * 20)], "lang string, text string")
    profiles = trigrams.train(docs, size=size)
    found = {}
    for r in profiles.orderBy("label", "place").collect():
        found.setdefault(r["label"], []).append(r["trigram"])
    want = {k: slow_profile([t for lang, t in TEXTS if lang == k], size) for k in ("en", "fr", "de")}
    assert found == want
    asked = spark.createDataFrame([(t,) for t in ASKED], "text string")
    for block in (1024, 1):  # profiles in one block, and in a block each
        monkeypatch.setattr(trigrams, "BLOCK", block)
        for row in trigrams.identify(asked, profiles, size=size).collect():
            own = slow_profile([row["text"]], size)
            distances = sorted((slow_distance(own, p, size), k) for k, p in want.items())
            assert (row["language_distance"], row["language"]) == distances[0]
            assert row["language_confidence"] == (distances[1][0] - distances[0][0]) / distances[1][0]


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = trigrams.train(docs.where("doc_id % 5 <> 0"))
    found = trigrams.identify(docs.where("doc_id % 5 = 0"), profiles).where("language <> ''")
    n, right = found.agg(F.count("*"), F.count_if(F.col("language") == F.col("lang"))).first()
    assert n >= 20 and right >= 0.97 * n


def test_edges(spark):
    docs = spark.createDataFrame([*TEXTS], "lang string, text string")
    profiles = trigrams.train(docs)
    long = "the weather of this month " * 20_000
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "short text", "x"), (4, "12345 67890 " * 10, "x"), (5, long, "x"), (5, long, "x")], "id long, text string, Language string")
    found = [(r["id"], r["language"], r["language_confidence"] > 0) for r in trigrams.identify(rows, profiles).orderBy("id").collect()]
    assert found == [(1, "", False), (2, "", False), (3, "", False), (4, "", False), (5, "en", True), (5, "en", True)]
    assert trigrams.identify(rows.limit(0), profiles).count() == 0
    none = trigrams.train(docs.limit(0))
    assert {r["language"] for r in trigrams.identify(rows, none).collect()} == {""}
    one = trigrams.identify(rows, trigrams.train(docs.where("lang = 'fr'"))).where("id = 5").first()
    assert (one["language"], one["language_confidence"]) == ("fr", 1.0)
