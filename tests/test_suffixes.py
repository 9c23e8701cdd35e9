"""Registered domains against the test vectors of the published algorithm, and its edges."""

from __future__ import annotations

import random

from weftline.functions import hashes
from weftline.operators import suffixes

RULES = """
// ===BEGIN ICANN DOMAINS===
com
biz
uk.com   // a comment
jp
ac.jp
kyoto.jp
*.kobe.jp
!city.kobe.jp
ide.kyoto.jp
*.ck
!www.ck
us
ak.us
k12.ak.us
cn
com.cn
公司.cn
中国
// ===END ICANN DOMAINS===
// ===BEGIN PRIVATE DOMAINS===
github.io
// ===END PRIVATE DOMAINS===
""".splitlines()
#: Vectors of the published algorithm: a host and its registered domain.
VECTORS = {
    "COM": None, "example.COM": "example.com", "WwW.example.COM": "example.com", "example": None, "example.example": "example.example",
    "b.example.example": "example.example", "a.b.example.example": "example.example", "biz": None, "domain.biz": "domain.biz",
    "a.b.domain.biz": "domain.biz", "uk.com": None, "example.uk.com": "example.uk.com", "test.ac": "test.ac", "jp": None, "test.jp": "test.jp",
    "www.test.jp": "test.jp", "ac.jp": None, "test.ac.jp": "test.ac.jp", "kyoto.jp": None, "test.kyoto.jp": "test.kyoto.jp", "ide.kyoto.jp": None,
    "b.ide.kyoto.jp": "b.ide.kyoto.jp", "a.b.ide.kyoto.jp": "b.ide.kyoto.jp", "c.kobe.jp": None, "b.c.kobe.jp": "b.c.kobe.jp",
    "a.b.c.kobe.jp": "b.c.kobe.jp", "city.kobe.jp": "city.kobe.jp", "www.city.kobe.jp": "city.kobe.jp", "ck": None, "test.ck": None,
    "b.test.ck": "b.test.ck", "a.b.test.ck": "b.test.ck", "www.ck": "www.ck", "www.www.ck": "www.ck", "us": None, "test.us": "test.us",
    "ak.us": None, "test.ak.us": "test.ak.us", "k12.ak.us": None, "www.test.k12.ak.us": "test.k12.ak.us", "食狮.com.cn": "食狮.com.cn",
    "www.食狮.公司.cn": "食狮.公司.cn", "公司.cn": None, "食狮.中国": "食狮.中国", "xn--85x722f.xn--55qx5d.cn": "xn--85x722f.xn--55qx5d.cn",
    "xn--55qx5d.cn": None, "shishi.xn--fiqs8s": "shishi.xn--fiqs8s", "127.0.0.1": None, "[::1]": None, "": None, "a..com": None,
}


def found(spark, hosts, rules):
    rows = spark.createDataFrame([(h,) for h in hosts], "host string")
    return {r["host"]: r["registered_domain"] for r in suffixes.with_registered_domain(rows, rules).collect()}


def test_vectors(spark):
    assert found(spark, VECTORS, suffixes.rules(spark, RULES)) == VECTORS


def test_rules_by_shuffle_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "FEW_RULES", 0)
    assert found(spark, VECTORS, suffixes.rules(spark, RULES)) == VECTORS


def test_private_part(spark, tmp_path):
    (tmp_path / "rules.dat").write_text("\n".join(RULES), encoding="utf-8")
    every, public = (suffixes.read_rules(spark, str(tmp_path / "rules.dat"), p) for p in (True, False))
    assert found(spark, ["a.b.github.io"], every) == {"a.b.github.io": "b.github.io"}
    assert found(spark, ["a.b.github.io"], public) == {"a.b.github.io": "github.io"}
    assert found(spark, ["a.b.c", "c"], suffixes.rules(spark, [])) == {"a.b.c": "b.c", "c": None}


def slow(host: str, rules: list[str]) -> str | None:
    """The algorithm as it is published, one rule after the other."""
    labels, best = host.split("."), None
    for rule in rules:
        own = rule.removeprefix("!").split(".")
        if len(own) <= len(labels) and all(a in ("*", b) for a, b in zip(own[::-1], labels[::-1])) and (best is None or (rule[0] == "!", len(own)) > best[:2]):
            best = (rule[0] == "!", len(own), rule)
    size = 1 if best is None else best[1] - best[0]
    return ".".join(labels[-size - 1 :]) if len(labels) > size else None


def test_random_rules(spark):
    """Against the definition, on rules and hosts over few labels. Names whose wildcard has exceptions below it stay unambiguous."""
    rng = random.Random(8)
    name = lambda k: ".".join(rng.choice("abc") for _ in range(rng.randint(1, k)))
    own = [*{name(3) for _ in range(12)}, *{"*." + name(2) for _ in range(4)}]
    own += [f"!{rng.choice('abc')}.{r[2:]}" for r in own if r.startswith("*.")]
    hosts = {name(6) for _ in range(400)}
    assert found(spark, hosts, suffixes.rules(spark, own)) == {h: slow(h, own) for h in hosts}


def test_edges(spark):
    """Nulls, repeated rows, clashing columns in another case, an empty table; shards follow the registered domain."""
    rules = suffixes.rules(spark, RULES)
    rows = spark.createDataFrame([(None, "x", "k"), ("www.test.jp.", "y", "k"), ("www.test.jp.", "y", "k"), ("10.0.0.1", "z", "k")], "host string, Registered_Domain string, key string")
    made = suffixes.with_registered_domain(rows, rules)
    assert sorted(map(tuple, made.collect()), key=repr) == sorted([(None, "k", None, None), *2 * [("www.test.jp.", "k", "jp", "test.jp")], ("10.0.0.1", "k", None, None)], key=repr)
    assert suffixes.with_registered_domain(rows.limit(0), rules).count() == 0
    keyed = {r["host"]: (r["k"], r["s"]) for r in made.select("host", suffixes.shard_key(made.host, made.registered_domain).alias("k"), suffixes.shard(made.host, made.registered_domain, 7).alias("s")).collect()}
    assert keyed["www.test.jp."][0] == "test.jp" and keyed["10.0.0.1"][0] == "10.0.0.1" and keyed[None] == (None, None)
    direct = spark.range(1).select(hashes.shard(suffixes.F.lit("test.jp"), 7).alias("s")).first()["s"]
    assert keyed["www.test.jp."][1] == direct
