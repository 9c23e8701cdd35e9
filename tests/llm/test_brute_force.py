"""Registered queries whose models SQL can't express, made again in plain Python: language, URL trees, packing at 2048 tokens."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import urls
from weftline.llm.queries import RULES, queries, tokenizer

WORD = 1 << 64


def edges(text):
    """The operator puts a blank before and after the text, also where it begins or ends with one."""
    inner = re.sub(" +", " ", "".join(c.lower()[0] if c.isalpha() else " " for c in text or ""))
    return f" {inner} " if inner.strip(" ") else ""


def counted(text):
    letters, found = edges(text), Counter()
    for start in range(len(letters)):
        key = 0
        for n, c in enumerate(letters[start : start + 3], 1):
            key = (key * 0x9E3779B97F4A7C15 + ord(c) + n) % WORD
            found[((key ^ (key >> 29)) * 0xBF58476D1CE4E5B9 % WORD) >> 49] += 1
    return dict(found)


def soft(xs):
    top = max(xs)
    es = [math.exp(x - top) for x in xs]
    return [e / sum(es) for e in es]


class SlowFtrl:
    """One coordinate at a time, in dictionaries."""

    def __init__(self, classes, alpha=1.0, beta=1.0, l1=0.01, l2=0.001):
        self.classes, self.alpha, self.beta, self.l1, self.l2 = classes, alpha, beta, l1, l2
        self.z, self.n = defaultdict(float), defaultdict(float)

    def weight(self, k, j):
        z = self.z.get((k, j), 0.0)
        if abs(z) <= self.l1:
            return 0.0
        return -(z - math.copysign(self.l1, z)) / ((self.beta + math.sqrt(self.n[k, j])) / self.alpha + self.l2)

    def logits(self, x):
        return [sum(self.weight(k, j) * v for j, v in x.items()) for k in range(self.classes)]

    def learn(self, x, label):
        ws = [{j: self.weight(k, j) for j in x} for k in range(self.classes)]
        p = soft([sum(w[j] * v for j, v in x.items()) for w in ws])
        for k in range(self.classes):
            for j, v in x.items():
                g = (p[k] - (k == label)) * v
                before = self.n[k, j]
                self.n[k, j] = before + g * g
                self.z[k, j] += g - (math.sqrt(before + g * g) - math.sqrt(before)) / self.alpha * ws[k][j]


def test_language_query(spark, sf_dir):
    """TF-IDF over all training rows, the order and the fifth held back, FTRL and the temperature, then every prediction."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40)).alias("o")).collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in docs}
    grams = {r["doc_id"]: counted(r["text"]) for r in docs}
    training = [r for r in docs if not held[r["doc_id"]] and r["lang"] is not None and r["text"] is not None]
    with_any = sum(bool(grams[r["doc_id"]]) for r in training)
    df = Counter(s for r in training for s in grams[r["doc_id"]])
    idf = lambda s: math.log((1 + with_any) / (1 + df[s])) + 1

    def vector(counts):
        values = {s: (1 + math.log(n)) * idf(s) for s, n in counts.items()}
        norm = max(math.sqrt(sum(v * v for v in values.values())), 1e-12)
        return {s: v / norm for s, v in values.items()} | {"bias": 1.0}

    languages = sorted({r["lang"] for r in training})
    rows = []
    for r in sorted(training, key=lambda r: (r["o"], r["lang"])):
        kept = dict(sorted(grams[r["doc_id"]].items(), key=lambda x: (-x[1], x[0]))[:2000])
        if kept:
            rows.append((vector(kept), languages.index(r["lang"])))
    fitted, check = [x for i, x in enumerate(rows) if i % 5], rows[::5]
    model, order = SlowFtrl(len(languages)), np.random.default_rng(7)
    for _ in range(5):
        for i in order.permutation(len(fitted)):
            model.learn(*fitted[i])
    table = [{j: w for j in {j for _, j in model.z} if (w := model.weight(k, j))} for k in range(len(languages))]
    logits = lambda x: [sum(w.get(j, 0.0) * v for j, v in x.items()) for w in table]
    seen = [(logits(x), y) for x, y in check]
    loss = lambda t: -sum(math.log(max(soft([v / t for v in x])[y], 1e-12)) for x, y in seen)
    temperature = min(np.geomspace(0.05, 5, 41), key=loss)
    got = {r["doc_id"]: r for r in queries()["op7_language"](spark, sf_dir).collect()}
    assert got.keys() == grams.keys()
    for key, counts in grams.items():
        assert got[key]["held_out"] == held[key]
        if not counts:
            assert (got[key]["lang_pred"], got[key]["score"]) == ("und", 0.0)
            continue
        p = soft([v / temperature for v in logits(vector(counts))])
        assert got[key]["lang_pred"] == languages[p.index(max(p))] and got[key]["score"] == pytest.approx(max(p), abs=1e-6)


def parsed(lines):
    """A tree of a model's description: (feature, threshold, low, high) or a number."""
    line = next(lines).strip()
    if line.startswith("Predict:"):
        return float(line.split(":")[1])
    feature, threshold = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    low = parsed(lines)
    assert next(lines).strip().startswith("Else")
    return int(feature), float(threshold), low, parsed(lines)


def walked(tree, x):
    while not isinstance(tree, float):
        feature, threshold, low, high = tree
        tree = low if x[feature] <= threshold else high
    return tree


def slot(label):
    return 42 % 1024 if label is None else xxhash.xxh64_intdigest(label.encode(), seed=42) % 1024


def lexical(url):
    """Host, path, rule and the features that need no statistics, with the two slots."""
    text = url or ""
    _, found, rest = text.partition("://")
    host, path = re.fullmatch(r"([^/?#]*)([^?#]*).*", rest, re.DOTALL).groups() if found else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES for name, _, start in [r.partition("/")] if (host == name or host.endswith("." + name)) and path.startswith("/" + start)]
    size, folders = max(1, len(text)), path.split("/")
    numbers = [
        len(text), len(host), len(path), host.count(".") + 1, len([f for f in folders if f]), sum(c in "0123456789" for c in text) / size,
        -sum(n / size * math.log2(n / size) for n in Counter(text).values()), sum(c in "&=" for c in text) + 1 if "?" in text else 0, sum(c in "-_~%+#@!" for c in text),
    ]
    return max(fits, key=len, default=None), numbers, slot(host.rpartition(".")[2]), slot(folders[1] if len(folders) > 1 else None)


def test_url_query(spark, sf_dir, monkeypatch):
    """Features and suffix statistics made again, and the fitted trees walked by hand: every verdict is what they sum to."""
    models = []

    class Kept(urls.GBTClassifier):
        def fit(self, rows):
            models.append(super().fit(rows))
            return models[-1]

    monkeypatch.setattr(urls, "GBTClassifier", Kept)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()
    got = {r["page_id"]: r for r in queries()["op4_urls"](spark, sf_dir).collect()}
    known = {r["page_id"]: lexical(r["url"]) for r in pages}
    assert got.keys() == known.keys()
    labels = {k: RULES[rule] == "block" for k, (rule, *_) in known.items() if rule}
    prior = sum(labels.values()) / len(labels)
    shares = []
    for side in (2, 3):
        groups = defaultdict(list)
        for k, bad in labels.items():
            groups[known[k][side]].append(bad)
        shares.append({s: (sum(g) + 10 * prior) / (len(g) + 10) for s, g in groups.items()})
    lines = models[0].toDebugString.splitlines()
    starts = [i for i, line in enumerate(lines) if line.strip().startswith("Tree ")]
    trees = [(float(re.search(r"weight ([^)]+)\)", lines[i])[1]), parsed(iter(lines[i + 1 :]))) for i in starts]
    assert len(trees) == 10
    for k, (rule, numbers, suffix, folder) in known.items():
        x = [*numbers, shares[0].get(suffix, prior), shares[1].get(folder, prior)]
        margin = sum(w * walked(t, x) for w, t in trees)
        assert got[k]["rule"] == rule and got[k]["verdict"] == (RULES[rule] if rule else "block" if margin > 0 else "allow"), (k, margin)


def test_packing_query(spark, sf_dir):
    """Every piece at 2048 tokens holds the library's ids; sequences have no gap and are as few as the sum of lengths allows, or one more."""
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    want, total = {}, 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array([*theirs.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        want |= {(r["doc_id"], k // 2048): (k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)}
    rows = queries()["op2_packing"](spark, sf_dir).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-total // 2048) + 1
