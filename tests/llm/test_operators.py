"""The operators of the subpackage against brute force, and their defined results at the edges."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import bpe, chat, language, lines, lm, media, packing, quality, simhash, urls
from weftline.llm.queries import tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "id string, fingerprint string, label string, word string, removed string, row string, version string, chunk string, ids string"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "Δέλτα", "été"]) for _ in range(60_000)) + "\n\nend"
    rows = [(1, "same words here in this line", "en", "a", 5), (1, "same words here in this line", "en", "a", 5), (2, None, "en", "a", None), (3, "", None, None, 0), (None, "same words here in this line", None, "b", 1)]
    rows += [(4, " \n\t ", "en", "c", 4), (5, long, "en", "a", len(long)), (6, "x", "fr", "b", 1), (7, "😀 \x1c\x85 <|endoftext|> \\### ", "fr", "b", 1)]
    frame = spark.createDataFrame(rows, DOCS)
    return frame.select("*", *[F.lit("clash").alias(c.split()[0]) for c in CLASH.split(", ")])


def empty_documents(spark):
    return odd_documents(spark).limit(0)


# near-duplicates


def slow_components(prints: dict, radius: int) -> dict:
    ids = list(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return {i: find(i) for i in ids}


def slow_print(text, words=4):
    found = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(found[i : i + words]), 42) for i in range(max(1, len(found) - words + 1))] if found else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_covering_masks_miss_no_pair():
    masks = simhash.covering_masks(4)
    rng = random.Random(1)
    assert len(masks) == 31 and all(m.bit_count() >= 28 for m in masks)
    for _ in range(3000):
        change = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        assert any(m & change == 0 for m in masks)
        assert all(any(m & change == 0 for m in simhash.covering_masks(4, level)) for level in (1, 4))


def test_spanning_links_equal_all_links():
    rng = random.Random(2)
    for _ in range(30):
        base = rng.getrandbits(64)
        values = list({base ^ sum(1 << b for b in rng.sample(range(rng.choice([12, 40])), rng.randint(0, 6))) for _ in range(rng.randint(2, 120))})
        prints = dict(enumerate(values))
        parent = {i: i for i in prints}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in simhash.spanning_links(np.array(values, np.uint64), 4):
            assert (values[a] ^ values[b]).bit_count() <= 4
            low, high = sorted((find(a), find(b)))
            parent[high] = low
        assert {i: find(i) for i in prints} == slow_components(prints, 4)


def test_simhash_is_brute_force(spark, docs):
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    near = {10**6 + i: " ".join(w for k, w in enumerate((rows[i] or "").split()) if k % 97 != 5) for i in list(rows)[:80]}
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(near.items()), "doc_id long, text string"))
    prints = {i: slow_print(t) for i, t in (rows | near).items()}
    want = slow_components(prints, 4)
    found = simhash.near_duplicates(both).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    assert len(set(want.values())) < len(want)


def test_crowded_buckets_are_dealt_again(spark, monkeypatch):
    """Near copies of one value and of a neighbour of it, far more than a bucket may hold: no task gets them all, no link is lost."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    values = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for _ in range(900)} | {rng.getrandbits(64) for _ in range(200)}
    prints = dict(enumerate(sorted(values)))
    rows = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in prints.items()], "node long, fingerprint long")
    monkeypatch.setattr(simhash, "BLOCK", 32)
    sizes, whole = [], simhash.bucket_links
    monkeypatch.setattr(simhash, "bucket_links", lambda rows, radius: sizes.append(rows.groupBy("bucket").count().agg(F.max("count")).first()[0]) or whole(rows, radius))
    found = {i: i for i in prints} | {r["node"]: r["root"] for r in simhash.components(simhash.links(rows, 4)).collect()}
    assert found == slow_components(prints, 4)
    assert len(sizes) > 1 and max(filter(None, sizes)) <= 32


def test_simhash_edges(spark):
    found = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(odd_documents(spark)).collect()}
    zero = "0" * 16
    assert found[(2, zero)] == found[(3, zero)] == found[(4, zero)] == 2
    same = f"{slow_print('same words here in this line'):016x}"
    assert found[(1, same)] == found[(None, same)] == 1
    assert simhash.near_duplicates(odd_documents(spark)).count() == 9
    assert simhash.near_duplicates(empty_documents(spark)).count() == 0
    assert simhash.majority(np.full(1000, 1 << 63 | 5, np.uint64)) == 1 << 63 | 5


# packing


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    theirs = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, capacity=300).collect()
    want = {}
    for r in docs.collect():
        ids = np.array([*theirs.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want |= {(r["doc_id"], k // 300): (k, len(ids[k : k + 300]), zlib.crc32(ids[k : k + 300].tobytes())) for k in range(0, len(ids), 300)}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    assert check_packing(rows, 300) <= math.ceil(sum(r["length"] for r in rows) / 300) * 1.02 + 1


def test_packing_edges(spark):
    path = tokenizer("word_bpe_49k.json")
    rows = packing.pack_documents(odd_documents(spark), path).collect()
    check_packing(rows, 2048)
    assert Counter(r["doc_id"] for r in rows)[1] == 2 and next(r for r in rows if r["doc_id"] == 2)["length"] == 1
    assert packing.pack_documents(empty_documents(spark), path).count() == 0


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    theirs, mine, rng = Tokenizer.from_file(path), packing.Encoder(path), random.Random(4)
    pools = ["aB'cs. ", "é́Σσ İı ", "日本1 2½\n", "\x1c\x1f\x85 a ", "😀<|endoftext|>! ", "#*|'ll 't "]
    for _ in range(4000):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 30)))
        if rng.random() < 0.1:
            text = "".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(15))
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, text


def test_fullest_is_optimal():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        room = rng.randint(0, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * m for s in sums for m in range(n + 1)}
        most = max(s for s in sums if s <= room)
        for slack in (0, 1, 3, 20):
            chosen = packing.fullest(counts, room, slack)
            assert most - slack <= sum(k * m for k, m in chosen) <= most and all(m <= counts[k] for k, m in chosen)


def test_plans_are_whole_and_near_the_least():
    """Every length has each of its ranks once; no plan is worse than best-fit decreasing."""
    rng = random.Random(6)
    for turn in range(30):
        lengths = [min(512, max(1, int(rng.lognormvariate(4 + turn % 3, 1)))) for _ in range(rng.choice([1, 60, 400]))]
        slots = packing.plan(dict(Counter(lengths)), 512)
        sequences, ranks = Counter(), Counter()
        for length, first, sequence, times, _ in slots:
            ends = [s[1] for s in slots if s[0] == length and s[1] > first]
            n = min(ends, default=Counter(lengths)[length]) - first
            ranks[length] += n
            for k in range(n):
                sequences[sequence + k // times] += length
        assert ranks == Counter(lengths) and max(sequences.values()) <= 512
        bins = []
        for x in sorted(lengths, reverse=True):
            fit = [i for i, b in enumerate(bins) if b + x <= 512]
            if fit:
                bins[max(fit, key=bins.__getitem__)] += x
            else:
                bins.append(x)
        assert len(sequences) <= len(bins)


# language models


def slow_lm(rows, order=4):
    tokens = lambda t: [*"".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split(), None]
    times, texts = Counter(), 0
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            w, texts = [0, *tokens(t)], texts + 1
            times.update(tuple(w[j - k : j]) for k in range(1, order + 1) for j in range(max(2, k), len(w) + 1))
    n, v = sum(c for g, c in times.items() if len(g) == 1), sum(len(g) == 1 for g in times)
    times[(0,)] = texts

    def probability(context, x):
        if not context:
            return (times[(x,)] + 1) / (n + v + 1)
        c, below = times[context], probability(context[1:], x)
        mass = 6.0 * c**0.85 if len(context) == 1 else 8.0 / max(c, 1) + c**0.8
        return (times[(*context, x)] + mass * below) / (c + mass) if c else below

    for i, t in rows:
        w = [0, *tokens(t)]
        base = sum(math.log10(probability((), x)) for x in w[1:])
        own = sum(math.log10(probability(tuple(w[max(0, j - order + 1) : j]), w[j])) for j in range(1, len(w)))
        yield i, len(w) - 1, sum(times[(x,)] > 0 for x in w[1:]), n, base, own


def test_lm_is_brute_force(spark, docs, sf_dir, monkeypatch):
    from weftline.llm.queries import queries

    monkeypatch.setattr(lm, "PART", 50)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = {r["doc_id"]: r for r in queries()["op3_lm"](spark, sf_dir).collect()}
    assert len(found) == len(rows)
    for i, tokens, known, n, base, own in slow_lm(rows):
        r = found[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, n)
        assert r["base_score"] == pytest.approx(base, abs=1e-6) and r["score"] == pytest.approx(own, abs=1e-6)
    held = lambda rows: sum(r["score"] for r in rows if r["held_out"])
    assert held(found.values()) > held(lm.score(docs, order=2).collect()) > sum(r["base_score"] for r in found.values() if r["held_out"])


def test_lm_many_chunks(spark, docs):
    few, many = ({r["doc_id"]: r["score"] for r in lm.score(docs, chunk_bytes=c).collect()} for c in (8 << 20, 20_000))
    assert few == pytest.approx(many, abs=1e-6)


def test_lm_is_a_distribution():
    """From each state the weights of all words, one of them unknown, add up to a probability of 1."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcde", k=30)).encode() for _ in range(4)] + [b"a b unknown"]
    trains = np.array([True] * 4 + [False])
    chunk = lm.Chunk(texts, trains, 4, 40)
    for _, a, b, n, c, d, m in chunk.requests(0, 3):
        words, grams = lm.widened(n, len(a) // lm.WORD_LOW), lm.widened(m, len(c) // 3)
    chunk.number(0)
    tokens, different = int(words.sum()), int((words > 0).sum())
    machine = lm.Automaton(chunk, words, grams, tokens, different, (6.0, 0.85, 8.0, 0.8))
    states = np.unique(np.concatenate([[0], machine.target[machine.arcs]]))
    assert len(states) > 100 and {len(chunk.words) + 1} < set(range(len(machine.back)))
    for state in [*states.tolist(), len(chunk.words) + 1]:
        words = np.arange(1, len(chunk.words) + 1)
        reached, weight = machine.step(np.full(len(words), state), words)
        assert (10.0**weight).sum() == pytest.approx(1.0)
        assert np.all((machine.back[reached] < 0) | (reached == 0))


def test_sorted_numbers_are_packed_without_loss():
    rng = np.random.default_rng(1)
    for n, top in ((0, 30), (1, 30), (5000, 30), (3000, 40)):
        values = np.unique(rng.integers(0, 1 << top, n).astype(np.uint64))
        assert np.array_equal(lm.unpack_sorted(*lm.pack_sorted(values, 3), 3), values)
    for most in (0, 255, 256, 70_000, 1 << 33):
        numbers = np.array([0, most, 1])
        assert np.array_equal(lm.widened(lm.narrow(numbers), 3), numbers)


def test_lm_edges(spark):
    found = [r for r in lm.score(odd_documents(spark)).collect()]
    assert len(found) == 9 and all(r["n_tokens"] == 1 for r in found if r["doc_id"] in (2, 3, 4))
    assert lm.score(empty_documents(spark)).count() == 0
    apart = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    lone = lm.score(spark.createDataFrame([(apart, "a b")], "doc_id long, text string")).first()
    assert (lone["held_out"], lone["n_tokens"], lone["n_known"], lone["train_tokens"], lone["score"]) == (True, 3, 0, 0, 0.0)
    data = b" x" * (lm.SLICE // 2 + 7) + b" " + b"y" * (lm.SLICE + 5) + b" z"
    hashes, starts = lm.word_hashes(data)
    assert len(hashes) == len(data.split()) and len(set(hashes.tolist())) == 3 and data[starts[-1] : starts[-1] + 1] == b"z"


# URLs


RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def slow_rule(url):
    _, found, rest = (url or "").partition("://")
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest)) if found else 0
    host, tail = (rest[:cut], rest[cut:]) if found else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [r for r in RULES for name, _, p in [r.partition("/")] if (host == name or host.endswith("." + name)) and path.startswith("/" + p)]
    return host, path, max(fit, key=len, default=None)


def test_url_rules(spark, sf_dir):
    odd = [None, "", "no scheme", "http://", "HTTP://A.ORG/x", "http://example.org/es/1?x=/", "http://x.Example.ORG/en/12", "http://notexample.org/en/1", "http://b.com/de/", "http://b.com?q=/de/", "http://é.com/fr/#f", "x://y://z/", "http://org", "http://org/\n?"]
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame([(-i, u) for i, u in enumerate(odd, 1)], "page_id long, url string"))
    found = urls.judge(pages.withColumns({"length": F.lit(1), "features": F.lit("x"), "row": F.lit(2), "label": F.lit(3)}), RULES)
    for r in found.collect():
        host, path, rule = slow_rule(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), r
        assert r["verdict"] == RULES[rule] if rule else r["verdict"] in ("allow", "block")
    assert found.count() == pages.count()


def test_url_trees_learn(spark):
    rows = [(i, f"http://h{i % 9}.org/a{i}") for i in range(200)] + [(1000 + i, f"http://h{i % 9}.com/de/{'9' * 30}{i}?a=1&b=2") for i in range(200)]
    rows += [(5000, "http://h1.net/a7"), (5001, "http://h2.net/de/" + "9" * 30 + "?a=1&b=2")]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), RULES).collect()}
    assert got[5000] == "allow" and got[5001] == "block"


def test_url_edges(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(none, RULES).count() == 0
    alone = spark.createDataFrame([(1, "http://a.com/de/"), (2, "http://b.net/")], "page_id long, url string")
    assert {r["verdict"] for r in urls.judge(alone, RULES).collect()} == {"block"}
    assert {r["verdict"] for r in urls.judge(alone, {}).collect()} == {"allow"}


# chat


def test_chat_round_trip():
    rng = random.Random(6)
    parts = ["### ", "</turn>", " </turn>\n", "\\", "\n", "User: ", "a", " ", ":", ")", "Role(", "#", "<"]
    for _ in range(5000):
        turns = [(rng.choice(["user", "assistant", "system", "x)", "", "User", "a: ", "\\"]), "".join(rng.choices(parts, k=rng.randint(0, 8)))) for _ in range(rng.randint(0, 4))]
        text, spans = chat.formatted(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
        held = "".join(t for _, t in turns)
        assert (text == chat.render(turns)[0]) == (not any(x in t for _, t in turns for x in ("### ", "</turn>")) and chat.comes_back(turns, chat.render(turns)[0])), held
    for bad in ("### User: no end", "### User: a ### b </turn>\n", "x"):
        with pytest.raises(ValueError):
            chat.parse(bad)


def test_chat_escapes_only_what_conflicts():
    plain, odd = ("user", "a \\ b"), ("assistant", "</turn>")
    assert chat.formatted([("user", "C:/x # y < z"), ("assistant", "ok")])[0] == "### User: C:/x # y < z </turn>\n### Assistant: ok </turn>\n"
    assert chat.formatted([("user", "fine"), odd])[0] == "### User: fine </turn>\n### Assistant: \\</turn> </turn>\n"
    assert chat.formatted([plain, odd])[0] == "### User: a \\\\ b </turn>\n### Assistant: \\</turn> </turn>\n"


def test_chat_query_is_the_source(spark, sf_dir):
    """op5, with conversation -7, against digests made from the table itself."""
    from weftline.llm.queries import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    source: dict = {-7: [("user", said), ("assistant", said)]}
    for key, _, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")):
        source.setdefault(key, []).append((role or "", text or ""))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    found = {r["conv_id"]: r for r in queries()["op5_chat"](spark, sf_dir).collect()}
    assert set(found) == set(source)
    for key, turns in source.items():
        loss, r = "".join(t for role, t in turns if role == "assistant"), found[key]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), digest("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), digest(loss))
        assert r["formatted_chars"] == len(chat.formatted(turns)[0]) > sum(len(b) for _, b in turns)


def test_chat_edges(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, None, None), (None, 3, "user", "x" * 200_000), (3, 0, "assistant", "### Assistant: </turn>")], "conv_id long, turn long, role string, text string")
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(rows.withColumn("formatted", F.lit(1)).withColumn("id", F.lit(2)))).collect()}
    assert [tuple(t) for t in back[1]["turns"]] == [("user", "a"), ("user", "a"), ("assistant", "b")] and back[1]["loss"] == "b"
    assert [tuple(t) for t in back[2]["turns"]] == [("", "")] and back[2]["loss"] == "" and len(back[None]["turns"][0]["text"]) == 200_000
    assert back[3]["loss"] == "### Assistant: </turn>" and back[3]["formatted"].count("\n") == 1
    assert chat.format_conversations(rows.limit(0)).count() == 0


# media


PAGE = '<p>One <b>two</b></p><figure><img src="sha256:aa" alt="x"><figcaption> A  cap </figcaption></figure>tail<img data-digest="bb" alt="B"><script>no</script><p>last'


def test_media_sequences(spark):
    found = media.sequences(spark.createDataFrame([(1, PAGE), (2, None), (3, "<figcaption>x<img")], "page_id long, html string"))
    rows = {r["page_id"]: r["items"] for r in found.collect()}
    assert [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in rows[1]] == [(0, "text", "One two", None, None), (1, "media", None, "aa", "A cap"), (2, "text", "tail", None, None), (3, "media", None, "bb", "B"), (4, "text", "last", None, None)]
    assert rows[2] == []
    resolved = media.resolve(found, spark.createDataFrame([("aa", bytearray(b"p"))], "digest string, media binary")).where("page_id = 1").orderBy("position").collect()
    assert [(r["position"], r["caption"], r["media"]) for r in resolved] == [(0, None, None), (1, "A cap", bytearray(b"p")), (2, None, None), (3, "B", None), (4, None, None)]


def test_media_malformed_pages():
    """Marked sections, heads without an end, captions without an end, random markup: nothing raises, no text is lost."""
    told = lambda page: [(i["kind"], i["text"] or i["caption"]) for i in media.parse_page(page)]
    assert told("<p>a</p><![foo bar]]><p>b</p>") == [("text", "a"), ("text", "b")]
    assert told("<html><head><title>x</title><body><p>Hello there</p><img src='sha256:aa' alt='A'>") == [("text", "Hello there"), ("media", "A")]
    assert told("<figure><img src='sha256:aa'><figcaption>cap</figure><p>one</p><p>two</p>") == [("media", "cap"), ("text", "one"), ("text", "two")]
    assert told("<figure><img alt='A'><figcaption>cap<p>one</p><p>two</p>") == [("media", "A"), ("text", "cap one two")]
    rng = random.Random(11)
    pieces = ["<", ">", "</", "<!", "<![", "]]>", "<!--", "-->", "<?", "p", "head", "figure", "figcaption", "img src=", '"', "'", "&#x", "=", "/", " ", "script", "x", "CDATA["]
    for _ in range(3000):
        media.parse_page("".join(rng.choices(pieces, k=rng.randint(0, 25))))


def test_names_that_clash_in_another_case(spark, sf_dir):
    """Extra columns named like results or helpers in another letter case, or with a dot, neither crash nor replace a result."""
    rows = [(i, f"some words of text {i}\nline", "en", f"s{i % 2}", 1) for i in range(12)]
    names = ["HOST", "Verdict", "N_LINES", "IDS", "SCORE", "Lang_Pred", "__held_out", "a.b", "NODE", "Version", "ID", "Row", "Removed", "Chunk"]
    docs = spark.createDataFrame(rows, DOCS).select("*", *[F.lit("clash").alias(n) for n in names])
    judged = urls.judge(docs.withColumn("url", F.lit("http://a.org/x")), {"org/": "allow"})
    assert {(r["verdict"], r["host"]) for r in judged.collect()} == {("allow", "a.org")} and "`a.b`" in f"`{'`, `'.join(judged.columns)}`"
    assert lines.dedup_lines(docs).select("n_lines", "`a.b`").distinct().collect() == [(2, "clash")]
    assert {len(r["ids"]) > 3 for r in bpe.encode(docs, tokenizer("byte_bpe_50k.json")).select("ids").collect()} == {True}
    assert language.keep_languages(docs).count() <= 12 and quality.keep_good(docs).count() == 0
    assert {type(r["score"]) for r in language.identify(docs).collect()} == {float} and lm.score(docs).count() == 12
    assert quality.judge(docs).count() == simhash.near_duplicates(docs).count() == media.document_media(docs).count() == 12
    assert packing.pack_documents(docs, tokenizer("word_bpe_49k.json")).count() == 12


def test_media_documents(spark, docs):
    rows = docs.select("doc_id", "text").unionByName(odd_documents(spark).select("doc_id", "text"))
    found = media.document_media(rows)
    by_text = {}
    assert found.count() == rows.count()
    texts = Counter()
    for r in rows.collect():
        data = (r["text"] or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        texts[(r["doc_id"], len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))] += 1
    mine = Counter()
    for r in found.collect():
        mine[(r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"])] += 1
        assert by_text.setdefault(r["payload_sha256"], (r["media_bytes"], r["media_sha256"], r["feature"])) == (r["media_bytes"], r["media_sha256"], r["feature"])
    assert mine == texts
    assert media.document_media(empty_documents(spark)).count() == 0


# language


def test_language_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    found = {r["doc_id"]: r for r in language.identify(odd_documents(spark)).collect()}
    assert {k for k, r in found.items() if r["lang_pred"] == "und"} == {2, 3, 4}
    assert language.identify(odd_documents(spark)).count() == 9
    assert language.identify(empty_documents(spark)).count() == 0
    unlabelled = odd_documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(unlabelled).collect()} == {"und"}
    assert {r["doc_id"] for r in language.keep_languages(odd_documents(spark)).collect()}.isdisjoint({2, 3, 4})
    assert {r["held_out"] for r in language.identify(odd_documents(spark)).collect() if r["doc_id"] is None} == {False}


# lines


def slow_lines(rows, least):
    seen, keeper = {}, {}
    for i, t, site in rows:
        for line in (t or "").split("\n"):
            if line.strip():
                seen.setdefault(line.strip(), set()).add(site)
                keeper.setdefault(line.strip(), []).append(i)
    bad = {k: min((x for x in keeper[k] if x is not None), default=None) for k, s in seen.items() if len(s - {None}) >= least}
    for i, t, _ in rows:
        if t is None:
            yield i, t, 0, 0
            continue
        parts = t.split("\n")
        kept = [x for x in parts if not (x.strip() in bad and bad[x.strip()] != i)]
        if len(kept) == len(parts) or "".join(kept).strip():
            yield i, "\n".join(kept), len(parts), len(parts) - len(kept)


@pytest.mark.parametrize("least", [2, 4, 10])
def test_lines_are_brute_force(spark, least):
    rng = random.Random(least)
    common = [f"common line {i}" for i in range(30)]
    rows = [(i, "\n".join(rng.choice([rng.choice(common), " " + rng.choice(common), f"own {i} {k}", "", "\t"]) for k in range(rng.randint(0, 9))), rng.choice([None, *map(str, range(14))])) for i in range(200)]
    rows += [(500, None, "1"), (501, "common line 1", "2"), (None, "common line 2\nrest", "3"), (7, "common line 1\nx", "1"), (7, "common line 1\nx", "1")]
    found = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"row": F.lit(1), "id": F.lit(2), "n_removed": F.lit(3)}), least_sites=least)
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in found.collect()) == Counter(slow_lines(rows, least))


def test_lines_edges(spark):
    assert lines.dedup_lines(empty_documents(spark)).count() == 0
    assert lines.dedup_lines(odd_documents(spark)).count() == 9


def test_media_is_stored_once_and_read_back(spark, monkeypatch):
    """What is read back comes from a table with the bytes of each different payload."""
    written = {}
    monkeypatch.setattr(media, "cut", lambda df, name, real=media.cut: written.setdefault(name, real(df, name)))
    rows = spark.createDataFrame([(1, "same"), (2, "same"), (3, None)], "doc_id long, text string")
    assert media.document_media(rows).count() == 3
    stored = written["stored"].collect()
    assert sorted(media.samples(bytes(r["media"])).rstrip(b"\x00") for r in stored) == [b"", b"same"]
    assert all(hashlib.sha256(r["media"]).hexdigest() == r["digest"] for r in stored)


# quality


def slow_counts(text):
    words = (text or "").encode().split()
    lines_ = [x for x in (text or "").encode().split(b"\n") if x.split()]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines_[:i] for i, x in enumerate(lines_)), len(inside)


def test_quality_counts():
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "c\n", "# ", "é\t", "a b c ", "\n", "\x0b", "\x85"]) for _ in range(rng.randint(0, 40)))
        assert quality.word_counts(text) == slow_counts(text)
    assert quality.word_counts(None) == (0, 0, 0, 0, 0)


def slow_kneser_ney(texts, order=4):
    """Log-probability of each character of a text under modified Kneser-Ney, by the definition."""
    fold = lambda t: (10,) * (order - 1) + tuple(quality.symbols(t).tolist())
    times = [Counter() for _ in range(order)]
    for t in texts:
        s = fold(t or "")
        times[-1].update(s[i - order + 1 : i + 1] for i in range(order - 1, len(s)))
    for k in range(order - 2, -1, -1):
        times[k].update(g[1:] for g in times[k + 1])
    take, total, freed = [], [Counter() for _ in range(order)], [Counter() for _ in range(order)]
    for k in range(order):
        n1, n2, n3, n4 = (sum(c == x for c in times[k].values()) for x in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3] if n1 and n2 and n3 and n4 else [0.5, 1.0, 1.5]
        take.append([min(max(x, 0.05), top - 0.05) for x, top in zip(d, (1, 2, 3), strict=True)] if n1 and n2 and n3 and n4 else d)
        for g, c in times[k].items():
            total[k][g[:-1]] += c
            freed[k][g[:-1]] += take[k][min(c, 3) - 1]

    def p(g):
        if not g:
            return 1 / 4096
        k, below = len(g) - 1, p(g[1:])
        if not total[k][g[:-1]]:
            return below
        c = times[k][g]
        return (max(c - take[k][min(c, 3) - 1], 0) if c else 0) / total[k][g[:-1]] + freed[k][g[:-1]] / total[k][g[:-1]] * below

    known = {}

    def cost(t):
        s = fold(t or "")
        grams = [s[i - order + 1 : i + 1] for i in range(order - 1, len(s))]
        known.update((g, math.log(p(g))) for g in set(grams) - set(known))
        return -sum(known[g] for g in grams)

    return cost


ALPHABETS = ["en the and of text a line", "привет как дела это текст о языке", "日本語の文章です。漢字とかなを使う", "السلام عليكم هذا نص عربي"]


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_kneser_ney_is_the_definition(alphabet):
    rng = random.Random(alphabet)
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 400))) for _ in range(20)]
    found, sizes = quality.grams(texts)
    keys, n = np.unique((2 << quality.GRAM_BITS) | found, return_counts=True)
    model, slow = quality.kneser_ney(keys, n), slow_kneser_ney(texts)
    more = [*texts, "other words 12 !", "", None, alphabet * 3]
    assert model.costs([2] * len(more), more) == pytest.approx([slow(t) for t in more], rel=1e-5, abs=1e-6)
    assert len(set(quality.symbols(alphabet).tolist())) == len(set(alphabet))


@pytest.mark.parametrize("most", [quality.MOST, 0])
def test_quality_verdicts_are_brute_force(spark, sf_dir, monkeypatch, most):
    """op9's query: counts, and a band for each language from quartiles of steps of a thousandth; with a model that is broadcast, and as tables."""
    from weftline.llm.queries import queries

    monkeypatch.setattr(quality, "MOST", most)

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    found = {r["doc_id"]: r for r in queries()["op9_quality"](spark, sf_dir).collect()}
    assert len(found) == len(rows)
    for language in {r["lang"] for r in rows}:
        own = [r for r in rows if r["lang"] == language]
        cost = slow_kneser_ney([r["text"] for r in own])
        values, passing = {}, []
        for r in own:
            n_words, chars, marks, *_, repeats = counts = slow_counts(r["text"])
            values[r["doc_id"]] = cost(r["text"]) / max(1, chars - marks)
            failed = n_words < 50 or 100 * repeats > 50 * n_words
            f = found[r["doc_id"]]
            assert (*(f[c] for c in quality.FIELDS), f["base_failed"]) == (*counts, failed)
            assert f["log_perplexity"] == pytest.approx(values[r["doc_id"]], rel=1e-5)
            passing += [] if failed else [math.floor(f["log_perplexity"] * 1000)]
        passing.sort()
        q1, q3 = ((passing[math.ceil(len(passing) * q) - 1] + 0.5) / 1000 for q in (0.25, 0.75)) if passing else (0, 0)
        reach = max(4 * (q3 - q1), 0.4)
        for i, x in values.items():
            assert found[i]["kept"] == (not found[i]["base_failed"] and q1 - reach <= x <= q3 + reach)


def test_quality_rejects_noise(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    rng = random.Random(8)
    noise = [(10**6 + i, " ".join("".join(rng.choices("xqzj#$%&*|", k=6)) for _ in range(80)), "en", "s", 1) for i in range(5)]
    judged = {r["doc_id"]: r for r in quality.judge(docs.unionByName(spark.createDataFrame(noise, DOCS))).collect()}
    assert not any(judged[n[0]]["kept"] or judged[n[0]]["base_failed"] for n in noise)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet").collect()}
    good = [judged[i] for i, q in labels.items() if q == 1 and not judged[i]["base_failed"]]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)
    bad = [judged[i] for i, q in labels.items() if q == 0]
    assert sum(r["kept"] for r in bad) <= 0.1 * len(bad)


def test_quality_counts_all_documents(spark):
    """Tables, prices and capitals are learned from like any other text."""
    texts = ["| a | b |\n|---|---|\n| 1 | $2 |", "WHOLE TEXT IN CAPITALS", "plain words", "", None]
    docs = spark.createDataFrame([(1, t) for t in texts], "language int, text string")
    found = {r["key"]: r["n"] for r in quality.count_grams(docs).collect()}
    assert found == dict(Counter((1 << quality.GRAM_BITS) | g for g in quality.grams(texts)[0].tolist()))
    assert sum(found.values()) == sum(len(t or "") for t in texts)


def test_keep_good_judges_each_row(spark, docs):
    """A null id drops nothing, and of rows that share an id only the good one stays."""
    good = docs.where(F.size(F.split("text", " ")) > 100).where("lang = 'en'").orderBy("doc_id").limit(40).collect()
    rows = [(None if i == 0 else i, r["text"], r["lang"], "s", 1) for i, r in enumerate(good)]
    kept = {r["doc_id"] for r in quality.keep_good(spark.createDataFrame(rows, DOCS)).collect()}
    twice = min(kept - {None})
    found = quality.keep_good(spark.createDataFrame([*rows, (twice, "too short", "en", "s", 1)], DOCS)).collect()
    assert None in kept and {r["doc_id"] for r in found} == kept
    assert [r["text"] for r in found if r["doc_id"] == twice] == [good[twice]["text"]]


def test_quality_edges(spark):
    found = quality.judge(odd_documents(spark)).collect()
    assert len(found) == 9 and all(r["base_failed"] and not r["kept"] for r in found if r["doc_id"] != 5)
    assert quality.judge(empty_documents(spark)).count() == 0 and quality.keep_good(empty_documents(spark)).count() == 0


# BPE


def test_bpe_is_the_library(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    theirs, mine, rng = Tokenizer.from_file(path), bpe.Automaton(path), random.Random(9)
    pools = ["ab ", "aA\n \t", "a1.,!'s t", "é ñ  x", "日本語 \n", "\x1c\x1f\x85 a", "😀🏽‍ z", "<|endoftext|> \n", "  \n\r\na", "́̀e ", "ⅷ½٣ 9", "***###$$$ "]
    monkeypatch.setattr(bpe, "AT_ONCE", 500)
    monkeypatch.setattr(bpe, "REMEMBERED", 900)
    texts = [None, "", "x" * 5000 + " " + "ab" * 700, "a b" * (1 << 19) + "q" * 3000]
    for _ in range(4000):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.1:
            text = "".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(20))
        texts.append(text)
    for text, found in zip(texts, mine.encode(texts), strict=True):
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(found, "<i4").tolist() == ids, text
        assert mine.emit(np.array(ids, np.int64), np.array([0, len(ids)]))[0].decode("utf-8", "replace") == theirs.decode(ids, skip_special_tokens=False)


def test_transition_table_is_the_gadgets():
    """Against the construction with whole rows and columns, for made-up merges, some of them with the same result."""
    rng = random.Random(10)
    for _ in range(40):
        machine = object.__new__(bpe.Automaton)
        vocab, merges, labels = {chr(97 + i): i for i in range(4)}, [], [bytes([97 + i]) for i in range(4)]
        while len(merges) < 25:
            a, b = rng.choice(list(vocab)), rng.choice(list(vocab))
            if (a, b) not in merges and len(a + b) < 9:
                merges.append((a, b))
                if a + b not in vocab:
                    vocab[a + b] = len(vocab)
                    labels.append((a + b).encode())
        machine.labels, machine.size = labels, len(labels)
        machine.compile(merges, vocab)
        table, made = np.zeros((len(vocab), len(vocab)), bool), {0, 1, 2, 3}
        table[:4, :4] = True
        for a, b in merges:
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if z not in made:
                made.add(z)
                table[z, :] = table[y, :]
                table[:, z] = table[:, x]
            table[x, y] = False
            if x == y:
                table[x, z] = False
        every = np.arange(len(vocab))
        assert np.array_equal(machine.arcs(np.repeat(every, len(vocab)), np.tile(every, len(vocab))).reshape(table.shape), table)


def test_bpe_edges(spark):
    path = tokenizer("byte_bpe_50k.json")
    rows = bpe.decode(bpe.encode(odd_documents(spark), path, out="ids"), path, "ids", "fingerprint")
    assert rows.count() == 9 and rows.where(F.coalesce("text", F.lit("")) != F.col("fingerprint")).isEmpty()
    assert "clash" not in [r["fingerprint"] for r in rows.collect()] and {r["label"] for r in rows.collect()} == {"clash"}
    assert bpe.encode(empty_documents(spark), path).count() == 0
    odd = spark.createDataFrame([([-1, 10**6, 0],), ([],), (None,), ([None, 0],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(odd, path).collect()] == ["!", "", "", "!"]


def test_quality_edges_by_tables(spark, monkeypatch):
    """The model as tables on odd rows gives what the broadcast one gives."""
    plain = sorted(map(tuple, quality.judge(odd_documents(spark)).collect()), key=repr)
    monkeypatch.setattr(quality, "MOST", 0)
    found = sorted(map(tuple, quality.judge(odd_documents(spark)).collect()), key=repr)
    assert [r[:8] for r in found] == [r[:8] for r in plain] and all(a[8] == pytest.approx(b[8], rel=1e-5, abs=1e-9) for a, b in zip(found, plain, strict=True))
    assert quality.judge(empty_documents(spark)).count() == 0


def test_long_units_are_not_remembered():
    """Many different long words: what an encoder keeps stays small, and nothing changes."""
    rng = random.Random(21)
    texts = [" ".join("".join(rng.choices("abcdefgh0123/+", k=2000)) for _ in range(30)) + " plain words stay" for _ in range(20)]
    own = bpe.automaton(tokenizer("byte_bpe_50k.json"))
    packer = packing.encoder(tokenizer("word_bpe_49k.json"))
    first = own.encode(texts), [packer.encode(t) for t in texts]
    for known in (own.known, packer.words):
        assert max(map(len, known)) <= bpe.LONGEST and sum(len(k) + len(v) for k, v in known.items() if len(k) > 60) < 1 << 16
    assert (own.encode(texts), [packer.encode(t) for t in texts]) == first
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    assert [np.frombuffer(x, "<i4").tolist() for x in first[0]] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_kept_rows_keep_columns_of_any_name(spark, docs):
    """Columns named as helpers of the filters neither clash nor vanish; null ids and ids that texts share keep their own rows."""
    from weftline.llm import similar

    names = ("__id", "__version", "__row_version", "__kept_id", "__kept_version", "id", "version", "kept_id", "kept_version", "row")
    rows = docs.limit(60).withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for keep in (quality.keep_good, similar.keep_one):
        kept = keep(rows)
        assert kept.columns == rows.columns
        found = kept.collect()
        assert found and all(r[n] == f"{n}{r['doc_id']}" for r in found for n in names)
