"""BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens. It starts with one state that loops over the 256 bytes; each merge (a, b) -> c, in rank
order, adds a gadget: a state c that copies the arcs state b had until then, an arc labelled c beside every arc
labelled a, and the arc from a to b goes. A path that the finished automaton accepts is the one BPE segmentation of its
bytes. It is deterministic: a state is the token read last. Its transition table, 50,000 by 50,000 for usual vocabularies,
is stored as the runs of labels that each state has no arc for (see `Automaton.compile`).

Encoding reads a word's bytes from left to right: every prefix has one path, whose last token is the state there, and the
table says which tokens go on from it; nothing is tried twice. Decoding emits the labels of the arcs. What a worker
remembers of words is bounded by their number and their length.

Edge cases: null text encodes as no ids and decodes as an empty string; ids outside the vocabulary emit nothing;
invalid UTF-8 that ids spell decodes with U+FFFD; strings of special tokens inside a text become their ids, as in the
tokenizers library. Texts of any length are read whole, a word in time that grows with its length. Equal texts have equal ids, and
repeated rows stay; an empty table gives no rows. Extra columns pass through; an existing output column is replaced, in whatever case.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: White space as the pre-tokenizer's patterns see it, and the byte-level split pattern's contractions.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

#: A white-space character with the run after it, or all but the last of longer white space: ends where words end.
UNIT = re.compile(rf"[{SPACE}]?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])")
WORD = regex.compile("|".join(CONTRACTIONS) + rf"| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

#: Units whose ids a worker remembers, characters of the longest of these, and characters that are encoded at once.
REMEMBERED, LONGEST, AT_ONCE = 300_000, 64, 1 << 20
#: Words up to this many bytes are read side by side.
SHORT = 48


def byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Compiled from a tokenizers file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        stand_in = byte_chars()
        to_bytes = lambda s: bytes(stand_in[c] for c in s)
        vocab = spec["model"]["vocab"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))])
        self.size = size
        self.labels: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.labels[i] = to_bytes(token)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for content, i in self.special.items():
            self.labels[i] = content.encode()
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.compile([tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]], vocab)
        self.known: dict[str, bytes] = {}

    def compile(self, merges: list[tuple[str, str]], vocab: dict[str, int]) -> None:
        """The transition table, by one merge gadget after the other.

        A gadget (a, b) -> c adds the state c beside b, whose arcs it copies, and the label c beside a, beside whose arcs it
        stands; then it takes the arc from a to b away. Copies made later lack what is gone by then, and copies made earlier
        keep it. (Of three equal tokens the first two merge: with a = b the arc from a to c goes as well.) With states and labels in an order in which every copy stands right after its original, the later ones nearer,
        what a gadget takes away from all states at once is a block: a run of states by a run of labels.
        """
        made: dict[int, int] = {}
        after: tuple[dict[int, list[int]], ...] = ({}, {})  # of each state, and of each label, its copies in order
        gadgets = []
        for when, (left, right) in enumerate(merges):
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            gadgets.append((a, b, when))
            if c not in made:
                made[c] = when
                after[0].setdefault(b, []).append(c)
                after[1].setdefault(a, []).append(c)
        singles = [i for i in vocab.values() if len(self.labels[i]) == 1 and i not in made]
        places, ends = [], []  # where each state, and each label, stands, and where its copies end
        for copies in after:
            place, end, order, todo = {}, {}, 0, [(i, False) for i in reversed(singles)]
            while todo:
                i, done = todo.pop()
                if done:
                    end[i] = order
                    continue
                place[i] = order
                order += 1
                todo.append((i, True))
                todo += [(c, False) for c in copies.get(i, ())]
            places.append(place)
            ends.append(end)

        def run(side: int, i: int, since: int) -> tuple[int, int]:
            """i and those of its copies that are made from then on."""
            copies = after[side].get(i, [])
            k = bisect_left(copies, since, key=made.__getitem__)
            return places[side][i], ends[side][copies[k]] if k < len(copies) else places[side][i] + 1

        blocks = np.array([(*run(0, a, when + 1), *run(1, b, when)) for a, b, when in gadgets], np.int64).reshape(-1, 4)
        # Of each state the runs of labels that have no arc, in order; a run within another is dropped.
        high = blocks[:, 1] - blocks[:, 0]
        state = np.repeat(blocks[:, 0], high) + np.arange(high.sum()) - np.repeat(np.cumsum(high) - high, high)
        width = len(places[1]) + 1
        first, past = (state * width + np.repeat(blocks[:, k], high) for k in (2, 3))
        order = np.lexsort((-past, first))
        first, past = first[order], past[order]
        reach = np.concatenate([[-1], np.maximum.accumulate(past)[:-1]]) if len(past) else past
        self.first, self.past = first[first >= reach], past[first >= reach]
        # The trie over labels: nodes are numbers, keys (node, byte) lead to nodes, and token says which label ends at a node.
        self.state, self.place = (np.zeros(self.size, np.int64) for _ in range(2))
        keys, token, node_of = {}, [-1], {}
        for i, p in places[1].items():
            self.state[i], self.place[i] = places[0][i] * width, p
            node = 0
            for byte in self.labels[i]:
                key = node << 8 | byte
                node = keys.get(key)
                if node is None:
                    node = keys[key] = len(token)
                    token.append(-1)
            token[node] = i
        self.keys = keys
        self.trie_keys = np.array(sorted(keys), np.int64)
        self.trie_next = np.array([keys[k] for k in self.trie_keys.tolist()], np.int32)
        self.token = np.array(token, np.int32)
        self.sizes = np.array([len(x) for x in self.labels], np.int32)

    def arcs(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Whether each state has an arc with the label beside it."""
        at = self.state[states] + self.place[labels]
        k = np.searchsorted(self.first, at, "right") - 1
        return (k < 0) | (at >= self.past[k])

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of pre-split words. The automaton reads the bytes of many words side by side: each place is reached by one
        path, whose last token is the state there, and the table says which tokens go on from it."""
        found: list[bytes] = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if w:
                by_size.setdefault(-(-len(w) // 12) * 12 if len(w) <= SHORT else SHORT + 1, []).append(i)
        for size, places in by_size.items():
            for at in range(0, len(places), 32_768):
                some = places[at : at + 32_768]
                made = map(self.alone, (words[i] for i in some)) if size > SHORT else self.side_by_side([words[i] for i in some])
                for i, ids in zip(some, made, strict=True):
                    found[i] = ids
        return found

    def alone(self, word: bytes) -> bytes:
        """The same for one long word, a byte at a time."""
        last, keys, token = [-1] * (len(word) + 1), self.keys, self.token
        for i in range(len(word)):
            if i and last[i] < 0:
                continue
            node = 0
            for j in range(i, len(word)):
                node = keys.get(node << 8 | word[j])
                if node is None:
                    break
                if last[j + 1] < 0 and (v := int(token[node])) >= 0 and (not i or self.arcs(last[i], v)):
                    last[j + 1] = v
        path, n = [], len(word)
        while n:
            path.append(last[n])
            n -= len(self.labels[last[n]])
        return np.array(path[::-1], "<i4").tobytes()

    def side_by_side(self, words: list[bytes]) -> list[bytes]:
        lengths = np.array([len(w) for w in words])
        width = int(lengths.max())
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        last = np.full((len(words), width + 1), -1, np.int32)  # the token that the path to each place ends with
        longest = len(max(self.labels, key=len))
        for i in range(width):
            own = np.flatnonzero((lengths > i) & ((last[:, i] >= 0) | (i == 0)))
            node = np.zeros(len(own), np.int64)
            for j in range(i, min(width, i + longest)):
                inside = lengths[own] > j
                own, node = own[inside], node[inside]
                if not len(own):
                    break
                key = node << 8 | text[own, j]
                k = np.minimum(np.searchsorted(self.trie_keys, key), len(self.trie_keys) - 1)
                goes = self.trie_keys[k] == key
                own, node = own[goes], self.trie_next[k[goes]].astype(np.int64)
                token = self.token[node]
                ends = np.flatnonzero((token >= 0) & (last[own, j + 1] < 0))
                if i:
                    ends = ends[self.arcs(last[own[ends], i], token[ends])]
                last[own[ends], j + 1] = token[ends]
        # Back along the paths.
        rows, place, steps = np.arange(len(words)), lengths.copy(), []
        while len(rows):
            token = last[rows, place[rows]]
            steps.append((rows, token))
            place[rows] -= self.sizes[token]
            rows = rows[place[rows] > 0]
        counts = np.bincount(np.concatenate([r for r, _ in steps]), minlength=len(words))
        ends = np.cumsum(counts)
        ids = np.empty(int(ends[-1]), "<i4")
        for k, (rows, token) in enumerate(steps):
            ids[ends[rows] - 1 - k] = token
        data = ids.tobytes()
        return [data[4 * (b - n) : 4 * b] for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]

    def learn(self, units: set[str]) -> None:
        """Remembers the ids of units: white space and the word after it."""
        split = {u: (u,) if (u[1:] if u[0] == " " else u).isalpha() else tuple(WORD.findall(u)) for u in units}
        words = sorted({w for own in split.values() for w in own})  # neighbours read the same rows of the table
        ids = dict(zip(words, self.encode_words([w.encode() for w in words]), strict=True))
        for u, own in split.items():
            self.known[u] = ids[own[0]] if len(own) == 1 else b"".join([ids[w] for w in own])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text as little-endian 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            here = set().union(*(units for _, units in held))
            new = here - self.known.keys()
            if len(self.known) + len(new) > REMEMBERED:  # what these texts don't have goes
                self.known = {u: self.known[u] for u in here - new}
            self.learn(new)
            for i, units in held:
                out[i].append(b"".join(map(self.known.__getitem__, units)))
            held.clear()
            for u in new:
                if len(u) > LONGEST:
                    del self.known[u]

        for i, text in enumerate(texts):
            parts = [text or ""]
            if self.split_special is not None and any(s in parts[0] for s in self.special):
                parts = self.split_special.split(parts[0])
            for part in parts:
                if part in self.special:
                    if held:
                        flush()
                    out[i].append(struct.pack("<i", self.special[part]))
                    continue
                units = UNIT.finditer(part) if len(part) > 1 << 20 else iter(UNIT.findall(part))
                while some := list(islice(units, 50_000)):
                    held.append((i, [u if isinstance(u, str) else u[0] for u in some]))
                    size += sum(map(len, held[-1][1]))
                    if size >= AT_ONCE:
                        flush()
                        size = 0
        flush()
        return [b"".join(x) for x in out]

    def emit(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The labels of ids, joined between each two bounds."""
        if not hasattr(self, "flat"):
            self.lengths = np.append(self.sizes, 0).astype(np.int64)
            self.starts = np.concatenate([[0], np.cumsum(self.lengths[:-1])])
            self.flat = np.frombuffer(b"".join(self.labels), np.uint8)
        ids = np.where((ids >= 0) & (ids < self.size), ids, self.size)
        lengths = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(self.starts[ids] - ends[:-1], lengths) + np.arange(ends[-1])
        data = self.flat[at].tobytes()
        cuts = ends[bounds]
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_compiled: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """One for each Python worker and vocabulary."""
    if path not in _compiled:
        _compiled[path] = Automaton(path)
    return _compiled[path]


def _with(batch: pa.RecordBatch, schema: pa.Schema, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([column if f.name == name else batch.column(f.name) for f in schema], schema=schema)


def numbered(df: DataFrame) -> DataFrame:
    """df with numbers for names: Arrow functions don't take names with dots."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def _map(df: DataFrame, out: str, kind: T.DataType, work) -> DataFrame:
    """df with the column that work(batch) makes; batches are cut so that none holds many texts at once."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = [f for f in df.schema.fields if f.name.lower() != out.lower()]  # as Spark compares names
    schema = T.StructType([*fields, T.StructField(out, kind)])
    arrow = to_arrow_schema(schema)
    keep, names = [f.name for f in fields], df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.rename_columns(names)
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                made = work(piece)
                whole = pa.Table.from_batches([piece]).select(keep).append_column(out, made).cast(arrow)
                yield from whole.to_batches()

    return numbered(df).mapInArrow(run, schema)


def encode(df: DataFrame, tokenizer: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with an array of the ids of each whole text. tokenizer: path of a tokenizers file on every executor."""

    def work(batch: pa.RecordBatch) -> pa.Array:
        machine = automaton(tokenizer)
        ids = machine.encode(batch.column(text).to_pylist())
        ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))

    return _map(df, out, T.ArrayType(T.IntegerType()), work)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text that each array of ids spells, special tokens included."""

    def work(batch: pa.RecordBatch) -> pa.Array:
        machine, column = automaton(tokenizer), batch.column(ids)
        lengths = np.asarray(pc.list_value_length(column).fill_null(0), np.int64)
        flat = np.asarray(column.flatten().fill_null(-1), np.int64)
        texts = machine.emit(flat, np.concatenate([[0], np.cumsum(lengths)]))
        return pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())

    return _map(df, out, T.StringType(), work)
