"""Secret scans: patterns of known secrets, and sliding-window Shannon entropy over candidate strings.

Patterns give the base spans (kinds `assign`, `access`, `hex`). Beside them every run of `CANDIDATE` characters is a candidate.
For each character class a window slides over the candidate's stretches of that class; the counts of characters in the window
change by one character that leaves and one that enters, and with them the sum of c log2 c, from which the entropy follows. Sums
are fixed-point integers, so a window's value doesn't depend on where the sliding began. Windows that reach the class's
bits and hold the kinds of characters it asks for are merged into spans (`entropy_hex`, `entropy_alnum`, `entropy_base64`).

A span is suppressed if the allow list knows it: words that stand in placeholders, identifiers of a public form, values announced as
digests, and what is part of a URL. A span inside a base span or one of a narrower class says nothing new and is left out. Base
spans are never suppressed.

Edge cases: null and empty texts have no spans; texts of any length are read whole, long candidates in overlapping slices;
offsets are code points, ends exclusive; spans are ordered by start, then kind in the order of `KINDS`. Every row is judged by itself, so
ties and repeated rows can't matter; an empty table gives no rows. Extra columns pass through, whatever their names, but for one named as the result.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: The patterns of known secrets.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: Only whole runs of [0-9a-f]+ match, and only those that are long enough.
HEX = re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{LEAST_HEX},}}")
ASSIGN_WORDS = ("passw", "secret", "token", "api")

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Units of the fixed-point entropies in a bit.
UNIT = 1 << 20
#: Characters of a candidate that are looked at in one go.
SLICE = 1 << 17


@dataclass(frozen=True)
class CharacterClass:
    """Windows of `window` characters out of `characters`, with one of each of `needs`, of `bits` a character at least."""

    name: str
    characters: str
    needs: tuple[str, ...]
    window: int
    bits: float


CLASSES = (
    CharacterClass("entropy_hex", DIGITS + "abcdefABCDEF", (DIGITS, "abcdefABCDEF"), 24, 3.0),
    CharacterClass("entropy_alnum", DIGITS + LOWER + UPPER, (DIGITS, LOWER + UPPER), 24, 3.75),
    CharacterClass("entropy_base64", DIGITS + LOWER + UPPER + "+/_=-", (DIGITS, LOWER, UPPER), 24, 4.0),
)
KINDS = ("assign", "access", "hex", *(c.name for c in CLASSES))
SHORTEST = min(c.window for c in CLASSES)
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SHORTEST},}}")


@dataclass(frozen=True)
class AllowList:
    """What is no secret: `words` inside a span (in lower case), `forms` somewhere in it, `before` what stands just before it."""

    words: tuple[str, ...] = ("example", "sample", "placeholder", "changeme", "dummy", "xxxx", "0123456789", "1234567890", "abcdefgh")
    forms: tuple[str, ...] = (r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}", r"^(?i:sha-?(?:1|224|256|384|512)|md5)[=-]")
    before: tuple[str, ...] = (r"(?i:sha-?(?:1|224|256|384|512)|md5|digest|checksum|integrity|etag|commit|revision)[\"']?[\s:=-]{0,3}[\"']?$", r"\S://\S*$")
    #: Characters before a span that `before` may look at.
    reach: int = 256

    def knows(self, span: str, before: str) -> bool:
        return any(w in span.lower() for w in self.words) or any(re.search(p, span) for p in self.forms) or any(re.search(p, before) for p in self.before)


ALLOW = AllowList()
SPAN = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """What the patterns find: leftmost matches that don't overlap, of each kind by itself; then matches that are too short go."""
    found = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def log_table(window: int) -> np.ndarray:
    """c log2 c of each count, in units."""
    c = np.arange(window + 1, dtype=float)
    return np.rint(np.where(c > 0, c * np.log2(np.maximum(c, 1)), 0.0) * UNIT).astype(np.int64)


LOGS = {w: log_table(w) for w in {c.window for c in CLASSES}}
INSIDE = {c.name: np.isin(np.arange(128), np.frombuffer(c.characters.encode(), np.uint8)) for c in CLASSES}
NEEDS = {c.name: [np.isin(np.arange(128), np.frombuffer(n.encode(), np.uint8)) for n in c.needs] for c in CLASSES}


def window_sums(codes: np.ndarray, window: int) -> np.ndarray:
    """The sum of c log2 c over the characters of each window, by its start."""
    n = len(codes)
    if n < window:
        return np.zeros(0, np.int64)
    logs, at = LOGS[window], np.arange(n)
    key = codes.astype(np.int64) * (2 * n) + at
    order = np.argsort(key)
    placed = key[order]
    rank = np.empty(n, np.int64)
    rank[order] = at
    # A character enters beside those of its kind in the window - 1 before it; one leaves from those of the window before.
    enters = rank - np.searchsorted(placed, key - np.minimum(at, window - 1))
    step = logs[enters + 1] - logs[enters]
    gone = at[: n - window]
    leaves = np.searchsorted(placed, key[gone] + window) - rank[gone]
    step[window:] += logs[leaves - 1] - logs[leaves]
    return np.cumsum(step)[window - 1 :]


def in_all(mask: np.ndarray, window: int) -> np.ndarray:
    """How many places of each window are set."""
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[window:] - total[:-window]


def high_windows(codes: np.ndarray, kind: CharacterClass) -> np.ndarray:
    """Starts of the windows of a class that are random enough."""
    if len(codes) < kind.window:
        return np.zeros(0, np.int64)
    high = in_all(INSIDE[kind.name][codes], kind.window) == kind.window
    for need in NEEDS[kind.name]:
        high &= in_all(need[codes], kind.window) > 0
    if high.any():
        high &= LOGS[kind.window][kind.window] - window_sums(codes, kind.window) >= int(kind.bits * kind.window * UNIT)
    return np.flatnonzero(high)


def entropy_spans(text: str, allow: AllowList = ALLOW) -> list[tuple[str, int, int]]:
    """Spans of high entropy that the allow list doesn't know, by class."""
    found = []
    for match in CANDIDATE.finditer(text):
        word, begin = match[0], match.start()
        if len(set(word)) < 8 or not any(d in word for d in DIGITS):  # no class could reach its bits
            continue
        codes = np.frombuffer(word.encode(), np.uint8)
        for kind in CLASSES:
            step = SLICE - kind.window + 1
            starts = np.concatenate([high_windows(codes[k : k + SLICE], kind) + k for k in range(0, len(codes), step)])
            if not len(starts):
                continue
            for group in np.split(starts, np.flatnonzero(np.diff(starts) > kind.window) + 1):
                a, b = int(group[0]), int(group[-1]) + kind.window
                if not allow.knows(word[a:b], text[max(0, begin + a - allow.reach) : begin + a]):
                    found.append((kind.name, begin + a, begin + b))
    return found


def uncovered(new: list[tuple[str, int, int]], old: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The new spans that lie inside none of the old ones."""
    starts = sorted((s, e) for _, s, e in old)
    furthest = list(accumulate((e for _, e in starts), max))
    return [x for x in new if not (k := bisect_right(starts, (x[1], sys.maxsize))) or furthest[k - 1] < x[2]]


def spans(text: str | None, allow: AllowList = ALLOW) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then kind."""
    if not text:
        return []
    found, high = base_spans(text), entropy_spans(text, allow)
    for kind in CLASSES:  # from narrow to wide
        found += uncovered([x for x in high if x[0] == kind.name], found)
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def with_spans(docs: DataFrame, text_col: str = "text", out: str = "spans", allow: AllowList = ALLOW) -> DataFrame:
    """docs with their spans in column `out`: an array of kind, start and end."""
    own = [c for c in docs.columns if c.lower() != out.lower()]
    names = [f"c{k}" for k in range(len(own))]
    text = names[own.index(text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans(t.as_py(), allow)] for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, SPAN_TYPE)], names=[*names, "found"])

    rows = docs.select(*[F.col(c).alias(n) for n, c in zip(names, own, strict=True)])
    found = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("found", SPAN)]))
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, own, strict=True)], F.col("found").alias(out))


def written(found: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """Spans of some kinds as kind:start:end, comma-joined."""
    wanted = F.filter(found, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(wanted, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def redacted(docs: DataFrame, text_col: str = "text", mask: str = "*", allow: AllowList = ALLOW) -> DataFrame:
    """docs with every character of a span masked; the text keeps its length."""
    out = max(docs.columns, key=len) + "_spans"
    found = with_spans(docs, text_col, out, allow)

    def cover(text: Column, span: Column) -> Column:
        size = span["end"] - span["start"]
        return F.concat(F.substr(text, F.lit(1), span["start"]), F.repeat(F.lit(mask), size), F.substr(text, span["end"] + 1))

    return found.withColumn(text_col, F.aggregate(out, F.col(text_col), cover)).drop(out)
