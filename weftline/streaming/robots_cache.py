"""robots.txt as state of a stream: URLs wait until their host's rules are known, and each host is asked once until its rules are old.

In: rows of two kinds, by host. A `url` asks for a verdict; an `answer` is what the host said to a request for its robots.txt (status, body,
Cache-Control header; a null status for no answer at all). Out: `fetch`, where the host should be asked, and a `verdict` for each URL.

A host is asked when a URL finds no rules or old ones, and not again while that request is out; URLs that come meanwhile wait in state, and the
answer releases them all. If no answer comes for `patience_ms` (a lost fetcher), a timer asks again. How long rules count depends on the
answer: a success for as long as its header says, at least and at most as below; a refusal (no robots.txt) allows all; a server error or no answer
forbids all, for a short time.

Edge cases: a null path is the root; a null body has no rules; an answer that nobody asked for counts too; repeated URLs get a verdict each; rows of
other kinds are passed over; a null host is one host. An answer that is late replaces an older one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from weftline.functions import robots

INPUT = "host string, kind string, url string, path string, status int, body string, cache_control string"
OUTPUT = "host string, kind string, url string, allowed boolean, delay double, at long"
#: How long rules count in milliseconds, without a statement and at most; at least; and after an error.
DAY, LEAST, ERROR = 86_400_000, 60_000, 300_000
#: Verdicts of a batch of output.
BATCH = 10_000


def stated(header: str | None) -> int | None:
    """How long a Cache-Control header lets rules count, within bounds; none if it doesn't say."""
    said = {}
    for part in (header or "").lower().split(","):
        name, _, value = part.strip().partition("=")
        said.setdefault(name.strip(), value.strip())
    if "no-store" in said or "no-cache" in said:
        return LEAST
    age = said.get("max-age", "")
    return min(max(1000 * int(age), LEAST), DAY) if age.isascii() and age.isdigit() else None


def entry_of(status: float | None, body: str | None, header: str | None, agent: str) -> tuple[str, float | None, int]:
    """Rules as `robots.program` reads them, the delay, and how long both count."""
    if status is None or status != status or status >= 500:
        return "-/", None, ERROR
    if not 200 <= status < 300:
        return "", None, DAY
    parsed = robots.parse(body, agent)
    return robots.written(parsed["rules"]), parsed["delay"], stated(header) or DAY


def text(value) -> str | None:
    return value if isinstance(value, str) else None


class RobotsCache(StatefulProcessor):
    def __init__(self, agent: str, patience_ms: int = 60_000):
        self.agent, self.patience = agent, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "rules string, delay double, until long")
        self.waiting = handle.getMapState("waiting", "place long", "url string, path string")
        self.request = handle.getValueState("request", "asked long, waiting long")  # when the host was asked, 0 if nothing is out

    def _request(self) -> tuple[int, int]:
        return tuple(self.request.get()) if self.request.exists() else (0, 0)

    @staticmethod
    def _rows(host, kind: str, rows: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        for k in range(0, len(rows), BATCH):
            some = rows[k : k + BATCH]
            yield pd.DataFrame({"host": [host] * len(some), "kind": kind, "url": [r[0] for r in some], "allowed": pd.array([r[1] for r in some], "boolean"), "delay": pd.array([r[2] for r in some], "Float64"), "at": now})

    def _verdicts(self, asked: list[tuple], entry: tuple) -> list[tuple]:
        return [(url, robots.verdict(entry[0], path), entry[1]) for url, path in asked]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        host, now = key[0], timerValues.getCurrentProcessingTimeInMs()
        asked, answer = [], None
        for frame in rows:
            for kind, url, path, status, body, header in zip(*(frame[c] for c in ("kind", "url", "path", "status", "body", "cache_control")), strict=True):
                if kind == "url":
                    asked.append((text(url), text(path)))
                elif kind == "answer":
                    answer = (None if pd.isna(status) else float(status), text(body), text(header))
        out, n = self._request()
        if answer is not None:
            rules, delay, count = entry_of(*answer, self.agent)
            self.entry.update((rules, delay, now + count))
            asked = [self.waiting.getValue((k,)) for k in range(n)] + asked
            for k in range(n):
                self.waiting.removeKey((k,))
            out = n = 0
        entry = self.entry.get() if self.entry.exists() else None
        if entry is not None and now < entry[2]:
            yield from self._rows(host, "verdict", self._verdicts(asked, entry), now)
        else:
            for k, one in enumerate(asked):
                self.waiting.updateValue((n + k,), one)
            n += len(asked)
            if n and not out:
                out = now
                self.handle.registerTimer(now + self.patience)
                yield from self._rows(host, "fetch", [(None, None, None)], now)
        self.request.update((out, n))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Asks again if the request of this timer is still out."""
        now = timerValues.getCurrentProcessingTimeInMs()
        out, n = self._request()
        if out and now >= out + self.patience:
            self.request.update((now, n))
            self.handle.registerTimer(now + self.patience)
            yield from self._rows(key[0], "fetch", [(None, None, None)], now)

    def close(self) -> None: ...


def verdicts(rows: DataFrame, agent: str, patience_ms: int = 60_000) -> DataFrame:
    """Fetches and verdicts for a stream of URLs and answers (INPUT)."""
    return rows.groupBy("host").transformWithStateInPandas(RobotsCache(agent, patience_ms), OUTPUT, "append", "processingTime")
