"""The crawl frontier as a stateful stream: one URL of a host at a time, the next when the host's delay is over.

A host's pending URLs are kept in order, so a claim reads one of them, however many there are. URLs that are due stand in queues, one for each
priority, in the order in which they became due; the queues' ends are one small value, as a crawl has few priorities (links halve
them a step). URLs that wait for another try stand in buckets by the moment they are due, and join their queue then, before anything that comes later.
So the order of claims is that of `operators.frontier.claim`: priority, then due time, then URL; URLs that come at one moment in several batches go by batch.

State: what was seen, with its retries and whether it is settled; the queues; the buckets; and when the host may be asked again. What was
seen can expire (`forget_ms` after it was last touched): a URL may then be found again, never lost before it was claimed.

Edge cases: a URL found again while it is known changes nothing; outcomes of unknown URLs are passed over; a null priority counts as 0; a settled URL
that fails stays settled; rows without a URL are passed over. Rows of a null host are one host.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "host string, url string, priority double, claimed_at long, retries int"


class HostQueue(StatefulProcessor):
    """Keyed by host. In: url, priority, kind (found, failed or done). Out: claims.

    A claim sets the clock; a timer takes the next URL when it rings. Failed URLs return after delay * 2^retries.
    """

    def __init__(self, delay_ms: int = 1000, most_retries: int = 2, forget_ms: int | None = None):
        self.delay, self.most, self.forget = delay_ms, most_retries, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "url string", "retries int, settled boolean", self.forget)
        self.ready = handle.getMapState("ready", "level string, place long", "url string, retries int")
        self.ends = handle.getValueState("ends", "level array<double>, head array<long>, tail array<long>")
        self.later = handle.getMapState("later", "due long, place long", "url string, priority double, retries int")
        self.dues = handle.getValueState("dues", "due array<long>, n array<long>")
        self.clock = handle.getValueState("clock", "next_at long")

    def _load(self) -> None:
        """The queues' ends by priority, and the buckets' sizes by due time, in order."""
        level, head, tail = self.ends.get() if self.ends.exists() else ([], [], [])
        self.queue = {p: [a, b] for p, a, b in zip(level, head, tail, strict=True)}
        due, n = self.dues.get() if self.dues.exists() else ([], [])
        self.bucket = dict(zip(due, n, strict=True))
        self.moments = list(due)

    def _save(self) -> None:
        self.ends.update((list(self.queue), [a for a, _ in self.queue.values()], [b for _, b in self.queue.values()]))
        self.dues.update((self.moments, [self.bucket[d] for d in self.moments]))

    def _queue(self, priority: float, url: str, retries: int) -> None:
        ends = self.queue.setdefault(priority, [0, 0])
        self.ready.updateValue((repr(priority), ends[1]), (url, retries))
        ends[1] += 1

    def _wait(self, due: int, url: str, priority: float, retries: int) -> None:
        if due not in self.bucket:
            insort(self.moments, due)
        place = self.bucket.get(due, 0)
        self.later.updateValue((due, place), (url, priority, retries))
        self.bucket[due] = place + 1

    def _due(self, now: int) -> list[tuple[int, str, float, int]]:
        """What was waiting for a moment that has come, taken out."""
        found = []
        while self.moments and self.moments[0] <= now:
            due = self.moments.pop(0)
            for place in range(self.bucket.pop(due)):
                url, priority, retries = self.later.getValue((due, place))
                self.later.removeKey((due, place))
                found.append((due, url, priority, retries))
        return found

    def _claim(self, host: str, now: int) -> Iterator[pd.DataFrame]:
        """The first of the best queue, if the host may be asked; else, and for the next one, a timer for the first moment that one may."""
        next_at = self.clock.get()[0] if self.clock.exists() else 0
        if self.queue and next_at <= now:
            priority = max(self.queue)
            ends = self.queue[priority]
            url, retries = self.ready.getValue((repr(priority), ends[0]))
            self.ready.removeKey((repr(priority), ends[0]))
            ends[0] += 1
            if ends[0] == ends[1]:
                del self.queue[priority]
            next_at = now + self.delay
            self.clock.update((next_at,))
            yield pd.DataFrame({"host": [host], "url": [url], "priority": [priority], "claimed_at": [now], "retries": [retries]})
        if self.queue or self.moments:
            self.handle.registerTimer(max(next_at, now if self.queue else self.moments[0], now + 1))

    def _turn(self, host: str, now: int, fresh: list[tuple[int, str, float, int]]) -> Iterator[pd.DataFrame]:
        for _, url, priority, retries in sorted(self._due(now) + fresh):
            self._queue(priority, url, retries)
        yield from self._claim(host, now)
        self._save()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, fresh = timerValues.getCurrentProcessingTimeInMs(), []
        self._load()
        for frame in rows:
            for url, given, kind in zip(frame["url"], frame["priority"], frame["kind"], strict=True):
                if not isinstance(url, str):
                    continue
                priority = 0.0 if given is None or given != given else float(given)
                known = self.seen.getValue((url,)) if self.seen.containsKey((url,)) else None
                if kind == "found" and known is None:
                    self.seen.updateValue((url,), (0, False))
                    fresh.append((now, url, priority, 0))
                elif kind == "done" and known:
                    self.seen.updateValue((url,), (known[0], True))
                elif kind == "failed" and known and not known[1]:
                    again = known[0] < self.most
                    self.seen.updateValue((url,), (known[0] + again, not again))
                    if again:
                        self._wait(now + self.delay * 2 ** known[0], url, priority, known[0] + 1)
        yield from self._turn(key[0], now, fresh)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        yield from self._turn(key[0], timerValues.getCurrentProcessingTimeInMs(), [])

    def close(self) -> None: ...


def schedule(updates: DataFrame, delay_ms: int = 1000, most_retries: int = 2, forget_ms: int | None = None) -> DataFrame:
    """Claims for a stream of updates (host, url, priority, kind)."""
    return updates.groupBy("host").transformWithStateInPandas(HostQueue(delay_ms, most_retries, forget_ms), OUTPUT, "append", "processingTime")
