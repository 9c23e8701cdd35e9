"""The frontier's state: the order of claims, what a claim costs, retries, and what is forgotten."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from weftline.operators import frontier
from weftline.streaming import politeness


class Value:
    def __init__(self, log):
        self.log, self.held = log, None

    def exists(self):
        return self.held is not None

    def get(self):
        self.log.append("get")
        return self.held

    def update(self, value):
        self.log.append("put")
        self.held = value


class Map(dict):
    def __init__(self, log):
        super().__init__()
        self.log = log

    def getValue(self, key):  # noqa: N802
        self.log.append("get")
        return self[key]

    def containsKey(self, key):  # noqa: N802
        self.log.append("get")
        return key in self

    def updateValue(self, key, value):  # noqa: N802
        self.log.append("put")
        self[key] = value

    def removeKey(self, key):  # noqa: N802
        self.log.append("put")
        del self[key]


class Host:
    """One host's state in memory, a clock that the test moves, and a log of what the state was asked."""

    def __init__(self, **how):
        self.log, self.timers, self.now = [], [], 0
        self.own = politeness.HostQueue(**how)
        self.own.init(self)

    def getMapState(self, name, key, value, ttl=None):  # noqa: N802
        return Map(self.log)

    def getValueState(self, name, kind):  # noqa: N802
        return Value(self.log)

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now

    def tell(self, *rows):
        frame = pd.DataFrame(rows, columns=["url", "priority", "kind"])
        return [r for out in self.own.handleInputRows(("h",), iter([frame]), self) for r in out.to_dict("records")]

    def ring(self):
        """The next timer: the clock moves there."""
        self.now = min(self.timers)
        self.timers = [t for t in self.timers if t > self.now]
        return [r for out in self.own.handleExpiredTimer(("h",), self, None) for r in out.to_dict("records")]


def test_a_hundred_thousand_urls_in_linear_time():
    """Every claim asks the state the same few times, and the order is that of the table operator."""
    rng, n = random.Random(15), 100_000
    rows = [(f"http://h/{i}", rng.choice([1.0, 0.5, 0.25, 0.125]), "found") for i in range(n)]
    host = Host(delay_ms=10)
    claims = host.tell(*rows)
    host.log.clear()
    costs = []
    while host.timers:
        before = len(host.log)
        claims += host.ring()
        costs.append(len(host.log) - before)
    assert len(claims) == n and max(costs) <= 8
    assert [(c["priority"], c["url"]) for c in claims] == sorted(((p, u) for u, p, _ in rows), key=lambda x: (-x[0], x[1]))
    assert all(b["claimed_at"] - a["claimed_at"] >= 10 for a, b in zip(claims, claims[1:]))
    assert not host.own.ready and not host.own.later


def test_order_is_that_of_the_table_operator(spark):
    """Random arrivals, failures and times: each claim is the one that frontier.claim makes of the same table."""
    rng = random.Random(16)
    host, table, clock = Host(delay_ms=5, most_retries=2), {}, 0
    for step in range(60):
        host.now = step * 7
        told = []
        for _ in range(rng.randint(0, 3)):
            url, priority = f"u{rng.randint(0, 40):02}", rng.choice([1.0, 0.5, 2.0])
            told.append((url, priority, "found"))
            table.setdefault(url, [priority, host.now, frontier.PENDING, 0])
        busy = [u for u, x in table.items() if x[2] == frontier.CLAIMED]
        if busy and rng.random() < 0.7:
            url = rng.choice(busy)
            told.append((url, table[url][0], rng.choice(["failed", "failed", "done"])))
            if told[-1][2] == "failed" and table[url][3] < 2:
                table[url][1:] = [host.now + 5 * 2 ** table[url][3], frontier.PENDING, table[url][3] + 1]
            else:
                table[url][2] = frontier.DONE
        due = sorted((-x[0], x[1], u) for u, x in table.items() if x[2] == frontier.PENDING and x[1] <= host.now)
        want = [due[0][2]] if due and clock <= host.now else []
        if step % 12 == 0:  # the plain list above is the table operator
            front = spark.createDataFrame([(u, "h", x[0], 0, x[3], x[1], x[2]) for u, x in table.items()] or [("-", "h", 0.0, 0, 0, 10**9, 3)], "url string, host string, priority double, depth int, retries int, next_at long, state int")
            clocks = spark.createDataFrame([("h", clock)], "host string, next_at long")
            assert [r["url"] for r in frontier.claim(front, clocks, host.now, 1).collect()] == want
        found = host.tell(*told)
        assert [c["url"] for c in found] == want
        for url in want:
            table[url][2], clock = frontier.CLAIMED, host.now + 5


def test_retries_and_settled_urls():
    host = Host(delay_ms=100, most_retries=1)
    assert [c["url"] for c in host.tell(("a", 1.0, "found"), ("a", 9.0, "found"), (None, 1.0, "found"), ("x", 1.0, "failed"))] == ["a"]
    host.now = 50
    assert host.tell(("a", 1.0, "failed")) == [] and host.timers[-1] == 150
    host.now = 149
    assert host.tell(("b", float("nan"), "found"))[0]["url"] == "b"  # the host may be asked, a isn't due
    assert [(c["url"], c["retries"]) for c in host.ring() + host.ring()] == [("a", 1)]
    host.now += 1000
    assert host.tell(("a", 1.0, "failed"), ("a", 1.0, "found")) == [] and not host.own.queue and not host.own.moments
    host.tell(("b", 0.0, "done"), ("b", 0.0, "failed"))
    assert host.own.seen[("b",)] == (0, True) and host.own.seen[("a",)] == (1, True)


@pytest.mark.parametrize("forget", [None, 60_000])
def test_seen_urls_can_expire(forget):
    asked = []

    class Handle(Host):
        def getMapState(self, name, key, value, ttl=None):  # noqa: N802
            asked.append((name, ttl))
            return super().getMapState(name, key, value)

    Handle(forget_ms=forget)
    assert asked == [("seen", forget), ("ready", None), ("later", None)]
