"""How often a trigger reads and writes the state of a queue."""

from collections import Counter

import pandas as pd

from shelfwise.streaming.jobs import Queue


class Map:
    def __init__(self, calls):
        self.calls, self.held = calls, {}

    def iterator(self):
        self.calls["iterator"] += 1
        return iter(list(self.held.items()))

    def containsKey(self, key):
        self.calls["read"] += 1
        return key in self.held

    def getValue(self, key):
        self.calls["read"] += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.held[key] = value


class Handle:
    def __init__(self):
        self.calls = Counter()

    def getMapState(self, *_):
        return Map(self.calls)

    def listTimers(self):
        return iter([])

    def registerTimer(self, at):
        pass


def test_a_trigger_reads_its_jobs_once():
    queue, handle = Queue(), Handle()
    queue.init(handle)
    at = pd.Timestamp("2024-01-01")
    rows = [("q", i, at + pd.Timedelta(seconds=i), "submit" if i < 100 else "poll" if i % 5 == 0 else "progress", None if i >= 100 and i % 5 == 0 else i % 100, f"u{i}", "n", None, 1.0, None) for i in range(600)]
    events = pd.DataFrame(rows, columns="queue ord at kind job_id url name image price error".split())
    out = pd.concat(queue.handleInputRows(("q",), iter([events]), None))
    assert len(out) >= 100
    assert handle.calls["iterator"] == 1 and handle.calls["read"] == 0
