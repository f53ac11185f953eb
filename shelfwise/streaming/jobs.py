"""Worker queues as a stream with state: jobs, their cards and their last events.

One key is one queue, which works on one job at a time. Its state holds the jobs in a map (status, place, times),
their cards in a map by job and address, and each job's last EVENTS events in a list. A timer requeues a job that has said nothing
for STALL_MS; with processing time, cards and events of a queue that is silent for a while may be given a time to live.

Events (columns of EVENT): submit; poll (a worker asks: it is given the running job, else
the first queued one); progress (an event, perhaps with a card); complete, fail, abort. What comes for a job after its end, or for a job
that is not known, is ignored. Later fields of a card win if they are not null or empty.

The same fold runs over a batch: all rows of a queue come at once, and stalls show at the next event.
A trigger reads a queue's jobs once and writes what changed once, so its time grows with its rows and the queue's jobs, not with their product.
Rows are put in order by `ord` within a micro-batch, so a trigger's rows of one queue are held together.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

STALL_MS, EVENTS = 180_000, 2000
EVENT = "queue string, ord long, at timestamp, kind string, job_id long, url string, name string, image string, price double, error string"
CHANGE = "queue string, job_id long, seq long, ord long, status string, reason string, events long, cards long"
FIELDS = ("name", "image", "price", "error")
OPEN = ("queued", "running")
#: What an event makes of an open job.
ENDS = {"progress": "running", "complete": "complete", "fail": "failed", "abort": "aborted"}


class Job(NamedTuple):
    """What is kept of a job: its place in the queue, when it last said something (ms), how many events, cards and changes of status it has."""

    status: str
    place: int
    touched: int
    events: int = 0
    cards: int = 0
    changes: int = 0


JOB = "status string, place long, touched long, events long, cards long, changes long"


class Queue(StatefulProcessor):
    """State and fold of one queue. ttl_ms: how long cards and events are kept after they were last written (processing time only)."""

    def __init__(self, stall_ms: int = STALL_MS, events: int = EVENTS, ttl_ms: int | None = None) -> None:
        self.stall_ms, self.most, self.ttl_ms = stall_ms, events, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "job_id long", JOB)
        self.cards = handle.getMapState("cards", "job_id long, url string", "name string, image string, price double, error string", self.ttl_ms)
        self.tail = handle.getMapState("tail", "job_id long, slot long", "ord long, kind string, url string", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        batch = pd.concat(list(rows)).sort_values("ord", kind="stable")
        self.load()
        for e in batch.itertuples(index=False):
            self.take(e, out)
        self.save()
        self.set_timers()
        yield self.changes(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        self.load()
        self.requeue(expiredTimerInfo.getExpiryTimeInMs(), -1, out)
        self.save()
        yield self.changes(key, out)

    def close(self) -> None:
        pass

    def changes(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *x) for x in out], columns=[c.split()[0] for c in CHANGE.split(", ")])

    def load(self) -> None:
        """The queue's jobs for one trigger: those that wait by their place, those that run by when they last said something."""
        self.held: dict[int, Job] = {}
        self.waiting: list[tuple[int, int]] = []
        self.silent: list[tuple[int, int]] = []
        self.running: set[int] = set()
        self.written: set[int] = set()
        self.born: set[int] = set()
        self.seen: dict[tuple[int, str], tuple | None] = {}
        self.merged: set[tuple[int, str]] = set()
        for k, v in self.jobs.iterator():
            self.put(int(k[0]), Job(*v))
        self.written.clear()

    def save(self) -> None:
        """What the trigger changed, each job and card once."""
        for id_ in self.written:
            self.jobs.updateValue((id_,), tuple(self.held[id_]))
        for key in self.merged:
            self.cards.updateValue(key, self.seen[key])

    def put(self, id_: int, job: Job) -> None:
        self.held[id_] = job
        self.written.add(id_)
        if job.status == "queued":
            heappush(self.waiting, (job.place, id_))
        if job.status == "running":
            self.running.add(id_)
            heappush(self.silent, (job.touched, id_))
        else:
            self.running.discard(id_)

    def card(self, key: tuple[int, str]) -> tuple | None:
        """A job's card, null if it has none; a job of this trigger has none before."""
        if key not in self.seen:
            self.seen[key] = self.cards.getValue(key) if key[0] not in self.born and self.cards.containsKey(key) else None
        return self.seen[key]

    def change(self, id_: int, job: Job, status: str, reason: str, ord_: int, out: list[tuple]) -> None:
        new = job._replace(status=status, changes=job.changes + 1)
        self.put(id_, new)
        out.append((id_, new.changes, ord_, status, reason, new.events, new.cards))

    def requeue(self, now: int, ord_: int, out: list[tuple]) -> None:
        """Running jobs that have said nothing for stall_ms are queued again."""
        stalled = set()
        while self.silent and now - self.silent[0][0] > self.stall_ms:
            touched, id_ = heappop(self.silent)
            # a job that has said something since has a later entry
            if id_ in self.running and self.held[id_].touched == touched:
                stalled.add(id_)
        for id_ in sorted(stalled, key=lambda i: (self.held[i].place, i)):
            self.change(id_, self.held[id_], "queued", "stalled", ord_, out)

    def set_timers(self) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        for at in {self.held[id_].touched + self.stall_ms + 1 for id_ in self.running}:
            self.handle.registerTimer(at)

    def take(self, e, out: list[tuple]) -> None:
        now = int(pd.Timestamp(e.at).value // 1_000_000)
        self.requeue(now, e.ord, out)
        if e.kind == "poll":
            while self.waiting and not self.running:
                _, id_ = heappop(self.waiting)
                if self.held[id_].status == "queued":
                    self.change(id_, self.held[id_]._replace(touched=now), "running", "claimed", e.ord, out)
            return
        if pd.isna(e.job_id):
            return
        id_ = int(e.job_id)
        job = self.held.get(id_)
        if e.kind == "submit":
            if job is None:
                self.born.add(id_)
                self.change(id_, Job("", e.ord, now), "queued", "submitted", e.ord, out)
            return
        if job is None or job.status not in OPEN or e.kind not in ENDS:
            return
        # the tail is a ring: the event before the last EVENTS ones is written over
        self.tail.updateValue((id_, job.events % self.most), (e.ord, e.kind, None if pd.isna(e.url) else e.url))
        job = job._replace(touched=now, events=job.events + 1, cards=job.cards + self.merge(id_, e))
        if ENDS[e.kind] != job.status:
            self.change(id_, job, ENDS[e.kind], e.kind, e.ord, out)
        else:
            self.put(id_, job)

    def merge(self, job: int, e) -> int:
        """Puts an event's card to the job's; how many cards are new."""
        if not isinstance(e.url, str) or not e.url:
            return 0
        key = (job, e.url)
        have = self.card(key)
        said = [getattr(e, f) for f in FIELDS]
        new = tuple(old if pd.isna(x) or x == "" else x for x, old in zip(said, have or (None,) * len(FIELDS), strict=True))
        self.seen[key] = new
        self.merged.add(key)
        return have is None


class QueueCards(Queue):
    """The same fold, which tells every card as it stands after a trigger that touched it."""

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        touched: dict[tuple[int, str], None] = {}
        batch = pd.concat(list(rows)).sort_values("ord", kind="stable")
        self.load()
        for e in batch.itertuples(index=False):
            self.take(e, [])
            if isinstance(e.url, str) and not pd.isna(e.job_id) and self.card((int(e.job_id), e.url)) is not None:
                touched[int(e.job_id), e.url] = None
        self.save()
        self.set_timers()
        yield pd.DataFrame([(key[0], job, url, *self.seen[job, url], int(batch["ord"].max())) for job, url in touched], columns=[c.split()[0] for c in CARD.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.load()
        self.requeue(expiredTimerInfo.getExpiryTimeInMs(), -1, [])
        self.save()
        yield pd.DataFrame([], columns=[c.split()[0] for c in CARD.split(", ")])


CARD = "queue string, job_id long, url string, name string, image string, price double, error string, upto long"


STORE = "spark.sql.streaming.stateStore.providerClass"


def _folded(events: DataFrame, processor: StatefulProcessor, schema: str, time_mode: str, late: str) -> DataFrame:
    rows = events.select(*[c.split()[0] for c in EVENT.split(", ")])
    spark = events.sparkSession
    # maps and timers need the store that keeps them on disk; a batch needs what the manager of streams starts
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    _ = spark.streams.active
    timed = rows.withWatermark("at", late) if time_mode == "EventTime" else rows
    return timed.groupBy("queue").transformWithStateInPandas(processor, StructType.fromDDL(schema), "Append", time_mode)


def queue_changes(events: DataFrame, stall_ms: int = STALL_MS, time_mode: str = "EventTime", late: str = "0 seconds", ttl_ms: int | None = None, tail: int = EVENTS) -> DataFrame:
    """Every change of a job's status: queue, job_id, seq (from 1), ord (of the event, -1 for a timer), status, reason, and how many events and cards it has."""
    return _folded(events, Queue(stall_ms, tail, ttl_ms), CHANGE, time_mode, late)


def queue_cards(events: DataFrame, stall_ms: int = STALL_MS, time_mode: str = "EventTime", late: str = "0 seconds", ttl_ms: int | None = None) -> DataFrame:
    """Every card as it stands after each trigger that touched it; the row of the greatest upto is the last."""
    return _folded(events, QueueCards(stall_ms, ttl_ms=ttl_ms), CARD, time_mode, late)


def latest_status(changes: DataFrame) -> DataFrame:
    """The last change of each job."""
    last = F.max_by(F.struct("status", "events", "cards"), "seq").alias("last")
    return changes.groupBy("queue", "job_id").agg(last).select("queue", "job_id", "last.*")
