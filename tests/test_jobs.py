"""Job queues with state against a plain loop, restarts, timers, and re-checks that are written once."""

import datetime as dt
import random
import shutil

from pyspark.sql import functions as F

from shelfwise.plans import serving
from shelfwise.plans.markup import VISIT_CASES
from shelfwise.streaming import jobs as J
from shelfwise.streaming import recheck as R

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def history(seed, n):
    rng = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += rng.choice([1, 5, 20, 20, 60, 200])
        kind = rng.choice(["submit", "poll", "poll", *["progress"] * 6, "complete", "fail", "abort", "odd"])
        job = None if kind == "poll" else rng.randrange(1, 7)
        url = rng.choice([None, "", "u1", "u2", "u3"]) if kind == "progress" else None
        rows.append((rng.choice(["a", "b"]), i, START + dt.timedelta(seconds=at), kind, job, url, rng.choice([None, "", f"n{i}"]), rng.choice([None, f"i{i}"]), rng.choice([None, float(i)]), None))
    return rows


def loop(rows, stall=180):
    """Statuses, events and cards of every job, event by event."""
    jobs, cards = {}, {}
    for queue, ord_, at, kind, job, url, *fields in sorted(rows, key=lambda r: r[1]):
        mine = {k: v for k, v in jobs.items() if k[0] == queue}
        for v in mine.values():
            if v["status"] == "running" and (at - v["at"]).total_seconds() > stall:
                v["status"] = "queued"
        if kind == "poll":
            if not any(v["status"] == "running" for v in mine.values()):
                waiting = sorted((v["place"], k) for k, v in mine.items() if v["status"] == "queued")
                if waiting:
                    jobs[waiting[0][1]].update(status="running", at=at)
            continue
        v = jobs.get((queue, job))
        if kind == "submit" and v is None:
            jobs[queue, job] = {"status": "queued", "place": ord_, "at": at, "events": 0, "cards": 0}
        elif v and v["status"] in ("queued", "running") and kind in J.ENDS:
            v.update(at=at, events=v["events"] + 1, status=J.ENDS[kind])
            if url:
                key = (queue, job, url)
                v["cards"] += key not in cards
                cards[key] = [old if new in (None, "") else new for new, old in zip(fields, cards.get(key, [None] * 4), strict=True)]
    return {(*k, v["status"], v["events"], v["cards"]) for k, v in jobs.items()}, {(*k, *v) for k, v in cards.items()}


def land(spark, rows, folder, files):
    for k in range(files):
        part = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
        spark.createDataFrame(part, J.EVENT).coalesce(1).write.mode("append").parquet(folder)


def drain(df, folder, checkpoint):
    q = df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return df.sparkSession.read.parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(J.EVENT).option("maxFilesPerTrigger", 1).parquet(folder)


def test_queues_restarted_and_as_a_batch(spark, tmp_path):
    rows = history(3, 260)
    want, cards = loop(rows)
    assert {s for _, _, s, _, _ in want} >= {"complete", "failed", "aborted"} and len(cards) > 5
    land(spark, rows[:150], f"{tmp_path}/in", 2)
    drain(J.queue_changes(stream(spark, f"{tmp_path}/in"), late="1 hour"), f"{tmp_path}/out", f"{tmp_path}/cp")
    land(spark, rows[150:], f"{tmp_path}/in", 2)
    out = drain(J.queue_changes(stream(spark, f"{tmp_path}/in"), late="1 hour"), f"{tmp_path}/out", f"{tmp_path}/cp")  # goes on from the checkpoint
    assert set(map(tuple, J.latest_status(out).select("queue", "job_id", "status").collect())) == {x[:3] for x in want}
    running = {}
    for r in out.orderBy("queue", "ord", "seq").collect():  # never two at a time, but for progress of a job that was not claimed
        running.setdefault(r.queue, set())
        (running[r.queue].add if r.status == "running" else running[r.queue].discard)(r.job_id)
        assert r.reason != "claimed" or running[r.queue] == {r.job_id}
    batch = spark.createDataFrame(rows, J.EVENT).repartition(3)
    whole = J.queue_changes(batch)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, out.select(whole.columns).collect()))
    got = {tuple(r)[:7] for r in J.queue_cards(batch).collect()}
    assert got == {c[:7] for c in cards}


def test_a_stalled_job_is_queued_by_a_timer(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    event = lambda q, i, s, kind, job=None: (q, i, at(s), kind, job, None, None, None, None, None)
    land(spark, [event("a", 0, 0, "submit", 1), event("a", 1, 1, "poll"), event("b", 2, 1, "submit", 9)], f"{tmp_path}/in", 1)
    land(spark, [event("b", 3, 400, "submit", 8)], f"{tmp_path}/in", 1)  # nothing of queue a, but time goes on
    land(spark, [event("b", 4, 401, "poll")], f"{tmp_path}/in", 1)
    out = drain(J.queue_changes(stream(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert [(r.status, r.reason, r.ord) for r in out.where("queue = 'a'").orderBy("seq").collect()] == [("queued", "submitted", 0), ("running", "claimed", 1), ("queued", "stalled", -1)]


def test_rechecks_are_written_once(spark, tmp_path):
    visits = spark.createDataFrame([(f"u{i}", *c[:3]) for i, c in enumerate(VISIT_CASES)], "url string, http int, html string, rendered boolean")
    schema = "url string, at timestamp"
    for k in range(3):
        spark.createDataFrame([(f"u{i}", START + dt.timedelta(hours=k)) for i in range(k, 20, 3)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    requests = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = lambda: R.write_batches(R.answers(requests, visits), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    run()
    once = sorted(map(tuple, R.read_results(spark, f"{tmp_path}/out").collect()))
    assert {r[0]: (r[2], r[4]) for r in once} == {f"u{i}": c[3:5] for i, c in enumerate(VISIT_CASES)} | {f"u{i}": ("unknown", "not-visited") for i in range(len(VISIT_CASES), 20)}
    run()  # nothing new
    shutil.move(f"{tmp_path}/cp/commits/2", f"{tmp_path}/gone")  # the last batch was written, but not committed
    for crc in (tmp_path / "cp/commits").glob(".2.crc"):
        crc.unlink()
    run()
    assert sorted(map(tuple, R.read_results(spark, f"{tmp_path}/out").collect())) == once
    offers = spark.createDataFrame([("u0", 1, "out_of_stock"), ("u7", 2, "in_stock"), ("u9", 3, "in_stock"), ("other", 4, "preorder")], "url string, ord int, stock string")
    got = {r.url: (r.stock, r.checked) for r in R.refreshed(offers, R.read_results(spark, f"{tmp_path}/out")).collect()}
    assert got == {"u0": ("in_stock", True), "u7": ("out_of_stock", True), "u9": ("in_stock", True), "other": ("preorder", False)}


def test_the_stalest_come_first(spark):
    rows = spark.createDataFrame([("a", 1, None), ("b", 2, START), ("c", 3, START + dt.timedelta(hours=20)), ("d", 4, START - dt.timedelta(hours=5))], "url string, ord int, t timestamp")
    now = F.lit(START + dt.timedelta(hours=24))
    assert [r.url for r in R.stale_first(rows, "t", now, 12, 3).collect()] == ["a", "d", "b"]


def test_the_query_against_the_loop(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in serving.queue_events(spark, sf).select(*[c.split()[0] for c in J.EVENT.split(", ")]).collect()]
    rows = [(*r[:2], r[2].replace(tzinfo=dt.timezone.utc), *r[3:]) for r in rows]
    want, cards = loop(rows)
    assert set(map(tuple, serving.queue_jobs(spark, sf).collect())) == want and len(want) > 5
    assert {tuple(r) for r in serving.queue_cards(spark, sf).collect()} == {c[:6] for c in cards}
