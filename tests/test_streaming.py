import datetime as dt
import random

from pyspark.sql import functions as F

from shelfwise.streaming import events as E


def land(spark, tmp_path, files=3):
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=7 * i + rng.randrange(5)), i % 6, rng.choice(["view", "click", "purchase"]) if i % 11 == 0 else rng.choice(["view", "click"]), float(i), "{}") for i in range(240)]
    for k in range(files):
        spark.createDataFrame(rows[k::files] if files == 1 else rows[80 * k : 80 * (k + 1)], E.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.read.schema(E.SCHEMA).parquet(f"{tmp_path}/in")


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_windows_sessions_and_cards_match_their_batch_twins(spark, tmp_path):
    batch, stream = land(spark, tmp_path), E.read_events(spark, f"{tmp_path}/in")
    for name, f in (("w", E.windowed), ("s", lambda d: E.windowed(d, "2 hours", "1 hour"))):
        assert sorted(map(tuple, drain(f(stream), name, "complete").collect())) == sorted(map(tuple, f(batch).collect()))
    assert sorted(map(tuple, drain(E.cards(stream), "cards", "complete").collect())) == sorted(map(tuple, E.cards(batch).collect()))


def test_repeated_events_come_once(spark, tmp_path):
    batch = land(spark, tmp_path)
    batch.where("event_id < 50").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = drain(E.first_seen(E.read_events(spark, f"{tmp_path}/in", 10)), "once", "append")
    assert got.count() == 240 and got.select("event_id").distinct().count() == 240


def test_job_states(spark, tmp_path):
    batch = land(spark, tmp_path)
    changes = drain(E.job_states(E.read_events(spark, f"{tmp_path}/in", 10)), "jobs", "update")
    last = changes.groupBy("user_id").agg(F.max_by("status", "n").alias("status"), F.max("n").alias("n"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, E.job_states_batch(batch).collect()))


def test_observation_log(spark, tmp_path):
    batch = land(spark, tmp_path)
    for _ in range(2):  # the second run finds nothing new
        E.append_observations(E.read_events(spark, f"{tmp_path}/in"), f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/log").count() == batch.count()
