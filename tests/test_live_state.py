"""Live run state: order within and across batches, quiet layers, late signs of life, restarts."""

import datetime as dt
import random

from bylines.streaming.runs import drive, latest, live_states

SCHEMA = "run_id long, ts timestamp, event_id long, layer string, status string"


def at(hour, minute=0):
    return dt.datetime(2026, 1, 1, hour, minute)


def states(spark, tmp_path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    drive(live_states(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    return {r.run_id: tuple(r)[1:] for r in latest(spark, f"{tmp_path}/out").collect()}


def send(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")


def test_quiet_layers_become_errors_and_may_come_back(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    send(spark, tmp_path, [(1, at(8), 1, "input", "running"), (1, at(8, 5), 2, "input", "ok"), (1, at(8, 6), 3, "evidence", "running"), (2, at(8, 1), 5, "input", "ok"), (2, at(8, 1), 4, "input", "error"), (None, at(8), 9, "x", "ok")])
    first = states(spark, tmp_path)
    assert first == {1: ("evidence", "running", 3, 0, False), 2: ("input", "ok", 2, 1, False)}
    send(spark, tmp_path, [(3, at(12), 7, "input", "running")])  # the clock moves on; run 1 has been quiet
    again = states(spark, tmp_path)  # a new query on the same checkpoint
    assert again[1] == ("evidence", "error", 3, 0, True) and again[2] == first[2] and again[3] == ("input", "running", 1, 0, False)
    send(spark, tmp_path, [(1, at(12, 1), 8, "evidence", "ok"), (3, at(11, 30), 6, "input", "error")])  # late, but within the delay
    last = states(spark, tmp_path)
    assert last[1] == ("evidence", "ok", 4, 0, False) and last[3] == ("input", "running", 2, 1, False)


def test_runs_of_a_bucket_each_keep_their_own_state(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    r, sent, start = random.Random(3), [], at(8)
    for part in range(4):
        rows = [(run, start + dt.timedelta(minutes=90 * part + r.randrange(60)), 1000 * part + i, r.choice("ab"), r.choice(["running", "ok", "error"])) for i in range(40) for run in [r.randrange(20 + part)]]
        sent += rows
        send(spark, tmp_path, rows)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    drive(live_states(stream, buckets=3), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    clock, want = max(e[1] for e in sent) - dt.timedelta(hours=1), {}
    for run in {e[0] for e in sent}:
        own = sorted((e for e in sent if e[0] == run), key=lambda e: e[1:3])
        stale = own[-1][4] == "running" and own[-1][1] + dt.timedelta(hours=1) < clock
        want[run] = (own[-1][3], "error" if stale else own[-1][4], len(own), sum(e[4] == "error" for e in own), stale)
    assert {x.run_id: tuple(x)[1:] for x in latest(spark, f"{tmp_path}/out").collect()} == want and {w[4] for w in want.values()} == {True, False}
