"""The run history: replays, two writers, first creation, headlines, one import."""

import datetime as dt
import json

from pyspark.sql import functions as F

from bylines.sources.history import RUN, RunHistory, display_headline


def run(i, hour, status, created=None, **more):
    at = lambda h: dt.datetime(2026, 1, 1, h)
    row = {"run_id": i, "created_at": at(created if created is not None else hour), "updated_at": at(hour), "original_text": None, "original_url": None, "headline": None, "phase": "p", "status": status, "completed_layer": 1, "envelope": "{}"}
    return tuple((row | more)[c.split()[0]] for c in RUN.split(", "))


def test_replays_and_two_writers_leave_one_latest_row(spark, tmp_path):
    h = RunHistory(spark, f"file://{tmp_path}/h")
    assert h.latest().count() == 0
    first = spark.createDataFrame([run("a", 1, "running"), run("b", 1, "running"), run(None, 1, "x")], RUN)
    second = spark.createDataFrame([run("a", 3, "complete", created=2, headline="H")], RUN)
    rival = spark.createDataFrame([run("a", 2, "error"), run("b", 1, "error")], RUN)
    for df, name in ((first, "w1-1"), (second, "w1-2"), (rival, "w2-1"), (first, "w1-1"), (rival, "w2-1")):
        h.save(df, name)
    got = {r.run_id: (r.created_at.hour, r.updated_at.hour, r.status) for r in h.latest().collect()}
    assert got == {"a": (1, 3, "complete"), "b": (1, 1, "error")}
    assert [(r.run_id, r.headline) for r in h.listed().collect()] == [("a", "H"), ("b", "b")]


def test_headlines(spark):
    rows = [(" H ", "u", "t", "r"), (" ", " u" * 150, "t", "r"), (None, None, "x \n y" * 40, "r"), (None, "", " \n", "r"), (None, None, None, "r")]
    got = [r.h for r in spark.createDataFrame(rows, "h string, u string, t string, i string").select(display_headline(*[F.col(c) for c in "huti"]).alias("h")).collect()]
    assert got[0] == "H" and len(got[1]) == 200 and got[2] == (" ".join(("x \n y" * 40).split())[:80] + "…") and got[3:] == ["r", "r"]


def test_older_records_are_imported_once(spark, tmp_path):
    (tmp_path / "old").mkdir()
    for name, body in (("a", json.dumps({"envelope": {"run_id": "a", "created_at": "2026-01-01T05:00:00Z", "status": "complete", "completed_layer": 7}, "original_text": "T"}, indent=1)), ("b", "no json"), ("c", "{}"), ("d", '{"envelope": {"run_id": ""}}')):
        (tmp_path / "old" / f"{name}.json").write_text(body)
    h = RunHistory(spark, f"file://{tmp_path}/h")
    assert h.import_once(f"file://{tmp_path}/old")
    assert [(r.run_id, r.headline, r.completed_layer) for r in h.listed().collect()] == [("a", "T", 7)]
    h.save(spark.createDataFrame([run("a", 9, "error")], RUN).withColumn("updated_at", F.lit("2027-01-01").cast("timestamp")), "w1")
    assert not h.import_once(f"file://{tmp_path}/old") and h.latest().head().status == "error"
