"""Analyst answers: rejects, dropped ids, slots, stances by order."""

import json

from bylines.operators.analyst import attach_stances, participated, take_in

GOOD = {"claims": [
    {"claim_id": "c1", "supported_by": ["s1", "ghost", "", None], "contradicted_by": ["s2"], "unrelated": ["s1", "s3"], "inconsistencies": [{"slot": "date", "summary": "x", "source_ids": ["s1", "ghost"]}, {"slot": "odd", "source_ids": None}, "no"], "missing_slots": ["who"]},
    "text", 7, None,
    {"claim_id": "c2", "supported_by": ["gone"]},
    {"claim_id": "c1", "supported_by": ["s2"], "unrelated": ["s2"]},
    {"claim_id": 3, "contradicted_by": ["s3"], "supported_by": ["s3"]},
]}


def test_rows_rejects_and_stances(spark):
    outputs = spark.createDataFrame([(1, json.dumps(GOOD)), (2, "no json"), (3, '{"claims": "x"}'), (4, None), (5, '{"claims": []}'), (6, '{"claims": [{"claim_id": "c1", "supported_by": ["s1"]}]}')], "run_id long, payload string")
    shown = spark.createDataFrame([(1, "s1"), (1, "s2"), (1, "s3"), (2, "s1")], "run_id long, source_id string")
    rows, rejects = take_in(outputs, shown)
    got = {(r.run_id, r.pos): r for r in rows.collect()}
    assert sorted(got) == [(1, 0), (1, 4), (1, 5), (1, 6), (6, 0)]
    first = got[1, 0]
    assert (first.supported_by, first.contradicted_by, first.unrelated, first.dropped_ids, first.dropped, first.missing_slots) == (["s1"], ["s2"], ["s1", "s3"], ["ghost"], 2, ["who"])
    assert [tuple(i) for i in first.inconsistencies] == [("date", "x", ["s1"]), ("other", "", [])]
    assert got[1, 4].dropped_ids == ["gone"] and got[1, 6].claim_id == "3" and got[6, 0].dropped == 1
    assert sorted((r.run_id, r.pos, r.reason) for r in rejects.collect()) == [(1, 1, "no object"), (1, 2, "no object"), (1, 3, "no object"), (2, -1, "no list of claims"), (3, -1, "no list of claims"), (4, -1, "no list of claims")]
    assert {(r.run_id, r.pos) for r in participated(rows).collect()} == {(1, 0), (1, 5), (1, 6)}
    pairs = spark.createDataFrame([(1, c, f"s{i}") for c in ("c1", "c2", "3") for i in (1, 2, 3)], "run_id long, claim_id string, source_id string")
    out = {(r.claim_id, r.source_id): r.analyst_stance for r in attach_stances(pairs, rows).collect()}
    assert out == {("c1", "s1"): "supports", ("c1", "s2"): "supports", ("c1", "s3"): "unrelated", ("c2", "s1"): None, ("c2", "s2"): None, ("c2", "s3"): None, ("3", "s1"): None, ("3", "s2"): None, ("3", "s3"): "refutes"}
