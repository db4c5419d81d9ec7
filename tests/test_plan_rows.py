"""A document's query plan is made within its row, however long its runs of capitalised words are."""

import random
import re

from pyspark.sql import functions as F

from bylines.operators import claims as C
from bylines.operators.plan import plans, query_plan
from bylines.plans.oracles import ORACLE_SQL
from bylines.plans.queries import QUERIES
from bylines.schemas import NUMERIC, NUMERIC_BY_LETTER
from tests.compare import connection, differ


def documents(spark, tmp_path, texts):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_a_long_run_of_names_does_not_take_the_stack(spark, tmp_path):
    d = documents(spark, tmp_path, ["Rachel Vance said on Monday that Rachel Vance left the town.", "Abcde Fghij " * 20_000, None, "", "A line of small words that is long enough for one claim"])
    for name in ("query_plan", "heuristic_entities"):
        assert differ(QUERIES[name](spark, d), connection(d), ORACLE_SQL[name]) == ""


def test_plans_move_words_only(spark):
    """Neither texts nor sentences are shuffled, sorted by documents or written."""
    df = QUERIES["query_plan"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Window", "Sort", "Join"))


def test_best_claims_are_those_selected(spark):
    r = random.Random(4)
    rows = [(i, f"c{p + 1}", p, r.choice(["a?", "b.", "c 1.", "d"]) + f" {p}" * r.randrange(2)) for i in range(30) for p in range(r.randrange(1, 15))]
    df = spark.createDataFrame(rows, "run_id long, claim_id string, pos int, claim string")
    score = lambda c: F.when(c.endswith("?"), -1).when(c.rlike("[0-9]"), 2).otherwise(F.length(c) % 2)
    want = C.select_claims(df.withColumn("score", score(F.col("claim")))).where("selected").select("run_id", "rank", "claim_id", "claim")
    arrays = df.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("pos", "claim_id", "claim"))).alias("s")).select("run_id", F.transform("s", lambda x: F.struct(x["claim_id"], x["pos"], x["claim"])).alias("s"))
    got = arrays.select("run_id", F.inline(C.best_claims(F.col("s"), score))).select("run_id", "pos", "claim_id", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_plans_of_rows_are_those_of_tables(spark):
    r = random.Random(8)
    runs = [(i, r.choice([None, "the Plan of Cornwall", "x"]), "2026-09-01", None, r.choice(["high", "weak"])) for i in range(40)]
    claims = [(i, p, r.choice([None, "", "c1", "c1_2", "c2"]), r.choice([None, "Ann Lee resigned in 2026", "nothing"])) for i in range(40) for p in range(r.randrange(5))]
    names = [(i, p, r.choice(["Ann Lee", "ANN lee ", "March", " ", "Cornwall"]), r.choice(["PERSON", "DATE", "GPE"])) for i in range(40) for p in range(r.randrange(8))]
    runs = spark.createDataFrame(runs, "run_id long, headline string, date_start string, date_end string, confidence string")
    claims = spark.createDataFrame(claims, "run_id long, pos int, claim_id string, text string")
    names = spark.createDataFrame(names, "run_id long, pos int, text string, type string")
    got = query_plan(runs, claims, names, ["the"]).orderBy("run_id", "pos").collect()
    ids = {}
    for g in got:
        ids.setdefault(g.run_id, []).append(g.query_id)
    assert all(len(set(x)) == len(x) for x in ids.values())
    c = claims.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("pos", "claim_id", "text"))).alias("c"))
    e = names.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "type"))).alias("e"))
    assert plans(runs.join(c, "run_id", "left").join(e, "run_id", "left"), ["the"]).orderBy("run_id", "pos").collect() == got
    first = {}
    for n in names.orderBy("run_id", "pos").collect():
        if n.type != "DATE" and n.text.strip():
            first.setdefault(n.run_id, {}).setdefault(n.text.strip().lower(), n.text.strip())
    of = {}
    for g in got:
        if g.kind == "entity":
            of.setdefault(g.run_id, []).append(g.query_text)
    assert of == {i: list(x.values()) for i, x in first.items()}


def test_numbers_by_their_first_letters():
    words = re.findall("[a-z]{3,}", NUMERIC) + ["per cent", "per\n cent", "a 1", "xjan", "Janu", "may_", "é may", "MAY", "mays", "ten-year", "", "cent", "per", "é"]
    assert [bool(re.search(NUMERIC, w)) for w in words] == [bool(re.search(NUMERIC_BY_LETTER, w)) for w in words]
    assert sum(bool(re.search(NUMERIC, w)) for w in words) > 60


def test_all_names_are_searched(spark, tmp_path):
    """A text with 80 names: each has its search, and a claim's query holds a name however late it first stands."""
    names = [f"{'Ann' if i % 2 else 'Bob Carl'} {chr(65 + i % 26)}{chr(97 + i // 26)}lo" for i in range(80)]
    d = documents(spark, tmp_path, ["names of the day\n" + " met ".join(names) + ", it seems, and went home. Nobody was found in 2026 but Ann Zblo, they say again.", "nothing here"])
    got = QUERIES["query_plan"](spark, d)
    assert differ(got, connection(d), ORACLE_SQL["query_plan"]) == ""
    assert [r.query_text for r in got.where("doc_id = 0 AND kind = 'entity'").orderBy("pos").collect()] == names
    assert names.index("Ann Zblo") > 30 and any("Ann Zblo" in r.query_text for r in got.where("kind = 'claim'").collect())
