"""Independence batch by batch: any split gives the answer of one batch, and a batch that comes again changes nothing."""

import random

import pytest

from bylines.operators.independence import independent_sources, similar_texts
from bylines.streaming.independence import Store, fold_in, keep_independent

SCHEMA = "run_id long, doc long, publisher_id string, body_hash string, wire string, text string"


def pages(seed):
    r = random.Random(seed)
    base = [" ".join(f"b{g}w{i}" for i in range(60)) for g in range(4)]
    rows = []
    for doc in range(36):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 3])):
            w[r.randrange(60)] = f"x{r.randrange(50)}"
        text = " ".join(w) if r.random() < 0.85 else r.choice([None, "", "short"])
        rows.append((doc % 2, doc, f"p{r.randrange(6)}", r.choice([None, None, "h1", "h2"]), r.choice([None, None, None, "Reuters", "AFP"]), text))
    return rows


def at_once(spark, rows, owners):
    df = spark.createDataFrame(rows, SCHEMA)
    return {tuple(x) for x in independent_sources(df, owners, *similar_texts(df, "doc", "text")).collect()}


@pytest.fixture
def owners(spark):
    return spark.createDataFrame([("p0", "g"), ("p1", "g"), ("p2", None)], "publisher_id string, parent_group string")


@pytest.mark.parametrize("seed, parts", [(1, 2), (2, 4)])
def test_any_split_gives_the_batch_answer(spark, tmp_path, owners, seed, parts):
    rows, r = pages(seed), random.Random(seed)
    store, batches = Store(spark, f"file://{tmp_path}/store"), [[] for _ in range(parts)]
    for row in rows:
        r.choice(batches).append(row)
    for n, batch in enumerate(batches):
        fold_in(spark.createDataFrame(batch, SCHEMA), n, store, owners)
    assert {tuple(x) for x in store.sources().collect()} == at_once(spark, rows, owners)


def test_repeats_change_nothing_and_empty_batches_do_no_harm(spark, tmp_path, owners):
    rows, store = pages(3), Store(spark, f"file://{tmp_path}/store")
    assert store.sources().count() == 0
    df = spark.createDataFrame(rows, SCHEMA)
    fold_in(df, 0, store, owners)
    once = {tuple(x) for x in store.sources().collect()}
    fold_in(df, 0, store, owners)  # the same batch
    fold_in(df.union(df), 1, store, owners)  # its pages under another number
    fold_in(df.limit(0), 2, store, owners)
    fold_in(spark.createDataFrame([(None, 1, "p", None, None, "t"), (1, None, "p", None, None, "t")], SCHEMA), 3, store, owners)
    assert {tuple(x) for x in store.sources().collect()} == once == at_once(spark, rows, owners)
    assert store.batches() == [0, 1, 2, 3] and store.read("docs").count() == len(rows)


def test_a_batch_that_failed_is_written_again(spark, tmp_path, owners):
    rows, store = pages(4), Store(spark, f"file://{tmp_path}/store")
    store.add(0, "docs", spark.createDataFrame([(9, 9, "p", None, None, "c", 0)], "run_id long, doc long, publisher_id string, body_hash string, wire string, class string, batch long"))
    assert store.batches() == [] and store.sources().count() == 0  # without its mark nothing of it is read
    fold_in(spark.createDataFrame(rows, SCHEMA), 0, store, owners)
    assert {tuple(x) for x in store.sources().collect()} == at_once(spark, rows, owners)


def test_stream_goes_on_after_a_restart(spark, tmp_path, owners):
    rows, store = pages(5), Store(spark, f"file://{tmp_path}/store")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        keep_independent(stream, store, owners, f"{tmp_path}/checkpoint").awaitTermination()

    spark.createDataFrame(rows[:15], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    run()
    spark.createDataFrame(rows[10:], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert {tuple(x) for x in store.sources().collect()} == at_once(spark, rows, owners) and len(store.batches()) == 2
