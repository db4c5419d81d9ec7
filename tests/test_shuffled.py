"""How much the similarity join moves: rarest shingles and candidates, not every shingle of every text."""

import random

from bylines.operators.independence import similar_texts
from bylines.operators.stance import vector_top_k
from bylines.streaming.independence import Store, fold_in


def written_bytes(spark) -> int:
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() + stages.apply(i).outputBytes() for i in range(stages.size()))


def test_whole_sets_are_written_once_and_not_shuffled(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(2000))) for i in range(300)]
    df = spark.createDataFrame(rows + [(1000 + i, t + " more") for i, t in rows[:20]], "doc long, text string").repartition(4)
    before = written_bytes(spark)
    members, pairs = similar_texts(df, "doc", "text")
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(i, 1000 + i) for i in range(20)] and members.count() == 320
    moved = written_bytes(spark) - before
    assert moved < 5 * 8 * 2000 * 320, moved


def test_batches_store_texts_once_and_shuffle_no_whole_sets(spark, tmp_path):
    rng = random.Random(5)
    rows = [(0, i, f"p{i}", None, None, " ".join(f"v{rng.randrange(10**6)}" for _ in range(2000))) for i in range(300)]
    rows += [(0, 1000 + i, f"q{i}", None, None, r[5] + " more") for i, r in enumerate(rows[:20])]
    schema = "run_id long, doc long, publisher_id string, body_hash string, wire string, text string"
    store, owners = Store(spark, f"file://{tmp_path}/store"), spark.createDataFrame([], "publisher_id string, parent_group string")
    before = written_bytes(spark)
    for n, batch in enumerate((rows[:160], rows[160:])):
        fold_in(spark.createDataFrame(batch, schema), n, store, owners)
    moved = written_bytes(spark) - before
    found = {r.doc: (r.source, r.reason) for r in store.sources().collect()}
    assert found == {i: (i, "none") for i in range(20, 300)} | {i % 1000: (i % 1000, "reprint") for i in range(20)} | {1000 + i: (i, "reprint") for i in range(20)}
    assert moved < 4 * 8 * 2000 * 320, moved


def test_vectors_meet_as_matrices(spark):
    """The k nearest, ties by id, as brute force finds them, over several blocks and shares; rows are sent to each block, not to each query."""
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 64)).astype(np.float32)
    v[100:110] = v[0]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    before = written_bytes(spark)
    got = {(r.query, r["rank"]): (r.neighbour, r.cosine) for r in vector_top_k(df, "vec_id", "embedding", block=100, share=500).collect()}
    moved = written_bytes(spark) - before
    u = v.astype(np.float64)
    u /= np.sqrt((u * u).sum(axis=1))[:, None]
    for q in range(0, 3000, 20):
        c = np.round(u @ u[q], 6)
        order = [i for i in np.lexsort((np.arange(3000), -c)) if i != q][:5]
        assert [got[q, j + 1] for j in range(5)] == [(i, c[i]) for i in order]
    assert moved < 5 * 3000 * 64 * 8, moved
