import numpy as np
from pyspark.sql import functions as F

from bylines.llm.queries import op8_toxicity
from bylines.llm.toxicity import Machine, fit_machine, held_out, joined, score, train


def test_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = Machine(0.3, rng.normal(size=8), rng.normal(size=(8, 3)))
    rows = [np.array([0, 2, 5]), np.array([], np.int64), np.array([7])]
    for r, got in zip(rows, m.raw(*joined(rows))[0], strict=True):
        want = 0.3 + sum(m.weights[i] for i in r) + sum(m.factors[i] @ m.factors[j] for a, i in enumerate(r) for j in r[:a])
        assert abs(want - got) < 1e-9


def test_pairs_are_learnt():
    """Term 1 or 2 alone is harmless, both together are not: no additive weights can say so with 1 or 2 on their own at all."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(1200):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array([i for i, on in ((1, a), (2, b)) if on] + [int(rng.integers(10, 40))], dtype=np.int64))
        y.append(float(a == b))
    m = fit_machine(rows, np.array(y), bits=6)
    assert ((m.scores(rows) >= 0.5) == np.array(y)).mean() > 0.97


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = op8_toxicity(spark, d).join(labels, "doc_id").where("held_out").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    by = {r.toxic: r.p for r in got}
    assert by[1] > 0.75 and by[0] < 0.01


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 9), (1, "", 9), (None, "x " * 9000, 9), (2, "idiot", 9)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = train(docs, none)
    got = score(docs, model).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.5}
    odd = spark.createDataFrame([(2, 1), (None, 0), (1, None)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in score(docs, train(docs, odd)).collect())
    assert score(docs.limit(0), model).count() == 0


def test_pairs_are_learnt_from_texts(spark):
    """Two words that are each as common in toxic as in clean texts, toxic where both stand or neither: no term but its partner tells."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(3000):
        a, b = rng.integers(0, 2, 2)
        rows.append((i, " ".join([w for w, on in (("blue", a), ("fox", b)) if on] + [f"w{rng.integers(0, 30)}"]), int(a == b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = score(docs.drop("toxic"), train(docs.drop("toxic"), docs.drop("text"))).join(docs, "doc_id").where(held_out("doc_id")).select("score", "toxic").collect()
    assert len(got) > 500 and sum((r.score >= 0.5) == (r.toxic == 1) for r in got) > 0.95 * len(got)
