import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from bylines.llm import quality
from bylines.llm.queries import op1_quality

TEXTS = ["the cat sat on the mat", "a cat and a dog 12", "the the dog", "cats sit", "\U0001F600 smile"]


def brute_grams(text):
    words = "".join("0" if c.isascii() and c.isdigit() else c for c in text).split()
    out, before = [], "\x02" * 3
    for i, w in enumerate(words):
        for j, c in enumerate(([" "] if i else []) + list(w)):
            c = min(c, "￿")
            real = c
            if i and w == words[i - 1]:
                if j == 1:
                    c = ""
                elif j > 1:
                    c = None
            if c is not None:
                out.append(before[-3:] + c)
            before += real
    return out


def brute_model(texts):
    counts = {4: Counter(g for t in texts for g in brute_grams(t))}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    v = len(counts[1]) + 1

    def cuts(k):
        n = Counter(counts[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        return [max(0.05, min(i - 0.05, i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5)) for i in (1, 2, 3)]

    d = {k: cuts(k) for k in counts}
    followers = {k: defaultdict(list) for k in counts}
    for k in counts:
        for g, n in counts[k].items():
            followers[k][g[:-1]].append(n)

    def p(g):
        k = len(g)
        if not k:
            return 1 / v
        ns = followers[k].get(g[:-1])
        if not ns:
            return p(g[1:])
        n = counts[k].get(g, 0)
        off = d[k][min(n, 3) - 1] if n else 0
        return (n - off) / sum(ns) + sum(d[k][min(x, 3) - 1] for x in ns) / sum(ns) * p(g[1:])

    return p


def table(spark):
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(10, "the dog sat", "en"), (11, "zzqq!!", "en"), (12, None, "en"), (13, " \n", "en"), (14, "wort", "de"), (15, "mot mot", None), (None, "the cat", "en")]
    labels = [(i, 1) for i in range(len(TEXTS))] + [(11, 0), (None, 1), (12, None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, perplexity double")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int"), rows


@pytest.mark.parametrize("local_rows", [10**6, 0])
def test_against_brute_force(spark, local_rows):
    docs, labels, rows = table(spark)
    p = brute_model(TEXTS)
    got = {r.doc_id: r for r in quality.classify(docs, labels, local_rows=local_rows).collect()}
    assert len(got) == len(rows)
    for i, t, lang in rows:
        gs = brute_grams(t or "")
        if lang == "en" and gs:
            want = math.exp(-sum(math.log(p(g)) for g in gs) / len(gs))
            assert abs(got[i].perplexity - want) < 1e-6 * want
        else:
            assert got[i].perplexity is None
    assert all(got[i].kept for i in range(len(TEXTS))) and got[14].kept and got[15].kept and not (got[12].kept or got[13].kept or got[11].kept)


def test_no_labels_no_rows(spark):
    docs, labels, _ = table(spark)
    got = quality.classify(docs, labels.limit(0)).collect()
    assert all(r.kept == (r.doc_id not in (12, 13)) for r in got)
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_held_out_accuracy(spark):
    """Trained on the even labels only, odd rows are told apart."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.classify(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in got}
    assert kept[1] > 0.99 and kept[0] < 0.08


def test_query_covers_the_table(spark):
    d = "/root/testdata/sf0.001"
    assert op1_quality(spark, d).select("doc_id").distinct().count() == spark.read.parquet(f"{d}/documents.parquet").count()


def test_both_ways_keep_repeated_rows_and_languages_apart(spark):
    rows = [(i, t, lang) for i, t in enumerate(TEXTS) for lang in ("en", "de")] + [(20, "zwei hunde", "de"), (1, TEXTS[1], "en"), (1, TEXTS[1], "en"), (30, "a dog", "en"), (30, "a dog", "de"), (40, None, "en"), (40, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in (*range(len(TEXTS)), 20)], "doc_id long, quality int")
    local, sharded = (Counter((r.doc_id, r.lang, r.perplexity and round(r.perplexity, 6), r.kept) for r in quality.classify(docs, labels, local_rows=n).collect()) for n in (10**6, 0))
    assert local == sharded and sum(local.values()) == len(rows)
    assert len({p for (i, _, p, _) in local if i == 30}) == 2


def test_long_texts_are_scored_few_at_a_time():
    """A run of rows is bounded by the bytes of its texts, not by their number; a longer text stands alone, and no row is lost."""
    import pyarrow as pa

    from bylines.llm.quality import parts

    texts = ["x" * n for n in (10, 90, 1, 0, 5000, 0, 60, 60)] + [None, "é" * 30]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["id", "text"])
    for whole in (b, b.slice(2)):
        got = [p.column(0).to_pylist() for p in parts(whole, 1, 100)]
        assert sum(got, []) == whole.column(0).to_pylist() and all(got)
        assert all(len(g) == 1 or sum(len((texts[i] or "").encode()) for i in g) <= 100 for g in got)
    assert list(parts(b.slice(0, 0), 1, 100)) == []
