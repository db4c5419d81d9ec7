"""Fingerprints against plain Python: edited texts round the ring, equal texts, odd rows, likeness against generalised Jaccard."""

import hashlib
import random
from collections import Counter

from bylines.llm.queries import op2_weighted_fingerprints


def edited(text, following):
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def jaccard(a, b):
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    both = x.keys() | y.keys()
    return sum(min(x[w], y[w]) for w in both) / sum(max(x[w], y[w]) for w in both) if both else 1.0


def corpus():
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [None, "", "One word", "one WORD", "é\U0001F600ß x", "a b c d e f g"]
    while len(texts) < 150:
        base = r.choices(vocabulary, k=r.randint(5, 120))
        texts.append(" ".join(base))
        texts.append(" ".join(base if r.random() < 0.3 else base[: len(base) * r.randint(1, 3) // 3] + r.choices(vocabulary, k=10)))
    return texts


def test_every_column_against_python(spark, tmp_path):
    texts = corpus()
    rows = [(7 * i + 3, t, "x", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, bucket string, place int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op2_weighted_fingerprints(spark, str(tmp_path)).collect()}
    assert sorted(got) == [i for i, *_ in rows]
    plain, off = [t or "" for t in texts], []
    for k, (i, *_) in enumerate(rows):
        r, after = got[i], plain[(k + 1) % len(plain)]
        e = edited(plain[k], after)
        assert (r.n_chars, r.edited_sha256) == (len(plain[k]), hashlib.sha256(e.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        off += [r.near_edited - jaccard(plain[k], e), r.near_next - jaccard(plain[k], after)]
        if e == plain[k]:
            assert r.edited_fingerprint == r.fingerprint and r.near_edited == 1
        if after == plain[k]:
            assert r.near_next == 1
    assert abs(sum(off) / len(off)) < 0.02 and (sum(x * x for x in off) / len(off)) ** 0.5 < 0.09  # 64 samples
    by_text = {}
    for k, (i, *_) in enumerate(rows):
        by_text.setdefault(plain[k], set()).add(got[i].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    assert got[rows[2][0]].fingerprint == got[rows[3][0]].fingerprint  # the same words


def test_repeats_null_ids_and_no_rows(spark, tmp_path):
    def run(rows, name):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        return op2_weighted_fingerprints(spark, f"{tmp_path}/{name}").collect()

    assert run([], "none") == []
    one = run([(5, "alone in the table")], "one")[0]
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(edited("alone in the table", "alone in the table").encode()).hexdigest()
    got = run([(1, "a b"), (1, "a b"), (None, "c d"), (2, None)], "odd")
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 3), (1, 3), (1, 3), (2, 0)]
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1
