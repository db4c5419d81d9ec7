"""Alignment and link counts against whole-text encoding by the libraries and all pairs by hand."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from bylines.llm import alignment as al  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "\n", "The quick brown fox.", "double  spaces   and\ttabs \n new\n\n lines ", " leading", "trailing ", "a<|endoftext|>b </s> <s> <0x41> <unk>", "▁looks like a space", "naïve café ǅ ﬁ Å K",
    "日本語のテキスト。中文 한국어", "\U0001F600\U0001F468‍\U0001F469 x", "\x00\x01 \x7f \x85 y \xa0 z ᠎ q   r 　 s", "it's we'll I'M 'tis don't", "12345 67.89 1e-5 ²³ ½", "x" * 500, "ab " * 300, "é ö İ ß",
    "The quick brown fox.", "﻿bom ​ zero", "a ­b", "word \x1c x \x1f y",
]


def brute(texts):
    """Whole texts through both libraries; groups by running sums; links by comparing all ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    enc = al.encoders(A, B)
    out, pairs = [], []
    for t in texts:
        ids = ([], [])
        if t:
            ids = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            if b"".join(enc.bytes_a[i] for i in ids[0]) != (" " + t).encode() or b"".join(enc.bytes_b[i] for i in ids[1]) != (" " + t).encode():
                ids = ([], [])
        spans = []
        for side, table in zip(ids, (enc.bytes_a, enc.bytes_b)):
            at, mine = 0, []
            for i in side:
                mine.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(mine)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, lo = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if lo <= s and e <= c) for side in spans))
            lo = c
        out.append((len(ids[0]), len(ids[1]), len(groups), ";".join(groups)))
        pairs.append([(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]])
    count = Counter(p for own in pairs for p in set(own))
    top = Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return [(*o[:3], len(own), sum(count[p] == top[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(o[3].encode()).hexdigest() if o[0] else "") for o, own in zip(out, pairs)]


def hostile(n):
    r = random.Random(5)
    alphabet = [" ", "  ", "\n", "\t", "a", "B", "the", "ing", "'s", ".", ",", "é", "日", "\U0001F600", "▁", "9", "᠎", "\x1c", "　", "<s>", "-", "_", "́", "\x00", "¿"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("block_docs", [3, 2000])
def test_link_counts_equal_brute_force(spark, monkeypatch, block_docs):
    monkeypatch.setattr(al, "BLOCK_DOCS", block_docs)
    texts = TEXTS + hostile(250)
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, block int, slots string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in al.link_counts(df, A, B).collect()}
    want = dict(enumerate(brute(texts)))
    assert {k: v for k, v in got.items() if v != want[k]} == {} and len(got) == len(want)


def test_driver_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: tuple(r)[1:] for r in al.link_counts(docs, A, B).collect()}
    assert got == dict(zip(texts, brute(list(texts.values()))))


def test_groups_are_real_lists(spark):
    row = al.align(spark.createDataFrame([(1, "unbelievable things"), (2, None), (1, "a b")], "doc_id long, text string"), A, B).collect()
    enc = al.encoders(A, B)
    for r in row:
        assert len(r.a_ends) == len(r.b_ends) and (not r.a_ends or (r.a_ends[-1] == len(r.a_ids) and r.b_ends[-1] == len(r.b_ids)))
        for x, y in zip(r.a_ends, r.b_ends):
            assert b"".join(enc.bytes_a[i] for i in r.a_ids[:x]) == b"".join(enc.bytes_b[i] for i in r.b_ids[:y])


def test_no_rows_and_null_ids(spark):
    assert al.link_counts(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    got = al.link_counts(spark.createDataFrame([(None, "x y"), (None, "x y"), ("k", None)], "doc_id string, text string"), A, B).collect()
    assert sorted((r.doc_id or "", r.n_a, r.count_sum) for r in got) == sorted([("", 2, got[0].count_sum if got[0].n_a else got[-1].count_sum)] * 2 + [("k", 0, 0)])


def test_shared_cuts_on_random_intervals():
    r = np.random.default_rng(3)
    for _ in range(200):
        n = int(r.integers(1, 80))
        a, b = (np.unique(np.append(r.integers(1, 3 * n + 1, n), 3 * n + 1)) for _ in range(2))
        got = al.shared_cuts(a, b, np.array([0]), np.array([len(a) - 1]))
        assert got.tolist() == [i for i in range(len(a) - 1) if a[i] in set(b.tolist())]
