"""The n-gram Jaccard join against all pairs, at several sizes of the tables that only steer it."""

import random

import pytest

from bylines.llm import jaccard as J


def sets_of(texts, words=3):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        n = min(words, len(w))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    return out


def links_of(sets, per_cent):
    found = set()
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= per_cent * len(x | sets[j]):
                found.add((j, i))
    return found


def components(n, links):
    root = list(range(n))
    for a, b in sorted(links):
        x, y = sorted((root[a], root[b]))
        root = [x if r == y else r for r in root]
    return root


def corpus(seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "ß", "ÀB", "a\x0bb", "x y"]
    shared = " ".join(r.choice(vocabulary) for _ in range(60))
    texts = [None, "", " \n\t", "one", "ONE", "one two", "Two one", "one two three", "a b c d", "a b c  d\n"]
    for g in range(16):
        base = [r.choice(vocabulary) for _ in range(r.randint(12, 150))]
        for _ in range(r.choice([1, 3, 10, 25])):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(w))
                w[k : k + r.randint(0, 2)] = [r.choice(vocabulary)]
            texts.append((shared + " " if g % 4 == 0 else "") + r.choice([" ", "\n", "  "]).join(w).replace("w1", r.choice(["w1", "W1"])))
    return texts + texts[10:30]


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.mark.parametrize("frequent, sample, bits, per_cent", [(250_000, 1_000_000, 1 << 26, 90), (5, 300, 64, 90), (0, 100, 1 << 10, 80)])
def test_components_equal_all_pairs(spark, monkeypatch, texts, frequent, sample, bits, per_cent):
    monkeypatch.setattr(J, "SAMPLE_GRAMS", sample)
    monkeypatch.setattr(J, "FILTER_BITS", bits)
    monkeypatch.setattr(J.frequent_grams, "__defaults__", (frequent,))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, n int").repartition(4)
    sets = sets_of(texts)
    want = components(len(texts), links_of(sets, per_cent))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df, per_cent=per_cent).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, want))}
    assert len(set(want)) < len(texts) - 30  # there is something to find


def test_every_link(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members, links = J.similar_sets(df)
    name = {bytes(r.key): r.id for r in members.where("key IS NOT NULL").orderBy(members.id.desc()).collect()}
    sets = sets_of(texts)
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    want = {(a, b): len(sets[a] & sets[b]) for a, b in links_of(sets, 90) if a == first[frozenset(sets[a])] and b == first[frozenset(sets[b])] and sets[a] != sets[b]}
    got = {tuple(sorted((name[bytes(r.a)], name[bytes(r.b)]))): r.common for r in links.collect()}
    assert got == want and len(got) > 40


def test_null_ids_repeats_and_no_rows(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d"), (7, "A b c d"), (7, "A b c d"), (None, None), (9, "other words here now")]
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == [(-1, 0, -1), (-1, 2, 7), (7, 2, 7), (7, 2, 7), (9, 2, 9)]


def test_driver_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sets = sets_of([t for _, t in rows])
    by_size = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    links = set()
    for k, i in enumerate(by_size):
        for j in by_size[k + 1 :]:
            if len(sets[i]) * 100 < 90 * len(sets[j]):
                break
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                links.add((i, j))
    want = components(len(rows), links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(docs).collect()}
    assert got == {rows[i][0]: (len(s), rows[c][0]) for i, (s, c) in enumerate(zip(sets, want))}


def test_columns_of_the_same_sets_are_one(spark, monkeypatch):
    """Two near copies share a hundred n-grams and more of their index, and meet in one row."""
    words = [f"w{i}" for i in range(1500)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join([*words[:-1], "end"]), "other words that nobody has"]
    seen, product = [], J._product
    monkeypatch.setattr(J, "_product", lambda a, b, *more: seen.append((a.count(), a.agg({"w": "sum"}).head()[0])) or product(a, b, *more))
    got = {r.doc_id: r.component_id for r in J.jaccard_components(spark.createDataFrame(list(enumerate(texts[:2] + texts[3:])), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2} and seen[-1][0] == 2 and seen[-1][1] > 200
    got = {r.doc_id: r.component_id for r in J.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3}
