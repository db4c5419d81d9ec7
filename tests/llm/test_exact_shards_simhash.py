import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from bylines.llm.jaccard import Grams, key_of
from bylines.llm import simhash
from bylines.llm.exact import exact_dedup
from bylines.llm.queries import op3_rendezvous_shards, op4_simhash, op10_exact_dedup
from bylines.llm.shards import shard_records

UP = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
ROWS = [
    (1, "One two three FOUR five"), (2, "one two three four five"), (3, None), (4, ""), (5, "É É é"), (6, "é é é"),
    (7, "x " * 5000), (7, "x " * 5000), (8, "word"), (None, "word"), (None, None),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "en", 1) for i, t in rows], "doc_id long, text string, keep_id string, id int")


def table(spark, folder, rows):
    docs(spark, rows).select("doc_id", "text").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_exact_groups_by_hand(spark):
    got = [tuple(r) for r in exact_dedup(docs(spark)).collect()]
    want = defaultdict(list)
    for i, t in ROWS:
        want[hashlib.sha256((t or "").translate(UP).encode()).hexdigest()].append(i)
    expected = []
    for h, ids in want.items():
        keep = max((i for i in ids if i is not None), default=None)
        expected += [(i, keep, len(ids), i == keep, h) for i in ids]
    assert Counter(got) == Counter(expected)


def test_exact_empty(spark):
    assert exact_dedup(docs(spark, [])).count() == 0


def test_shards_law_and_slots(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    rows = shard_records(df, "k", [1, 1, 2], grown=[1, 1, 2, 1], chunk_rows=500).collect()
    n = Counter(r.shard for r in rows)
    assert abs(n[2] / 20_000 - 0.5) < 0.02 and abs(n[0] / 20_000 - 0.25) < 0.02
    assert all(r.grown_shard in (r.shard, 3) for r in rows)
    assert 0.17 < sum(r.grown_shard == 3 for r in rows) / 20_000 < 0.23
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    with pytest.raises(ValueError):
        shard_records(df, "k", [1.0, 0.0])


def test_shards_odd_rows(spark, tmp_path):
    got = op3_rendezvous_shards(spark, table(spark, tmp_path, ROWS)).collect()
    assert len(got) == len(ROWS)
    texts = defaultdict(list)
    for i, t in ROWS:
        texts[i].append((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())))
    assert all((r["size"], r.text_crc32) in texts[r.doc_id] for r in got)
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def brute(rows):
    fps = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))
        s = [" ".join(w[j:j + 3]) for j in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
        fps.append((i, sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))))
    distinct = list({f for _, f in fps})
    parent = {f: f for f in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(distinct)):
        for b in range(a):
            if (distinct[a] ^ distinct[b]).bit_count() <= 2:
                parent[root(distinct[a])] = root(distinct[b])
    least = {}
    for i, f in fps:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return Counter((i, f"{f:016x}", least.get(root(f))) for i, f in fps)


@pytest.mark.parametrize("direct", [64, 1])
def test_simhash_small(spark, tmp_path, monkeypatch, direct):
    monkeypatch.setattr(simhash, "DIRECT_CELL", direct)
    base = " ".join(f"w{i}" for i in range(400))
    rows = ROWS + [(100 + k, base + f" end{k}") for k in range(12)] + [(130 + k, base[: -k * 5 - 1]) for k in range(8)]
    got = op4_simhash(spark, table(spark, tmp_path, rows))
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_simhash_empty(spark, tmp_path):
    assert op4_simhash(spark, table(spark, tmp_path, [])).count() == 0


def test_simhash_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in op4_simhash(spark, d).collect()) == brute(rows)


def test_exact_whole_table(spark):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r.text_sha256 for r in op10_exact_dedup(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        assert got[r.doc_id] == hashlib.sha256((r.text or "").translate(UP).encode()).hexdigest()


def brute_groups(rows):
    odd = [0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64 for k in range(simhash.VIEWS)]
    prints = []
    for _, t in rows:
        ws = {w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(UP)) if w}
        views = []
        for m in odd:
            hs = []
            for w in ws:
                h = xxhash.xxh64_intdigest(w.encode(), seed=42) * m % 2**64
                h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % 2**64
                hs.append(h ^ h >> 32)
            views.append(sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs)))
        prints.append(views)
    keys, sets = [], {}
    for _, t in rows:
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(UP)) if w]
        n = min(5, len(ws))
        keys.append(key_of(Grams(5).of([t])[0]) or b"")
        sets[keys[-1]] = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if ws else set()
    views = {k: v for k, v in zip(keys, prints, strict=True) if sets[k]}
    asked = set()
    for at in range(simhash.VIEWS):
        heads = {}
        for k, v in views.items():
            heads[v[at]] = min(heads.get(v[at], k), k)
        asked |= {(k, heads[v[at]]) for k, v in views.items()} | {(p, q) for x, p in heads.items() for y, q in heads.items() if (x ^ y).bit_count() <= 2}
    root = {k: k for k in keys}
    for x, y in asked:
        if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]) and root[x] != root[y]:
            old = root[x]
            root = {k: root[y] if r == old else r for k, r in root.items()}
    group = [root[k] for k in keys]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return Counter((i, least.get(g)) for (i, _), g in zip(rows, group, strict=True))


@pytest.mark.parametrize("direct", [64, 1])
def test_simhash_groups_small(spark, monkeypatch, direct):
    monkeypatch.setattr(simhash, "DIRECT_CELL", direct)
    base = [f"w{i}" for i in range(400)]
    rows = ROWS + [(100 + k, " ".join(base[: 390 - 9 * k] + [f"é{k}"] * k + base[400 - 9 * k :])) for k in range(25)] + [(200, " \x0b "), (201, "a\xa0b C"), (202, "c a\xa0b")]
    got = simhash.simhash_groups(docs(spark, rows))
    assert Counter(tuple(r) for r in got.collect()) == brute_groups(rows)
    assert simhash.simhash_groups(docs(spark, [])).count() == 0


def test_simhash_groups_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in simhash.simhash_groups(docs(spark, rows)).collect()) == brute_groups(rows)


def test_simhash_groups_leave_other_texts(spark):
    """The words of a text in another order, or other text around a passage, are no near duplicate."""
    ws = [f"v{i}" for i in range(200)]
    rows = [(1, " ".join(ws)), (2, " ".join(reversed(ws))), (3, " ".join(ws * 3)), (4, " ".join(ws[:120] + [f"u{i}" for i in range(80)]))]
    got = {r.doc_id: r.component_id for r in simhash.simhash_groups(docs(spark, rows)).collect()}
    assert got[1] == 1 and got[2] == 2 and got[4] == 4


def test_simhash_groups_find_edited_copies(spark):
    """Texts of 300 words with one word in 100 replaced, so that about 0.9 of five-word shingles stay, against their originals."""
    import random

    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(5000)]
    rows = []
    for n in range(120):
        ws = rng.choices(vocabulary, k=300)
        edited = list(ws)
        for at in rng.sample(range(300), 3):
            edited[at] = rng.choice(vocabulary)
        rows += [(2 * n, " ".join(ws)), (2 * n + 1, " ".join(edited))]
    got = {r.doc_id: r.component_id for r in simhash.simhash_groups(docs(spark, rows)).collect()}
    assert sum(got[2 * n + 1] == 2 * n for n in range(120)) >= 114
    assert len(set(got.values())) >= 120
