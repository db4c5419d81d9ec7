import re

import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from bylines.llm.packing import pack
from bylines.llm.simhash import simhash_groups
from bylines.scratch import rows_at_once, written
from tests.llm.test_exact_shards_simhash import UP
from tests.llm.test_packing import holds, wanted
from tests.llm.test_secrets import base

D = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, D)
        assert out.columns == docs.columns
        kept[name] = {r.doc_id: r for r in out.collect()}
        docs = spark.createDataFrame(list(kept[name].values()), docs.schema)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    good = [i for i, q in quality.items() if q == 1]
    assert sum(i in kept["quality"] for i in good) >= 0.97 * len(good)
    assert sum(i in kept["quality"] for i, q in quality.items() if q == 0) <= 0.2 * (len(quality) - len(good))

    last = {}
    for i, r in sorted(kept["quality"].items()):
        last[r.text.translate(UP)] = i
    assert set(kept["exact dedup"]) == set(last.values())

    entered = spark.createDataFrame(list(kept["exact dedup"].values()), docs.schema)
    assert set(kept["near dedup"]) == {r.component_id for r in simhash_groups(entered).collect()}

    assert set(kept["secrets"]) == set(kept["near dedup"])
    for i, r in kept["secrets"].items():
        text = before[i].text
        assert not base(r.text) and r.n_chars == len(r.text)
        if not base(text):
            assert r.text == text or "[SECRET]" in r.text
        assert re.sub(r"\[SECRET\]", "", r.text) <= text or "[SECRET]" in r.text


def test_run_packs_what_is_left(spark):
    rows = corpus_pipeline.run(spark, D).collect()
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, D).collect(), docs.schema)
    left = docs.collect()
    import zlib
    from types import SimpleNamespace

    got = [SimpleNamespace(**(r.asDict() | {"ids_crc32": zlib.crc32(r.ids)})) for r in rows]
    holds(got, dict(zip([r.doc_id for r in left], wanted([r.text for r in left]), strict=True)))


def test_odd_and_empty_tables(spark):
    rows = [(1, "Some Text", "en"), (1, "Some Text", "en"), (2, "some text", "en"), (2, "some text", "en"), (3, None, None), (4, "", "en"), (None, "a token=abcdefgh here", "en"), (None, "a token=abcdefgh here", "en"), (5, "word " * 30_000, "de")]
    docs = spark.createDataFrame([(i, t, g, "s", 1, "extra") for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long, _id string")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = stage(spark, docs.drop("_id"), D).collect()
        assert stage(spark, docs.drop("_id").limit(0), D).count() == 0, name
    assert sorted((r.doc_id or 0, r.text) for r in out["exact dedup"]) == sorted([(2, "some text"), (4, ""), (0, rows[6][1]), (5, rows[8][1])])
    assert sorted(r.text or "" for r in out["secrets"] if r.doc_id is None) == ["a [SECRET] here"] * 2
    assert len(out["secrets"]) == len(rows) and sum(r.length for r in out["packing"] if r.doc_id in (3, 4)) == 2


def test_near_dedup_leaves_out_no_pair(spark):
    """Random texts of 20 to 200 words, each with an edited copy between 0.8 and 0.95 of its five-word shingles; short ones shift fingerprints most."""
    import random

    rng, rows, alike = random.Random(11), [], []
    shingles = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
    for n in range(300):
        ws = [f"v{rng.randrange(5000)}" for _ in range(rng.randrange(20, 200))]
        other = ws + [f"u{rng.randrange(5000)}" for _ in range(rng.randrange(1, max(2, len(ws) // 5)))]
        rows += [(2 * n, " ".join(ws)), (2 * n + 1, " ".join(other))]
        x, y = shingles(ws), shingles(other)
        alike.append(100 * len(x & y) >= 80 * len(x | y))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near(spark, docs, D).collect()}
    assert sum(alike) > 200
    assert kept == {i for i, _ in rows if i % 2 == 0 or not alike[i // 2]}


def test_few_texts_go_to_python_at_once(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    sizes = lambda: spark.range(0, 5000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    with rows_at_once(spark, corpus_pipeline.ROWS_AT_ONCE):
        assert max(r.n for r in written(sizes()).collect()) == corpus_pipeline.ROWS_AT_ONCE
        with rows_at_once(spark, 10_000):
            assert spark.conf.get(key) == str(corpus_pipeline.ROWS_AT_ONCE)
    assert spark.conf.get(key) == before and max(r.n for r in sizes().collect()) == 5000


def test_packing_by_few_texts_and_words(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    few = pack(docs, public_tokenizers.path("word_bpe_49k.json"), cached=300, keep=False, at_once=7)
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()}


def test_near_dedup_groups_are_those_of_all_pairs(spark):
    """Each pair of the driver's texts, and of large groups whose members are not all alike, compared by whole sets."""
    import random

    from tests.llm.test_jaccard import components, links_of, sets_of

    rng = random.Random(17)
    texts = [r.text for r in spark.read.parquet(f"{D}/documents.parquet").orderBy("doc_id").collect()]
    for g in range(3):
        ws = [f"g{g}v{i}" for i in range(120)]
        for _ in range(40):
            ws = [w if rng.random() > 0.012 else f"n{rng.randrange(9)}" for w in ws]
            texts.append(" ".join(ws))
    sets = sets_of(texts, 5)
    want = components(len(texts), links_of(sets, 80))
    blank = [i for i, s in enumerate(sets) if not s]
    got = {r.doc_id: r.component_id for r in simhash_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: min(blank) if i in blank else c for i, c in enumerate(want)}
