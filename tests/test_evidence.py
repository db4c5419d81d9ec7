import random
import re
from collections import Counter
from zlib import crc32

import pytest

from bylines.functions.url import canonical_url, publisher_family, publisher_identity, source_band
from bylines.operators import independence as I
from bylines.operators import search as S
from bylines.operators import stance as T
from bylines.operators.components import connected_components
from bylines.operators.numbering import number_within
from bylines.plans.oracles import ORACLE_SQL
from bylines.plans.queries import QUERIES
from bylines.streaming.pages import first_arrivals, run_to_end
from pyspark.sql import functions as F
from tests.compare import connection, differ

D = "/root/testdata/sf0.001"
BODY = "the coastal defence plan announced on friday will move three villages inland over ten years at public cost"
OTHER = "rail fares rise again in january as operators blame staff costs and falling numbers of season ticket holders"


@pytest.mark.parametrize("name", ["pages_vs_newsrooms_per_claim", "exact_url_dedupe", "source_bands", "shingle_jaccard_pairs", "capability_gate", "coverage_report", "existence_ladder", "heuristic_claims", "claim_selection", "vector_topk", "claim_fusion", "support_rate", "trace_runs", "layer_status", "run_history", "stream_trace_tail"])
def test_against_sql(spark, name):
    assert differ(QUERIES[name](spark, D), connection(D), ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_the_rest_runs(spark, name):
    assert len(QUERIES[name](spark, D).head(1)) == 1


def shingles(t):
    w = re.findall("[a-z0-9]+", (t or "").lower())
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} - {""}


def brute_sources(docs, owner):
    edges, parent = [], {d[1]: d[1] for d in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in docs:
        for y in docs:
            if x[1] >= y[1] or x[0] != y[0]:
                continue
            a, b = shingles(x[5]), shingles(y[5])
            j = len(a & b) / len(a | b) if a | b else 0
            rank = 9
            if x[4] and y[4]:
                if x[4] == y[4] and (x[3] and x[3] == y[3] or j >= 0.8):
                    rank = 0
            elif not x[4] and not y[4] and x[2] != y[2] and (x[3] == y[3] if x[3] and y[3] else j >= 0.9):
                rank = 2
            if owner.get(x[2]) and owner.get(x[2]) == owner.get(y[2]):
                rank = min(rank, 1)
            if rank < 9:
                edges.append((x[1], y[1], rank))
                parent[root(x[1])] = root(y[1])
    out = set()
    for r, d, *_ in docs:
        members = [x[1] for x in docs if root(x[1]) == root(d)]
        ranks = [k for a, b, k in edges if root(a) == root(d)]
        out.add((r, d, min(members), I.MERGE_REASONS[min(ranks)] if ranks else "none"))
    return out


def sources_of(spark, docs, owner):
    df = spark.createDataFrame(docs, "run_id long, doc long, publisher_id string, body_hash string, wire string, text string")
    owners = spark.createDataFrame(list(owner.items()), "publisher_id string, parent_group string")
    return I.independent_sources(df, owners, *I.similar_texts(df, "doc", "text")), df


@pytest.mark.parametrize("seed", range(4))
def test_independence_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    words = BODY.split() * 3
    docs = []
    for d in range(40):
        w = list(words)
        for _ in range(rng.choice([0, 0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(6)}"
        text = " ".join(w) if rng.random() < 0.7 else rng.choice([OTHER, "", "short text", None])
        docs.append((d % 2, d, f"p{rng.randrange(5)}", rng.choice([None, None, "h1", "h2"]), rng.choice([None, None, None, "Reuters", "AFP"]), text))
    owner = {"p0": "g", "p1": "g", "p2": None} if seed % 2 else {"p9": "g"}
    got, _ = sources_of(spark, docs, owner)
    assert {tuple(r) for r in got.collect()} == brute_sources(docs, owner)


def test_twenty_copies_of_a_wire_are_one_newsroom(spark):
    docs = [(1, i, f"paper{i}", None, "Reuters", BODY) for i in range(20)] + [(2, 100, "a", None, "Reuters", BODY), (2, 101, "b", None, "AFP", BODY)]
    got, df = sources_of(spark, docs, {"a": None})
    runs = spark.createDataFrame([(1,), (2,), (3,)], "run_id long")
    counts = {r.run_id: (r.document_count, r.independent_source_count) for r in I.pages_vs_newsrooms(runs, got).collect()}
    assert counts == {1: (20, 1), 2: (2, 2), 3: (0, 0)}
    text = {r.evidence for r in I.source_summary(got, df).where("run_id = 1").collect()}
    assert text == {"same_wire: paper0, paper1, paper10, paper11, paper12, paper13 and 14 more"}


def test_urls(spark):
    cases = {
        "HTTPS://www.BBC.co.uk:443/News/a/?utm_source=x&b=2&a=1#top": "https://bbc.co.uk/News/a?a=1&b=2",
        "https://www.google.com/amp/s/ft.com/x": "https://ft.com/x",
        "https://ft.com/story/amp.html": "https://ft.com/story",
        "https://t.co/?url=https%3A%2F%2Fapnews.com%2Fq%3Fs%3D1": "https://apnews.com/q",
        "https://x.com/Alice/status/1": "https://x.com/Alice/status/1",
        "  ": "", None: "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.c for r in df.select("u", canonical_url(F.col("u")).alias("c")).collect()} == cases
    who = {"https://alice.substack.com/p/1": "substack.com/alice", "https://medium.com/@bob/x": "medium.com/@bob", "https://www.bbc.co.uk/x": "bbc.co.uk", "https://edition.cnn.com/a": "cnn.com"}
    df = spark.createDataFrame([(k,) for k in who], "u string")
    assert {r.u: r.p for r in df.select("u", publisher_identity(F.col("u")).alias("p")).collect()} == who
    row = df.select(*[F.max(F.when(F.col("u").contains("bbc"), f(F.col("u")))).alias(n) for f, n in ((publisher_family, "f"), (source_band, "b"))]).head()
    assert tuple(row) == ("bbc", "known_legacy")


def test_components_and_numbers_against_brute_force(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    want = {x: min(y for y in parent if root(y) == root(x)) for x in parent}
    got = connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
    rows = number_within(spark.range(1000).withColumn("g", F.col("id") % 3), "g", F.col("id"), [F.col("id")], "n", 334, 20).collect()
    assert all(sorted(r.n for r in rows if r.g == g) == list(range(sum(r.g == g for r in rows))) for g in range(3))


def test_ladder_gate_and_states(spark):
    rungs = spark.createDataFrame([(1, 1, "exact", 0), (1, 2, "loose", 3), (1, 3, "keyword", 9), (2, 1, "exact", 0), (3, None, None, 0)], "run_id long, attempt int, strength string, hits int")
    assert {tuple(r) for r in S.ladder(rungs).collect()} == {(1, "matched", "loose", 2, 3), (2, "exhausted", "none", 1, 0), (3, "not_planned", "none", 0, 0)}
    runs = spark.createDataFrame([(1, 500, "en"), (2, None, None)], "run_id long, age_days int, language string")
    caps = spark.createDataFrame([("a", 30, None, True), ("b", None, ["de"], False), ("c", None, None, True)], "adapter string, max_age_days int, languages array<string>, requires_key boolean")
    got = {(r.run_id, r.adapter): (r.status, r.checks_skipped) for r in S.capability_gate(runs, caps).collect()}
    assert got[1, "a"] == ("skipped_out_of_range", []) and got[1, "b"][0] == "skipped_out_of_range" and got[1, "c"][0] == "skipped_no_key"
    assert got[2, "a"] == ("skipped_no_key", ["age"]) and got[2, "b"] == ("run", ["language"])
    fused = spark.createDataFrame([(1, "single_source", "nli_only", "not_found"), (1, "event_corroborated", "nli_only", "not_found"), (2, "not_assessed", "none", "not_found"), (3, "single_source", "none", "out_of_range")], "run_id long, state string, agreement string, existence string")
    assert {r.run_id: (r.support_pct, r.omitted_because) for r in T.support_rate(fused).collect()} == {1: (50, None), 2: (None, "not_assessed"), 3: (None, "out_of_range")}
    pair = spark.createDataFrame([("the plan will not go ahead", "the plan will go ahead"), ("", "a"), ("rail fares rise", "rail fares rise")], "p string, h string")
    assert Counter(r.x.label for r in pair.select(T.lexical_stance(F.col("p"), F.col("h")).alias("x")).collect()) == Counter(["contradiction", "neutral", "entailment"])


def test_stream_keeps_first_arrivals(spark, tmp_path):
    rows = [(1, "https://a.example/x?utm_source=1"), (2, "https://a.example/x"), (3, "https://a.example/y/")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("page_id long, url string").parquet(f"{tmp_path}/in").withColumn("ts", F.lit("2026-01-01").cast("timestamp"))
    got = run_to_end(first_arrivals(stream, "ts").select("grouping_url")).collect()
    assert Counter(r.grouping_url for r in got) == Counter(["https://a.example/x", "https://a.example/y"])


@pytest.mark.parametrize("buckets", [None, 512])
@pytest.mark.parametrize("cells", [10**6, 0])
def test_trigram_rank_reads_whole_texts(spark, buckets, cells):
    """The claim stands behind a long first line; both ways against all pairs."""
    claims = {1: "Three villages move INLAND", 2: "rail fares rise \U0001F600"}
    docs = {i: f"{'headline of another matter ' * 6}{i}\n{t}" for i, t in enumerate([BODY, OTHER, "three  villages\nmove inland", "rail fares rise \U0001F600", "", "x"])} | {9: "ab", 10: "rail fares rise \U0001F600"}

    def vector(t):
        t = " ".join(t.lower().split())
        n = Counter(t[i : i + 3] for i in range(len(t) - 2))
        if buckets:
            of, n = n, Counter()
            for g, c in of.items():
                n[crc32(g.encode()) % buckets] += c
        return n, sum(c * c for c in n.values()) ** 0.5

    want = {}
    for c, q in claims.items():
        a, na = vector(q)
        met = [(-sum(a[g] * b[g] for g in a) / na / nb, d) for d, t in docs.items() for b, nb in [vector(t)] if set(a) & set(b)]
        want[c] = [(d, pytest.approx(-s, abs=2e-6)) for s, d in sorted(met)[:3]]
    vectors = T.trigram_vectors(spark.createDataFrame(list(claims.items()), "claim long, text string"), "claim", "text", buckets).cache()
    got = T.trigram_top(vectors, spark.createDataFrame(list(docs.items()), "doc long, text string"), "doc", "text", 3, buckets, cells).orderBy("claim", "rank").collect()
    assert {c: [(r.doc, r.score) for r in got if r.claim == c] for c in claims} == want


def test_trigram_rank_finds_passages_below_the_first_line(spark, tmp_path):
    passage = "the coastal defence plan will move three villages inland"
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, f"another matter\n{passage} and more", "en", "src0")] + [(i, f"the plan of day {i}\nnothing here", "en", "src1") for i in range(2, 6)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("trigram_rank", "trigram_rank_hashed"):
        assert QUERIES[name](spark, str(tmp_path)).where("rank = 1").head().doc == 1
