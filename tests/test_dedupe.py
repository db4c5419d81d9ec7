"""Greedy dedupe against a sequential loop: chains, hashes beside texts, publishers, runs, odd rows."""

import random

from bylines.operators.dedupe import greedy_dedupe, leaders
from bylines.operators.independence import similar_texts

SCHEMA = "run_id long, doc long, publisher_id string, body_hash string, text string, completeness int, canonical_url string"


def shingles(text):
    import re

    w = re.findall("[a-z0-9]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def loop(rows):
    """The pages in order, one by one."""
    kept, out = [], {}
    sets = {r: shingles(r[4]) for r in rows}
    for r in sorted(rows, key=lambda r: (-r[5], r[6], r[1])):
        for k in kept:
            if (k[0], k[2]) != (r[0], r[2]):
                continue
            a, b = sets[k], sets[r]
            same = k[3] == r[3] if k[3] and r[3] else bool(a and b) and len(a & b) / len(a | b) >= 0.9
            if same:
                out[r[1]] = k[1]
                break
        else:
            kept.append(r)
            out[r[1]] = r[1]
    return out


def dedupe(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "-completeness AS less")
    members, pairs = similar_texts(df, "doc", "text")
    return {r.doc: r.kept_doc for r in greedy_dedupe(df, members, pairs, ["less", "canonical_url"]).collect()}


def test_random_chains_equal_the_loop(spark):
    r, rows, doc = random.Random(11), [], 0
    for chain in range(14):
        w = [f"c{chain}w{i}" for i in range(60)]
        for _ in range(r.choice([1, 3, 8, 15])):
            w = list(w)
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"  # one word from link to link: neighbours are alike, ends are not
            h = r.choice([None, None, None, f"h{chain}", f"h{chain}b"])
            rows.append((r.choice([1, 1, 2]), doc, r.choice(["p", "q"]), h, " ".join(w), r.randint(1, 3), f"u{r.randrange(100)}"))
            doc += 1
    rows += [(1, doc + i, "p", None, t, 1, "u") for i, t in enumerate([None, "", None, "Two words", "two WORDS", "!!"])]
    got = dedupe(spark, rows)
    assert got == loop(rows)
    assert len(set(got.values())) < len(got) - 15 and any(got[k] != k for k in got)


def test_a_chain_is_not_closed(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(1, i, "p", None, " ".join([f"n{j}" if j < 4 * i else w for j, w in enumerate(base)]), 7 - i, f"u{i}") for i in range(3)]
    assert dedupe(spark, rows) == {0: 0, 1: 0, 2: 2} == loop(rows)


def test_large_group_and_empty_table(spark):
    rows = [(1, i, "p", None if i % 3 else "h", "the same text in each of many rows", 1, f"u{i:04}") for i in range(500)]
    assert set(dedupe(spark, rows).values()) == {0}
    assert dedupe(spark, rows[:0]) == {}


def test_leaders_of_random_graphs(spark):
    r = random.Random(2)
    edges = {(run, *sorted(r.sample(range(60), 2))) for run in (1, 2) for _ in range(90)}
    nodes = [(run, i) for run in (1, 2) for i in range(60)]
    want = {}
    for run, i in nodes:
        want[run, i] = next((j for j in range(i) if want[run, j] == j and (run, j, i) in edges), i)
    e = spark.createDataFrame(sorted(edges), "run_id long, a long, b long").selectExpr("run_id", "struct(a AS x, a AS doc) AS a", "struct(b AS x, b AS doc) AS b")
    n = spark.createDataFrame(nodes, "run_id long, i long").selectExpr("run_id", "struct(i AS x, i AS doc) AS ord")
    got = {(x.run_id, x.ord.doc): x.leader.doc for x in leaders(n, e).collect()}
    assert got == want
