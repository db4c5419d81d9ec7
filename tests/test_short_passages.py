"""Passages of a few words, or of none, are searched as well as long ones."""

import random

import numpy as np
import pytest

from bylines.functions import shingles as H
from bylines.operators import similarity as J
from bylines.plans.oracles import ORACLE_SQL
from bylines.plans.queries import QUERIES
from tests.compare import connection, differ

ITEMS = ["three villages inland", "rail", "ail fares ri", "", "é", "Küste 村が三つ", "村", ".", "no such words", "RAIL", None, "x" * 5000, "fares rise\nagain", "a long passage of words that has shingles of its own", "\U0001F600", "lages", "rail"]
TEXTS = ["The plan moves three villages inland", "rail fares rise\nagain and again", "Küste 村が三つ動く.", "", None, "y" * 1000 + "x" * 5001, "x" * 4999, "here a long passage of words that has shingles of its own", "\U0001F600 é", "three villages", "rail", "villages inland three"]


@pytest.mark.parametrize("most", [1 << 26, 900])
def test_short_items_against_every_text(spark, most):
    r = random.Random(2)
    items = ITEMS + ["".join(r.choice("ab ") for _ in range(r.randrange(1, 9))) for _ in range(40)]
    texts = TEXTS + ["".join(r.choice("ab ") for _ in range(r.randrange(60))) for _ in range(250)]
    some = lambda x: spark.createDataFrame(list(enumerate(x)), "n long, text string").repartition(3)
    got = J.short_matches(some(items), some(texts), "n", "n", most=most).collect()
    short = lambda x: len("".join(c if c.isascii() and c.isalnum() else " " for c in x.lower()).split()) < 7
    want = {(i, d) for i, x in enumerate(items) if x is not None and short(x) for d, t in enumerate(texts) if t is not None and x in t}
    assert len(got) == len(want) and {tuple(g) for g in got} == want
    assert J.short_matches(some([ITEMS[-4], None]), some(texts), "n", "n").count() == 0


@pytest.mark.parametrize("stretch", [1 << 20, 7, 1])
@pytest.mark.parametrize("size", [1, 4, 64])
def test_equal_bytes_have_equal_hashes(monkeypatch, stretch, size):
    monkeypatch.setattr(H, "STRETCH", stretch)
    raw = bytes(random.Random(1).choices(b"ab\xff\x00", k=300)) * 2
    H._powers.cache_clear()
    found = [(at + i, int(x)) for at, h in H.place_hashes(np.frombuffer(raw, np.uint8), size) for i, x in enumerate(h)]
    H._powers.cache_clear()
    assert [i for i, _ in found] == list(range(len(raw) - size + 1))
    pairs = {(raw[i : i + size], x) for i, x in found}
    assert len(pairs) == len({p for p, _ in pairs}) == len({x for _, x in pairs})


@pytest.mark.parametrize("name", ["existence_ladder", "passage_search", "existence_class"])
def test_queries_search_short_claims(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    d = str(tmp_path)
    assert differ(QUERIES[name](spark, d), connection(d), ORACLE_SQL[name]) == ""
