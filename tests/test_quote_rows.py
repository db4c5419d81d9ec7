"""Quotes of a run meet its text in few rows, and only what is not normal is an entry of a normal text's map."""

import random

from bylines.operators import grounding as G
from tests.test_agreement_grounding import plain_locate


def test_normal_characters_and_single_blanks_are_no_entries():
    assert len(G.NormalText("Um café é bom " * 50).at) == 1
    assert G.NormalText("é  ﬃ\nx").text == "é ffi x" and [G.NormalText("é  ﬃ\nx").raw_place(i) for i in range(7)] == [0, 1, 3, 3, 3, 4, 5]


def test_many_quotes_of_a_run(spark, monkeypatch):
    monkeypatch.setattr(G, "QUOTES", 3)
    r = random.Random(5)
    texts = {k: "".join(r.choice("ab “—é\n ") for _ in range(50)) for k in range(4)}
    rows = [(k, f"q{i}", texts[k][(s := r.randrange(40)) : s + r.randint(1, 6)].replace("“", r.choice('“"')), i) for k in texts for i in range(11)] + [(7, "q", "a", 1), (0, None, None, None)]
    quotes = spark.createDataFrame(rows, "run_id long, claim_id string, source_quote string, more int")
    got = G.locate_quotes(spark.createDataFrame(list(texts.items()), "run_id long, text string"), quotes)
    assert got.columns == [*quotes.columns, "start", "end", "grounding"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((k, c, q, m, *plain_locate(texts.get(k), q))) for k, c, q, m in rows)
