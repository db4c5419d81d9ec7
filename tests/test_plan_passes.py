"""A query plan cuts each document into sentences once, and its results are those of its SQL."""

from bylines.operators import claims as C
from bylines.plans.oracles import ORACLE_SQL
from bylines.plans.queries import QUERIES
from tests.compare import connection, differ

D = "/root/testdata/sf0.001"


def test_sentences_are_cut_once(spark, monkeypatch):
    cuts, cut = [], C.every_sentence
    monkeypatch.setattr(C, "every_sentence", lambda *a, **k: cuts.append(1) or cut(*a, **k))
    assert differ(QUERIES["query_plan"](spark, D), connection(D), ORACLE_SQL["query_plan"]) == ""
    assert len(cuts) == 1
    assert differ(QUERIES["claim_selection"](spark, D), connection(D), ORACLE_SQL["claim_selection"]) == ""
