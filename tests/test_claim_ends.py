"""Claims that are cut between a mark and a line break do not end with the mark."""

import pytest

from bylines.plans.oracles import ORACLE_SQL
from bylines.plans.queries import QUERIES
from tests.compare import connection, differ


@pytest.mark.parametrize("query", ["claim_selection", "merged_claims"])
def test_marks_before_a_line_break_at_the_cut(spark, tmp_path, query):
    """No sentence is over 40 characters, so the first 400 are the claim, and the 400th is a line break behind the mark."""
    rows = []
    for i, mark in enumerate(".?.?"):
        words = "short words here! " * 30
        rows.append((i, words[: 398 if i < 2 else 399] + mark + "\n" + words, "en", "src0", 800))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert differ(QUERIES[query](spark, str(tmp_path)), connection(str(tmp_path)), ORACLE_SQL[query]) == ""
