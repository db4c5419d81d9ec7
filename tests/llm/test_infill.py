"""Fill-in-middle outputs against a plain Python version, round trips, odd rows and very long texts."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from bylines.llm.infill import infill, parts, restored

TEXTS = [
    None, "", "one line", "a\nb\nc\n", "\n\n\n\n", "no end\nof line", "has <S> a mark\nb", "é\nß\U0001F600x\ny", "$1 \\ $2\n\\1\nend$", "ends <\nP>\n<", "a\r\nb\x0bc\x0cd e\nf", "<P\n>\nS>",
    *(f"row {i}\n" * (i % 7) + "tail" for i in range(60)),
]


def by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    one, two, three, four = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or three % 100 >= 100:
        return len(units), "plain", text, None, None
    a, b = sorted((one % (len(units) + 1), two % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (len(units), "spm", f"<S>{s}<P>{p}<M>{m}", p, m) if four % 100 < 50 else (len(units), "psm", f"<P>{p}<S>{s}<M>{m}", p, m)


def test_outputs_equal_python(spark):
    rows = [(i, t, "x", 5) for i, t in enumerate(TEXTS)] + [(3, "a\nb\nc\n", "x", 5), (None, "k\nl\nm", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n long")  # names that clash with results
    got = infill(df).select("doc_id", "n", "form", "output", parts(F.col("output"), F.col("form")).alias("x"), restored(F.col("output"), F.col("form")).alias("back")).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(((i, *by_hand(i, t), t or "") for i, t, *_ in rows), key=key)
    assert sorted(((r.doc_id, r.n, r.form, r.output, r.x.prefix, r.x.middle, r.back) for r in got), key=key) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table_and_other_ids(spark):
    assert infill(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = infill(spark.createDataFrame([("k", "a\nb\n")], "key string, body string"), "key", "body").head()
    assert got.key == "k" and got.n == 2


def test_marks_are_literal_and_other_units(spark):
    marks = ("$0", "\\1", "[M]")
    df = spark.createDataFrame([(i, "w1 w2  w3 \nw4 w5") for i in range(8)], "doc_id long, text string")
    got = infill(df, unit=r"\S+\s*|\s+", marks=marks).select("n", "output", restored(F.col("output"), F.col("form"), marks).alias("back")).collect()
    assert {r.n for r in got} == {5} and {r.back for r in got} == {"w1 w2  w3 \nw4 w5"} and all("$0" in r.output and "\\1" in r.output for r in got)


@pytest.mark.parametrize("line", ["", "x" * 20])
def test_many_lines_need_no_recursion(spark, line):
    text = f"{line}\n" * 200_000
    got = infill(spark.createDataFrame([(1, text), (2, "y" * 3_000_000)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (got[0].n, got[0].output) == by_hand(1, text)[0:3:2] and got[1].n == 1
