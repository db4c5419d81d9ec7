"""Fill-in-middle transformation: one match of a pattern with counted, possessive units cuts a text in three."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bylines.llm.texts import text_or_empty

LINE = r"[^\n]*\n|[^\n]+"
MARKS = ("<P>", "<S>", "<M>")


def _hash(digest: Column, k: int) -> Column:
    """The k-th group of eight hex digits as an unsigned number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _literal(mark: str) -> str:
    """The mark as a replacement that stands for itself."""
    return re.sub(r"([\\$])", r"\\\1", mark)


def infill(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINE, seed: int = 7, rate: int = 100, spm_rate: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(id, n, form, output) for every row: the text with its middle moved to the end.

    ``unit`` is a pattern whose matches, left to right, make up any text: n are counted, and
    hashes of seed and id choose how many of them the prefix and the middle take. A quantifier
    that counts possessively, ``(?:unit){a}+``, takes them one after another and never goes back,
    so one match captures prefix, middle and suffix in linear time and without recursion, whatever
    the text's length. ``rate`` and ``spm_rate`` are the per cent of texts that are transformed, and
    of those that put the suffix first. Texts that are null, empty or hold a mark stay plain.
    A null id counts as an empty string in the hashes. Repeated rows come out each, alike; an
    empty table gives no rows; other columns are not read.
    """
    p, s, m = (_literal(x) for x in marks)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = df.select(F.col(id_col), F.struct(text_or_empty(text_col).alias("t"), digest.alias("d")).alias("_r"))
    t, d = F.col("_r.t"), F.col("_r.d")
    counted = rows.select(id_col, "_r", F.regexp_count(t, F.lit(unit)).cast("long").alias("n"))
    one, two = (_hash(d, k) % (F.col("n") + 1) for k in (0, 1))
    held = F.lit(False)
    for mark in marks:
        held = held | F.contains(t, F.lit(mark))
    form = F.when((t == "") | held | (_hash(d, 2) % 100 >= rate), "plain").when(_hash(d, 3) % 100 < spm_rate, "spm").otherwise("psm")
    a, b = F.least(one, two), F.greatest(one, two)
    times = lambda n: F.concat(F.lit(f"((?:{unit}){{"), n.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"(?s)\A"), times(a), times(b - a), F.lit(r"(.*)\z"))
    formed = counted.select(id_col, "_r", "n", form.alias("form"), pattern.alias("_p"))
    order = F.when(F.col("form") == "psm", f"{p}$1{s}$3{m}$2").otherwise(f"{s}$3{p}$1{m}$2")
    return formed.select(id_col, "n", "form", F.when(F.col("form") == "plain", t).otherwise(F.regexp_replace(t, F.col("_p"), order)).alias("output"))


def parts(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """struct(prefix, middle, suffix) of an output, nulls if it is plain.

    A transformed text holds no mark of its own, nor can a mark arise where it meets one, as marks
    begin with a character that stands nowhere else in them; so the marks found are those set.
    """
    cut = F.split(output, "|".join(re.escape(x) for x in marks))
    plain, psm = F.lit(None).cast("string"), form == "psm"
    prefix, suffix = F.when(psm, F.get(cut, 1)).otherwise(F.get(cut, 2)), F.when(psm, F.get(cut, 2)).otherwise(F.get(cut, 1))
    return F.when(form != "plain", F.struct(prefix.alias("prefix"), F.get(cut, 3).alias("middle"), suffix.alias("suffix"))).otherwise(
        F.struct(plain.alias("prefix"), plain.alias("middle"), plain.alias("suffix"))
    )


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of."""
    x = parts(output, form, marks)
    return F.when(form == "plain", output).otherwise(F.concat(x["prefix"], x["middle"], x["suffix"]))
