"""Quotes located in articles: exactly, or once more on normalised text with places in the raw one; and which input they came from."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bylines.schemas import LIKE_ASCII

SEPARATOR = "\n\n"
_SPECIAL = re.compile(r"\s{2,}|[^\S ]|[^\x00-\x7f]")  # what normal text may not be made of as it stands
QUOTES = 1000  # of a run that meet its text in one row
TEXTS = 200  # that a task normalises and looks through at once
_FOLD = str.maketrans(LIKE_ASCII)


@cache
def _form(c: str) -> str:
    """The normal form of a character that is not white space."""
    return unicodedata.normalize("NFKC", c.translate(_FOLD))


class NormalText:
    """A text with ASCII quotes and dashes, compatibility forms and single spaces, that knows where its characters came from.

    Raw text between special characters is carried over in runs, single blanks and characters in normal form with it, so the map
    holds one entry for each run; a character that normalises to several has a run for them all.
    """

    def __init__(self, raw: str):
        parts, self.at, self.raw_at, self.step, out, last = [], [], [], [], 0, 0

        def add(s: str, start: int, step: int) -> None:
            nonlocal out
            if s:
                self.at.append(out)
                self.raw_at.append(start)
                self.step.append(step)
                parts.append(s)
                out += len(s)

        for m in _SPECIAL.finditer(raw):
            c = m[0]
            form = " " if c.isspace() else _form(c)
            if form == c:
                continue
            add(raw[last : m.start()], last, 1)
            last = m.end()
            add(form, m.start(), 0)
        add(raw[last:], last, 1)
        self.text = "".join(parts)

    def raw_place(self, i: int) -> int:
        """Where the character came from that has place i here."""
        k = bisect_right(self.at, i) - 1
        return self.raw_at[k] + self.step[k] * (i - self.at[k])

    def locate(self, quote: str) -> tuple[int, int] | None:
        """(start, end) in the raw text of the first passage that is the quote, given in normal form."""
        found = self.text.find(quote) if quote else -1
        return None if found < 0 else (self.raw_place(found), self.raw_place(found + len(quote) - 1) + 1)


def normal(text: str) -> str:
    return NormalText(text).text


def locate_quotes(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """``quotes(run_id, claim_id, source_quote, ...)`` with start, end and grounding in ``texts(run_id, text)``.

    A quote, trimmed, that stands in the text as it is is ``exact``, at its first place; that is found by
    built-in functions. A run's quotes meet its text in one row, or in one for each QUOTES of them, and only texts some quote of
    which is not exact go to Python, where each is normalised once for all of the row: ``normalised`` has the raw places of the passage. All others are ``not_found``, null,
    empty and blank quotes and those of runs without a text too; nothing is matched approximately
    and no quote is dropped. Texts are one for each run. An empty table gives no rows.
    """
    blanks = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    # what stands around a quote is cut by pattern, as trim() only knows listed characters
    needle = F.regexp_replace(F.coalesce("source_quote", F.lit("")), f"^[{re.escape(blanks)}]+|[{re.escape(blanks)}]+$", "")
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("claim_id"))
    dealt = quotes.select("run_id", F.struct(F.struct(*quotes.columns).alias("row"), needle.alias("q")).alias("_x"), F.floor(place / QUOTES).alias("_part"))
    of_run = dealt.groupBy("run_id", "_part").agg(F.collect_list("_x").alias("_quotes"))
    met = of_run.join(texts.select(F.col("run_id").alias("_run"), F.col("text").alias("_text")).hint("merge"), F.col("run_id").eqNullSafe(F.col("_run")), "left")
    at = lambda x: F.when(x["q"] != "", F.coalesce(F.instr("_text", x["q"]), F.lit(0)))
    told = met.select(F.transform("_quotes", lambda x: F.struct(x["row"].alias("row"), x["q"].alias("q"), at(x).alias("at"))).alias("_quotes"), "_text")
    sought = told.select("_quotes", F.when(F.exists("_quotes", lambda x: F.coalesce(x["at"] == 0, F.lit(False))), F.col("_text")).alias("_text"))
    schema = T.StructType(list(quotes.schema.fields)).add("start", "integer").add("end", "integer").add("grounding", "string")
    arrow = to_arrow_schema(schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, TEXTS):
                b = whole.slice(begin, TEXTS)
                rows, q, at = b.column(0).flatten().flatten()
                needles, places = iter(q.to_pylist()), iter(at.to_pylist())
                starts, ends, how = [], [], []
                for text, n in zip(b.column(1).to_pylist(), pc.list_value_length(b.column(0)).to_pylist(), strict=True):
                    normal_text = None
                    for needle, place in islice(zip(needles, places), n):
                        found, kind = None, "not_found"
                        if place:
                            found, kind = (place - 1, place - 1 + len(needle)), "exact"
                        elif needle and text:
                            normal_text = normal_text or NormalText(text)
                            found = normal_text.locate(normal(needle).strip())
                            kind = "normalised" if found else kind
                        start, end = found or (None, None)
                        starts.append(start)
                        ends.append(end)
                        how.append(kind)
                yield pa.RecordBatch.from_arrays([*rows.flatten(), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(how, pa.string())], schema=arrow)

    return sought.mapInArrow(apply, schema)


def attribute_spans(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """``spans(run_id, claim_id, start, end, ...)`` with claim_source: the input whose segments the span lies in, ``spans_both``, or null.

    ``segments(run_id, source, start, end)`` tile a run's text. A claim without a place and a run without segments
    have no source. Repeated rows come out each.
    """
    s = segments.select(F.col("run_id").alias("s_run"), F.col("source").alias("s_source"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    by_run = s.groupBy("s_run").agg(F.collect_set(F.struct("s_source", "s_start", "s_end")).alias("_segments"))  # a run has as many segments as inputs
    met = spans.join(by_run.hint("merge"), F.col("run_id") == F.col("s_run"), "left")
    inside = F.filter("_segments", lambda x: (x["s_start"] < F.col("end")) & (F.col("start") < x["s_end"]))
    kinds = F.array_distinct(F.transform(inside, lambda x: x["s_source"]))
    return met.withColumn("claim_source", F.when(F.size(kinds) == 1, F.get(kinds, 0)).when(F.size(kinds) > 1, "spans_both")).drop("s_run", "_segments")


def compared(text: str) -> str:
    """The form in which a paste is looked for in a fetched body: normal, case folded, trimmed."""
    return " ".join(unicodedata.normalize("NFKC", text).translate(_FOLD).casefold().split())


def merge_inputs(inputs: DataFrame, pasted: str = "pasted", fetched: str = "fetched") -> DataFrame:
    """Other columns of ``inputs`` with text and segments array<struct<source, start, end>>: pasted text before fetched text.

    A paste whose compared form stands in that of the fetched body is dropped. Two texts are
    joined by an empty line, which belongs to the first segment, so segments tile the text. Null counts
    as empty, and without either the text is empty and has no segments. Python only sees texts that
    built-in functions cannot tell: of ASCII bodies that hold the paste as it is, it gets none.
    """
    kept = [c for c in inputs.columns if c not in (pasted, fetched)]
    p, f = (F.coalesce(F.col(c), F.lit("")) for c in (pasted, fetched))

    @F.udf("boolean", useArrow=True)
    def inside(part: str, whole: str) -> bool:
        return compared(part) in compared(whole)

    rows = inputs.select(*kept, F.struct(p.alias("p"), f.alias("f"), ((p != "") & (f != "")).alias("two")).alias("_x"))
    told = rows.withColumn("_in", F.when(~F.col("_x.two"), False).when((F.octet_length("_x.f") == F.char_length("_x.f")) & F.contains("_x.f", "_x.p"), True))
    asked = told.withColumn("_in", F.coalesce("_in", inside(F.when(F.col("_in").isNull(), F.col("_x.p")).otherwise(""), F.when(F.col("_in").isNull(), F.col("_x.f")).otherwise(""))))
    a, b = F.when(F.col("_in"), F.lit("")).otherwise(F.col("_x.p")), F.col("_x.f")
    gap = F.when((a != "") & (b != ""), F.lit(SEPARATOR)).otherwise("")
    text, cut = F.concat(a, gap, b), F.char_length(a) + F.char_length(gap)
    segment = lambda source, start, end: F.struct(F.lit(source).alias("source"), start.cast("int").alias("start"), end.cast("int").alias("end"))
    found = F.array(F.when(a != "", segment("pasted", F.lit(0), cut)), F.when(b != "", segment("fetched", cut, F.char_length(text))))
    return asked.select(*kept, text.alias("text"), F.array_compact(found).alias("segments"))


def segment_text(text: Column, segments: Column, source: str) -> Column:
    """The parts of a merged text that came from one input."""
    own = F.filter(segments, lambda s: s["source"] == source)
    return F.array_join(F.transform(own, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])), "")
