"""Claims and entities: extraction, grounding, scoring, selection and reconciliation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bylines.functions.text import let
from bylines.schemas import MAX_CLAIMS, NUMERIC_BY_LETTER


SENTENCE, SENTENCE_END = r"[^.?!]+[.?!]*|[.?!]+", r"^[.?!]"
LINE, NO_END = r"[^\n]*\n|[^\n]+", r"^\z."
_BLANK = r"[\s\x1c-\x1f]"
NAME = r"[A-Z][a-z]++(?: [A-Z][a-z]++)++"  # runs of capitalised words; possessive, as a long run would take the whole stack otherwise
FALLBACK_CHARS = 400


def stripped(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, rf"(?U)\A{_BLANK}++|(?<!{_BLANK}){_BLANK}++\z", "")


def _lead(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, rf"(?U)\A{_BLANK}++", ""))


def _or_whole(found: Column, text: Column, start: Column) -> Column:
    """The passages found, or the first FALLBACK_CHARS of a text that is not blank and has none."""
    whole = stripped(text)
    return F.when((F.size(found) > 0) | (whole == ""), found).otherwise(F.array(F.struct(F.left(whole, F.lit(FALLBACK_CHARS)).alias("quote"), start.alias("start"))))


def sentences(docs: DataFrame, id_col: str, text_col: str, most: int = MAX_CLAIMS, longer_than: int = 40, token: str = SENTENCE, skip: str = SENTENCE_END) -> DataFrame:
    """(id, claim_id, claim, start, end, quote): the first ``most`` passages above a length, with their places in the raw text.

    ``token`` cuts the text into passages without a gap, so their running length is their place; those that
    match ``skip`` are none. A text that is not blank and has no long passage is one claim of its first
    characters. ``claim`` is the quote cut to as many. All is told within the row, whatever the text's length.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<quote:string,start:int>>")

    def step(x: Column, t: Column) -> Column:
        own = stripped(t)
        good = (F.size(x["out"]) < most) & (F.char_length(t) > longer_than) & ~t.rlike(skip) & (F.char_length(own) > longer_than)
        found = F.struct(own.alias("quote"), (x["at"] + _lead(t)).alias("start"))
        return F.struct((x["at"] + F.char_length(t)).alias("at"), F.when(good, F.array_append(x["out"], found)).otherwise(x["out"]).alias("out"))

    cut = F.aggregate(F.regexp_extract_all(text, F.lit(token), F.lit(0)), F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
    rows = docs.select(F.col(id_col).alias("id"), text.alias("_t"), cut.alias("_c")).select("id", F.posexplode(_or_whole(F.col("_c"), F.col("_t"), _lead(F.col("_t")))).alias("n", "x"))
    quote, start = F.col("x.quote"), F.col("x.start")
    return rows.select("id", F.concat(F.lit("c"), (F.col("n") + 1).cast("string")).alias("claim_id"), F.left(quote, F.lit(FALLBACK_CHARS)).alias("claim"), start, (start + F.char_length(quote)).alias("end"), quote.alias("quote"))


def every_sentence(docs: DataFrame, id_col: str, text_col: str, longer_than: int = 40, in_row: bool = False) -> DataFrame:
    """(id, claim_id, pos, claim): all sentences above a length, or the start of a text without any; ids count all passages.

    With ``in_row``, the columns of ``docs`` and ``sentences``, an array of (claim_id, pos, claim) in order.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda t, i: F.struct(F.when(~t.rlike(SENTENCE_END), stripped(t)).alias("quote"), i.alias("start")))
    found = let(F.filter(cut, lambda x: F.char_length(x["quote"]) > longer_than), lambda found: _or_whole(found, text, F.lit(0)))
    row = lambda x: (F.concat(F.lit("c"), (x["start"] + 1).cast("string")).alias("claim_id"), x["start"].alias("pos"), F.left(x["quote"], F.lit(FALLBACK_CHARS)).alias("claim"))
    if in_row:
        return docs.select("*", F.transform(found, lambda x: F.struct(*row(x))).alias("sentences"))
    return docs.select(F.col(id_col).alias("id"), F.explode(found).alias("x")).select("id", *row(F.col("x")))


def entities(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, entity, mentions, first): runs of two or more capitalised ASCII words, by lower-cased text, first spelling kept."""
    found = docs.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(text_col, F.lit(NAME), F.lit(0))).alias("pos", "t"))
    return found.groupBy("id", F.lower("t").alias("entity")).agg(F.count(F.lit(1)).alias("mentions"), F.min_by("t", "pos").alias("first"))


def merge_entities(a: DataFrame, b: DataFrame, most: int = 30) -> DataFrame:
    """(id, entity, text, source): two extractors' (id, text, pos) by lower-cased text; the first spelling wins, A before B, and at most ``most`` for each id."""
    both = a.select("id", "text", "pos", F.lit("a").alias("who")).union(b.select("id", "text", "pos", F.lit("b").alias("who")))
    order = F.struct("who", "pos")
    met = both.groupBy("id", F.lower("text").alias("entity")).agg(F.min_by("text", order).alias("text"), F.when(F.countDistinct("who") == 2, "both").otherwise(F.min("who")).alias("source"), F.min(order).alias("o"))
    return met.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("o"))).where(F.col("n") <= most).drop("o", "n")


def ground(text: Column, quote: Column) -> Column:
    """struct(start, end, grounding): where the quote stands in the text, exactly or not at all."""
    at = F.instr(text, quote)
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.struct((at - 1).alias("start"), (at - 1 + F.char_length(quote)).alias("end"), F.lit("exact").alias("grounding"))).otherwise(
        F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit("not_found").alias("grounding"))
    )


def search_score(text: Column, mentions: Column, kind: Column, grounding: Column, agreement: Column, checkworthy: Column) -> Column:
    """How searchable a claim is: entity and number 2 each, fact 1 or opinion -3, grounded, agreed and checkworthy 1 each."""
    on = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0)
    return on(mentions, 2) + on(text.rlike(NUMERIC_BY_LETTER), 2) + F.when(kind == "fact", 1).when(kind == "opinion", -3).otherwise(0) + on(grounding == "exact", 1) + on(agreement == "both", 1) + on(checkworthy, 1)


def natural_key(text: Column) -> Column:
    """Sorts c2 before c10: digit runs compare as numbers and after letters."""
    parts = F.regexp_extract_all(text, F.lit(r"\d+|\D+"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(p.rlike(r"^\d").alias("digits"), F.coalesce(p.try_cast("long"), F.lit(0)).alias("n"), p.alias("s")))


def select_claims(scored: DataFrame, k: int = MAX_CLAIMS) -> DataFrame:
    """Add rank and selected to (run_id, claim_id, pos, score): the top ``k`` of score 0 or more; all others are kept as skipped."""
    w = Window.partitionBy("run_id").orderBy(F.col("score").desc(), natural_key(F.col("claim_id")), "pos")
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return ranked.withColumn("selected", (F.col("rank") <= k) & (F.col("score") >= 0))


def best_claims(sentences: Column, score: Callable[[Column], Column], k: int = MAX_CLAIMS) -> Column:
    """``select_claims`` within a row: the selected ones of an array of (claim_id, pos, claim), as (pos, claim_id, text) by rank, which is pos; ids follow places."""
    scored = F.transform(sentences, lambda x: F.struct((-score(x["claim"])).alias("less"), x["pos"], x["claim_id"], x["claim"]))
    best = F.filter(F.slice(F.array_sort(scored), 1, k), lambda x: x["less"] <= 0)
    return F.transform(best, lambda x, i: F.struct((i + 1).alias("pos"), x["claim_id"].alias("claim_id"), x["claim"].alias("text")))


def check_worthy(claims: DataFrame) -> DataFrame:
    """Check-worthy claims of each run, or all of a run that has none."""
    any_ = F.max(F.coalesce(F.col("checkworthy"), F.lit(False)).cast("int")).over(Window.partitionBy("run_id"))
    return claims.withColumn("_any", any_).where((F.col("_any") == 0) | F.col("checkworthy")).drop("_any")
