"""Text expressions of the evidence jobs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from bylines.schemas import SHINGLE_WORDS, WIRES


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """ASCII words of the lower-cased text; null counts as empty."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def shingle_set(seq: Column, n: int = SHINGLE_WORDS) -> Column:
    """Distinct hashes of runs of ``n`` words; a shorter sequence is one shingle, an empty one has none."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)])))
        short = F.when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
        return F.array_distinct(F.when(F.size(w) >= n, runs).otherwise(short))

    return let(seq, of)


def normal_title(title: Column) -> Column:
    return F.array_join(words(title), " ")


def body_hash(text: Column) -> Column:
    """sha256 of the lower-cased text with white space collapsed, first 32 digits; null for blank texts."""
    flat = F.trim(F.regexp_replace(F.lower(text), r"(?: [\s\x0B]|[\t-\r])[\s\x0B]*+", " "))  # single blanks stay as they are
    return F.when(F.length(flat) > 0, F.concat(F.lit("sha256:"), F.left(F.sha2(flat, 256), F.lit(32))))


def wire_credit(byline: Column, snippet: Column) -> Column:
    """The first wire service, longer names first, that stands as a word in byline or snippet."""
    both = F.concat_ws(" ", byline, snippet)
    return F.coalesce(*[F.when(both.rlike(rf"(?iU)(?<!\w){name}(?!\w)"), F.lit(name)) for name in sorted(WIRES, key=lambda w: -len(w))])


def long_words(text: Column) -> Column:
    """Distinct lower-case words of more than two characters between blanks, punctuation kept."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.char_length(w) > 2))


def first_that(rules: list[tuple[Column, str]], otherwise: str | Column) -> Column:
    """The value of the first rule that holds."""
    last = F.lit(otherwise) if isinstance(otherwise, str) else otherwise
    return reduce(lambda c, r: c.when(r[0], F.lit(r[1])), rules, F).otherwise(last)
