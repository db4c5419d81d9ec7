"""Planned queries: the ladder, claims and names of each run under unique ids, rewrites, and what an analyst may see."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bylines.functions.text import let
from bylines.schemas import KEYWORDS, LOOKED_UP, NON_VERBS, VERB_ENDS
from bylines.scratch import written


WORD = r"[A-Za-z][A-Za-z'\-]*"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def headline_keywords(headline: Column, stopwords: list[str], most: int = KEYWORDS) -> Column:
    """The most telling words of a headline, in reading order: capitalised ones first, then longer, then earlier ones.

    A word counts once, at its first place, whatever its case; words of under three letters and stopwords do not count.
    """

    def of(w: Column) -> Column:
        rows = F.transform(w, lambda x, i: F.struct((~x.rlike("^[A-Z]")).alias("plain"), (-F.length(x)).alias("short"), i.alias("at"), x.alias("word")))
        first = lambda low: F.filter(rows, lambda r: (F.length(r["word"]) >= 3) & ~F.lower(r["word"]).isin(stopwords) & (F.array_position(low, F.lower(r["word"])) == r["at"] + 1))
        good = let(F.transform(w, lambda x: F.lower(x)), first)
        best = F.slice(F.array_sort(good), 1, most)
        return F.transform(F.array_sort(F.transform(best, lambda r: F.struct(r["at"], r["word"]))), lambda r: r["word"])

    return let(_words(headline), of)


def main_verb(text: Column, consumed: Column, stopwords: list[str]) -> Column:
    """The word that most looks like a main verb: the first that ends in -ed or -ing, else the first with another verb's ending; null without any."""

    def rank(w: Column, i: Column) -> Column:
        low = F.lower(w)
        ends = lambda those: reduce(lambda a, b: a | b, [low.endswith(x) for x in those])
        verb = (F.length(low) >= 4) & ends(VERB_ENDS) & ~low.isin(stopwords + NON_VERBS) & ~F.array_contains(consumed, low)
        return F.when(verb, F.struct(F.when(ends(["ed", "ing"]), 0).otherwise(1).alias("r"), i.alias("i"), low.alias("w")))

    return F.array_min(F.transform(_words(text), rank))["w"]


def claim_query(text: Column, entities: Column, stopwords: list[str]) -> Column:
    """Entities that a claim names, its main verb and its numbers; without any of them its first 200 characters."""

    def named(low: Column, e: Column) -> Column:
        quoted = F.regexp_replace(F.lower(e), r"([^\p{L}\p{N}\s])", r"\\$1")
        # a pattern is made for each name and claim, so only for names that stand in the claim at all
        return (F.length(e) >= 2) & F.contains(low, F.lower(e)) & F.regexp_like(low, F.concat(F.lit(r"(?U)(?<!\w)"), quoted, F.lit(r"(?!\w)")))

    found = F.array_distinct(let(F.lower(text), lambda low: F.filter(F.transform(entities, lambda e: F.trim(e)), lambda e: named(low, e))))

    def of(f: Column) -> Column:
        taken = F.flatten(F.transform(f, lambda e: _words(F.lower(e))))
        numbers = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\d[\d,.]*%?"), F.lit(0)))
        every = let(F.array_compact(F.concat(f, F.array(main_verb(text, taken, stopwords)))), lambda parts: F.concat(parts, F.array_except(numbers, parts)))
        return let(every, lambda x: F.when(F.size(x) > 0, F.array_join(x, " ")).otherwise(F.trim(F.left(text, F.lit(200)))))

    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(let(found, of))


def free_ids(wanted: Column) -> Column:
    """``wanted`` ids in order, where one that is taken gets the least of _2, _3... that is not, by ids given before it as they are or with a suffix."""

    def give(taken: Column, want: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(2), F.size(taken) + 2), lambda n: F.concat(want, F.lit("_"), n.cast("string")))
        return F.array_append(taken, F.when(F.array_contains(taken, want), F.get(F.filter(tries, lambda t: ~F.array_contains(taken, t)), 0)).otherwise(want))

    return F.aggregate(wanted, F.array().cast("array<string>"), give)


def date_bounds(start: Column, end: Column, confidence: Column) -> tuple[Column, Column]:
    """Bounds of a search: those of a window of high confidence that are not blank, each for itself."""
    return tuple(F.when(confidence == "high", F.nullif(F.trim(c), F.lit(""))) for c in (start, end))


def query_plan(runs: DataFrame, claims: DataFrame, entities: DataFrame, stopwords: list[str]) -> DataFrame:
    """(run_id, pos, query_id, kind, claim_id, query_text, template_id, attempt, date_from, date_to): all searches of each run.

    ``runs(run_id, headline, date_start, date_end, confidence)``, ``claims(run_id, pos, claim_id, text)`` that were
    selected, ``entities(run_id, pos, text, type)``. First the ladder for the headline, if there is one: the phrase, its words, its keywords;
    then two searches for each claim, for the event and for fact checks; then one for each person, organisation or
    place, each name once by lower case. Ids are unique within a run. Runs without anything to search have no rows; claims without an id are "unknown".
    """
    c = claims.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("pos", "claim_id", "text"))).alias("c"))
    e = entities.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "type"))).alias("e"))
    return plans(runs.join(c.hint("merge"), "run_id", "left").join(e.hint("merge"), "run_id", "left"), stopwords)


def plans(rows: DataFrame, stopwords: list[str]) -> DataFrame:
    """``query_plan`` of runs that hold their claims in an array c(pos, claim_id, text) and their entities in e(pos, text, type), both in order; each plan is made within its row."""
    since, until = date_bounds(F.col("date_start"), F.col("date_end"), F.col("confidence"))
    none = lambda col: F.coalesce(F.col(col), F.array().cast(rows.schema[col].dataType)).alias(col)

    def q(wanted, kind, claim_id, text, template, attempt=1, dated=True) -> Column:
        nothing = F.lit(None).cast("string")
        return F.struct(wanted.alias("query_id"), F.lit(kind).alias("kind"), claim_id.alias("claim_id"), text.alias("query_text"), F.lit(template).alias("template_id"), F.lit(attempt).alias("attempt"), (F.col("since") if dated else nothing).alias("date_from"), (F.col("until") if dated else nothing).alias("date_to"))

    no_claim, head = F.lit(None).cast("string"), F.col("head")
    rows = rows.select("run_id", none("c"), none("e"), F.trim(F.coalesce("headline", F.lit(""))).alias("head"), since.alias("since"), until.alias("until"))
    by_words = let(headline_keywords(head, stopwords), lambda keys: F.when((head != "") & (F.size(keys) > 0), q(F.lit("q_exist_3"), "existence", no_claim, F.array_join(keys, " "), "exist_keyword", 3)))
    ladder = F.array_compact(F.array(
        F.when(head != "", q(F.lit("q_exist_1"), "existence", no_claim, F.concat(F.lit('"'), head, F.lit('"')), "exist_exact", 1)), F.when(head != "", q(F.lit("q_exist_2"), "existence", no_claim, head, "exist_loose", 2)), by_words,
    ))

    def of_claim(x: Column, names: Column) -> Column:
        claim_id, text = F.coalesce(F.nullif(x["claim_id"], F.lit("")), F.lit("unknown")), F.coalesce(x["text"], F.lit(""))
        return F.array(
            q(F.concat(F.lit("q_claim_"), claim_id), "claim", claim_id, claim_query(text, names, stopwords), "claim_event"),
            q(F.concat(F.lit("q_fc_"), claim_id), "factcheck", claim_id, F.trim(F.left(text, F.lit(200))), "factcheck", dated=False),
        )

    of_claims = let(F.transform("e", lambda x: x["text"]), lambda names: F.flatten(F.transform("c", lambda x: of_claim(x, names))))
    looked = F.filter(F.transform("e", lambda x: F.struct(F.trim(x["text"]).alias("text"), x["type"].alias("type"))), lambda x: x["type"].isin(LOOKED_UP) & (x["text"] != ""))
    by_name = F.array_sort(F.transform(looked, lambda x, i: F.struct(F.lower(x["text"]).alias("low"), i.alias("i"), x["text"])))
    first = let(by_name, lambda s: F.filter(s, lambda x, i: ~x["low"].eqNullSafe(F.get(s, i - 1)["low"])))
    once = F.array_sort(F.transform(first, lambda x: F.struct(x["i"], x["text"])))
    of_names = F.transform(once, lambda x, i: q(F.concat(F.lit("q_entity_"), i.cast("string")), "entity", no_claim, x["text"], "entity_lookup", dated=False))
    wanted = lambda a: F.transform(a, lambda x: x["query_id"])
    plan = rows.select("run_id", ladder.alias("l"), of_claims.alias("m"), of_names.alias("n"))
    # the three kinds begin otherwise, and only claims can want an id twice
    given = plan.select("run_id", F.concat("l", "m", "n").alias("p"), F.concat(wanted("l"), free_ids(wanted("m")), wanted("n")).alias("ids"))
    return given.select("run_id", F.posexplode(F.arrays_zip("p", "ids")).alias("pos", "x")).select("run_id", "pos", F.col("x.ids").alias("query_id"), *[f"x.p.{n}" for n in ("kind", "claim_id", "query_text", "template_id", "attempt", "date_from", "date_to")])


def accept_rewrites(plan: DataFrame, rewritten: DataFrame) -> DataFrame:
    """A run's rewritten texts only if all of them are there, in the same order with the same ids and not blank; else its plan as it was.

    Both have run_id, pos, query_id, template_id and query_text.
    """
    new = rewritten.select("run_id", "pos", F.col("query_id").alias("q"), F.col("template_id").alias("t"), F.col("query_text").alias("x"))
    met = written(plan.join(new, ["run_id", "pos"], "full"))
    good = F.coalesce((F.col("q") == F.col("query_id")) & F.col("t").eqNullSafe(F.col("template_id")) & (F.trim("x") != ""), F.lit(False))
    fine = written(met.groupBy("run_id").agg(F.bool_and(good).alias("accepted")))
    return met.where("query_id IS NOT NULL").join(fine, "run_id").select("run_id", "pos", "query_id", "template_id", F.when(F.col("accepted"), F.col("x")).otherwise(F.col("query_text")).alias("query_text"), "accepted")


def blinded(evidence: DataFrame) -> DataFrame:
    """The only columns an analyst sees; a snippet stops at 500 characters, and scores, labels, wires and merges stay out."""
    return evidence.select("run_id", "source_id", F.col("publisher_id").alias("outlet"), F.col("published_at").alias("date"), "url", "title", F.left("snippet", F.lit(500)).alias("snippet"))
