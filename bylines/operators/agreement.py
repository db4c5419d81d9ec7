"""Two claim extractions of one article reconciled by where their claims stand, with labels merged and nothing lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bylines.schemas import LABELS, OVERLAP
from bylines.scratch import written

BIN = 1024  # characters


def _spans(claims: DataFrame, side: str) -> DataFrame:
    """Places of grounded claims, once for each stretch of BIN characters that they touch."""
    known = claims.where("start IS NOT NULL AND `end` > start AND NOT coalesce(grounding = 'not_found', false)")
    bins = F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("end") - 1) / BIN))
    return known.select("run_id", F.col("i").alias(side), F.col("start").alias(f"start_{side}"), F.col("end").alias(f"end_{side}"), F.explode(bins).alias("bin"))


def span_candidates(a: DataFrame, b: DataFrame, least: float = OVERLAP) -> DataFrame:
    """(run_id, i, j, overlap): claims of two passes within a run whose spans share ``least`` of the shorter one.

    An interval join by stretches of text: spans meet in the first stretch that both touch, so a
    run with many claims compares neighbours only. Claims without a place match nothing.
    """
    x, y = _spans(a, "i"), _spans(b, "j")
    shared = F.least("end_i", "end_j") - F.greatest("start_i", "start_j")
    ratio = shared / F.least(F.col("end_i") - F.col("start_i"), F.col("end_j") - F.col("start_j"))
    met = x.hint("merge").join(y, ["run_id", "bin"]).where((F.floor(F.greatest("start_i", "start_j") / BIN) == F.col("bin")) & (shared > 0))
    return met.select("run_id", "i", "j", ratio.alias("overlap")).where(F.col("overlap") >= least)


def greedy_pairs(candidates: DataFrame) -> DataFrame:
    """(run_id, i, j, overlap): what taking candidates one by one gives, best overlap first, then by i and j, each end once.

    A candidate that is the best of both its ends is taken whatever else is, so each round takes all
    of these and drops what they exclude. The best candidate of a run always is one, and rounds grow
    with the longest chain of ever better rivals, not with the number of claims.
    """
    left, taken = written(candidates), []
    while not left.isEmpty():
        by_i = left.groupBy("run_id", "i").agg(F.min(F.struct(-F.col("overlap"), "j")).alias("x")).select("run_id", "i", F.col("x.j").alias("j"))
        by_j = left.groupBy("run_id", "j").agg(F.min(F.struct(-F.col("overlap"), "i")).alias("y")).select("run_id", F.col("y.i").alias("i"), "j")
        both = written(left.join(by_i.join(by_j.hint("merge"), ["run_id", "i", "j"]).hint("merge"), ["run_id", "i", "j"], "left_semi"))
        taken.append(both)
        left = written(left.join(both.select("run_id", "i").hint("merge"), ["run_id", "i"], "left_anti").join(both.select("run_id", "j").hint("merge"), ["run_id", "j"], "left_anti"))
    out = candidates.limit(0)
    for part in taken:
        out = out.union(part)
    return out


def merged_kind(a: Column, b: Column) -> Column:
    """The label that both or one of the passes gave; two that differ make it unclear, and none leaves it unspecified."""
    x, y = (F.when(c.isin(*LABELS), c) for c in (a, b))
    return F.when(x != y, "unclear").otherwise(F.coalesce(x, y, F.lit("unspecified")))


def merge_passes(a: DataFrame, b: DataFrame, model_a: str, model_b: str) -> DataFrame:
    """(run_id, claim_id, text, kind, source_quote, grounding, start, end, agreement, agreement_note, variant_texts).

    ``a`` and ``b`` hold (run_id, i, claim_id, text, kind, source_quote, grounding, start, end), where i
    orders a run's claims. Matched claims become one, in the words of the pass that quotes exactly, else of
    pass A; claims of one pass stay and say so. Ids are c1, c2... by place, claims without a place last.
    A run with claims in one pass only keeps them; no claims give no rows. Null labels count as none given.
    """
    pairs = written(greedy_pairs(written(span_candidates(a, b))))
    fields = ["claim_id", "text", "kind", "source_quote", "grounding", "start", "end"]
    row = lambda d, i, name: d.select("run_id", F.col("i").alias(i), F.struct(*fields).alias(name))
    x, y = row(a, "i", "x"), row(b, "j", "y")
    met = pairs.join(x.hint("merge"), ["run_id", "i"]).join(y.hint("merge"), ["run_id", "j"])
    alone_a = x.join(pairs.select("run_id", "i").hint("merge"), ["run_id", "i"], "left_anti")
    alone_b = y.join(pairs.select("run_id", "j").hint("merge"), ["run_id", "j"], "left_anti")
    exact = lambda c: F.coalesce(F.col(f"{c}.grounding") == "exact", F.lit(False))
    ka, kb = F.col("x.kind"), F.col("y.kind")
    differ = F.when(ka.isin(*LABELS) & kb.isin(*LABELS) & (ka != kb), F.format_string("; passes disagreed on label (%s vs %s), recorded as unclear", ka, kb)).otherwise("")
    both = met.select(
        "run_id", F.lit(0).alias("part"), (-F.col("overlap")).alias("o"), "i", "j", F.when(exact("y") & ~exact("x"), F.col("y")).otherwise(F.col("x")).alias("w"), merged_kind(ka, kb).alias("kind"), F.lit("both").alias("agreement"),
        F.concat(F.lit(f"both passes ({model_a}, {model_b}) extracted this span"), differ).alias("note"), F.array("x.text", "y.text").alias("variants"),
    )

    def single(d: DataFrame, name: str, part: int, which: str, model: str) -> DataFrame:
        lost = F.lit(f"only pass {which} ({model}) produced this claim, and its quote is not in the article, so it cannot be span-matched — lower confidence, not disproved")
        seen = F.lit(f"only pass {which} ({model}) extracted this span — lower extraction confidence, not evidence the claim is wrong")
        at = F.col("i" if name == "x" else "j")
        none = F.lit(None).cast(at_type)
        return d.select(
            "run_id", F.lit(part).alias("part"), F.lit(0.0).alias("o"), (at if name == "x" else none).alias("i"), (none if name == "x" else at).alias("j"), F.col(name).alias("w"), F.col(f"{name}.kind").alias("kind"),
            F.lit(f"pass_{which.lower()}_only").alias("agreement"), F.when(F.col(f"{name}.grounding") == "not_found", lost).otherwise(seen).alias("note"), F.array(f"{name}.text").alias("variants"),
        )

    at_type = a.schema["i"].dataType
    every = both.union(single(alone_a, "x", 1, "A", model_a)).union(single(alone_b, "y", 2, "B", model_b))
    place = Window.partitionBy("run_id").orderBy(F.col("w.start").asc_nulls_last(), "w.claim_id", "part", "o", "i", "j")
    return every.select(
        "run_id", F.concat(F.lit("c"), F.row_number().over(place).cast("string")).alias("claim_id"), "w.text", "kind", "w.source_quote", "w.grounding", "w.start", "w.end", "agreement", F.col("note").alias("agreement_note"), F.col("variants").alias("variant_texts"),
    )


def agreement_rates(merged: DataFrame) -> DataFrame:
    """(run_id, claims, agreed, agreement_rate): the share of claims that both passes have, to four places."""
    out = merged.groupBy("run_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("agreement") == "both").alias("agreed"))
    return out.withColumn("agreement_rate", F.bround(F.col("agreed") / F.col("claims"), 4))
