"""Risk rules, verification records and the claim by source matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bylines.functions.text import first_that


def publication_risk(state: Column) -> Column:
    return first_that([(state.isin("corroborated_coverage", "event_corroborated"), "low"), (state == "single_source", "moderate"), (state == "not_assessed", "unknown")], "high")


def recommendation(state: Column) -> Column:
    """The decision that rules propose to an editor; none of them says that a claim is false."""
    return first_that([(state.isin("corroborated_coverage", "event_corroborated"), "verified"), (state.isin("contested", "contested_reporting", "single_source", "not_assessed"), "needs_investigation")], "unverifiable")


def risk_rules(states: DataFrame, counts: DataFrame, rates: DataFrame, existence: DataFrame) -> DataFrame:
    """One row for each run: recommendation, risk, and the named unknowns; none of them says that a claim is false."""
    row = states.join(counts, "run_id", "left").join(rates, "run_id", "left").join(existence, "run_id", "left")
    unknown = F.filter(F.array(
        F.when(F.col("existence") == "out_of_range", F.lit("search_never_ran")), F.when(F.col("existence") == "not_found", F.lit("article_not_found_elsewhere")),
        F.when(F.col("unassessed") > 0, F.lit("claims_not_assessed")), F.when(F.col("support_pct").isNull(), F.lit("no_support_rate")),
        F.when(F.col("independent_source_count") <= 1, F.lit("at_most_one_newsroom")), F.when(F.col("republished") > 0, F.lit("pages_republish_each_other")),
        F.when(F.col("contested") > 0, F.lit("claims_contested")), F.lit("contradiction_not_detectable"),
    ), lambda x: x.isNotNull())
    return row.select("run_id", "state", recommendation(F.col("state")).alias("recommendation"), publication_risk(F.col("state")).alias("risk"), unknown.alias("unknowns"))


def claim_source_matrix(pairs: DataFrame, sources: list[str]) -> DataFrame:
    """claim by publisher: the best score of a non-neutral pair with its sign, 0 where nothing stands; publishers are a given list."""
    signed = F.when(F.col("label") == "entailment", F.col("score")).when(F.col("label") == "contradiction", -F.col("score")).otherwise(0.0)
    return pairs.groupBy("claim").pivot("publisher_id", sources).agg(F.max_by(signed, F.struct(F.abs(signed), signed))).fillna(0.0)


def verification_record(runs: DataFrame, counts: DataFrame, rates: DataFrame, summary: DataFrame, most: int = 8) -> DataFrame:
    """One text record for each run: counts, at most ``most`` source lines in order of name, the support sentence, and one citation for each source."""
    lines = summary.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("source", "evidence", "members"))).alias("s"))
    row = runs.select("run_id").join(counts, "run_id", "left").join(rates, "run_id", "left").join(lines, "run_id", "left")
    listed = F.array_join(F.transform(F.slice(F.coalesce("s", F.array().cast("array<struct<source:bigint,evidence:string,members:bigint>>")), 1, most), lambda x: F.concat(x["evidence"], F.lit(" ("), x["members"].cast("string"), F.lit(")"))), "; ")
    rate = F.when(F.col("support_pct").isNull(), F.concat(F.lit("No support rate: "), F.coalesce("omitted_because", F.lit("no_claims")))).otherwise(F.concat(F.col("support_pct").cast("string"), F.lit("% of "), F.col("scored").cast("string"), F.lit(" scored claims are backed by independent reporting")))
    head = F.concat(F.coalesce("document_count", F.lit(0)).cast("string"), F.lit(" pages, "), F.coalesce("independent_source_count", F.lit(0)).cast("string"), F.lit(" independent sources"))
    return row.select("run_id", head.alias("evidence_summary"), listed.alias("source_assessment"), rate.alias("support_sentence"), F.coalesce(F.size("s"), F.lit(0)).alias("citations"))
