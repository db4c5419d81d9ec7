"""What an analyst sends back, validated against what the analyst was shown: rows, rejects, dropped ids, stances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bylines.schemas import SLOTS

ROW = "claim_id string, supported_by array<string>, contradicted_by array<string>, unrelated array<string>, inconsistencies array<string>, missing_slots array<string>"
INCONSISTENCY = "slot string, summary string, source_ids array<string>"
LISTS = ("supported_by", "contradicted_by", "unrelated")


def _is_object(json: Column) -> Column:
    return F.coalesce(F.ltrim(json).startswith("{"), F.lit(False))


def _listed(c: Column) -> Column:
    return F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def take_in(outputs: DataFrame, shown: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of ``outputs(run_id, payload)``, one JSON text for each run, against ``shown(run_id, source_id)``.

    rows(run_id, pos, claim_id, supported_by, contradicted_by, unrelated, inconsistencies, missing_slots, dropped_ids, dropped): ids that were not
    shown are dropped and kept apart, each once, and counted as often as they were named; an unknown slot counts as "other".
    rejects(run_id, pos, raw, reason): payloads without a list of claims, with pos -1, and entries that are no objects. Nothing is lost
    in silence. A run that was shown nothing keeps no ids. What was shown to a run is a window of documents and is held by its rows.
    """
    said = outputs.select("run_id", "payload", F.from_json("payload", "claims array<string>")["claims"].alias("c"))
    bad = said.where(F.col("c").isNull()).select("run_id", F.lit(-1).alias("pos"), F.col("payload").alias("raw"), F.lit("no list of claims").alias("reason"))
    each = said.select("run_id", F.posexplode("c").alias("pos", "raw"))
    odd = each.where(~_is_object(F.col("raw"))).select("run_id", "pos", "raw", F.lit("no object").alias("reason"))
    windows = shown.groupBy("run_id").agg(F.collect_set("source_id").alias("ids"))
    met = each.where(_is_object(F.col("raw"))).select("run_id", "pos", F.from_json("raw", ROW).alias("r")).join(windows.hint("merge"), "run_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    known = lambda c: F.filter(c, lambda x: F.array_contains("ids", x))
    other = lambda c: F.filter(c, lambda x: ~F.array_contains("ids", x))
    objects = F.filter(F.coalesce("r.inconsistencies", F.array().cast("array<string>")), lambda x: _is_object(x))
    parsed = met.withColumn("i", F.transform(objects, lambda x: F.from_json(x, INCONSISTENCY)))
    slots = F.transform("i", lambda x: F.struct(F.when(x["slot"].isin(SLOTS), x["slot"]).otherwise("other").alias("slot"), F.coalesce(x["summary"], F.lit("")).alias("summary"), known(_listed(x["source_ids"])).alias("source_ids")))
    lost = F.concat(*[other(_listed(F.col(f"r.{c}"))) for c in LISTS], F.flatten(F.transform("i", lambda x: other(_listed(x["source_ids"])))))
    rows = parsed.select(
        "run_id", "pos", F.coalesce("r.claim_id", F.lit("")).alias("claim_id"), *[known(_listed(F.col(f"r.{c}"))).alias(c) for c in LISTS], slots.alias("inconsistencies"),
        F.coalesce("r.missing_slots", F.array().cast("array<string>")).alias("missing_slots"), F.array_distinct(lost).alias("dropped_ids"), F.size(lost).alias("dropped"),
    )
    return rows, bad.union(odd)


def participated(rows: DataFrame) -> DataFrame:
    """Rows that say something of a document that was shown; others are no answer, not an answer of nothing."""
    return rows.where(F.size("supported_by") + F.size("contradicted_by") + F.size("unrelated") > 0)


def attach_stances(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``pairs(run_id, claim_id, source_id, ...)`` with analyst_stance: supports, refutes, unrelated, or null where nothing was said.

    Within a row refutes beats supports and a later row beats an earlier one; unrelated only stands where neither is said.
    """
    kind = lambda c, rank, name: F.transform(c, lambda x: F.struct(x.alias("source_id"), F.lit(rank).alias("rank"), F.lit(name).alias("stance")))
    each = participated(rows).select("run_id", "claim_id", "pos", F.explode(F.concat(kind("unrelated", 0, "unrelated"), kind("supported_by", 1, "supports"), kind("contradicted_by", 2, "refutes"))).alias("x")).select("run_id", "claim_id", "pos", "x.*")
    last = each.groupBy("run_id", "claim_id", "source_id").agg(F.max_by("stance", F.struct(F.col("rank") > 0, "pos", "rank")).alias("analyst_stance"))
    return pairs.join(last.hint("merge"), ["run_id", "claim_id", "source_id"], "left")
