"""Trace and message tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bylines.functions.text import first_that


def trace_runs(events: DataFrame, run: str, key: list[str], order: list[str]) -> DataFrame:
    """Consecutive events of a run with the same ``key`` as one row: its place, count, last status and distinct details (gaps and islands)."""
    w = Window.partitionBy(run).orderBy(*order)
    same = F.lag(F.struct(*key)).over(w).eqNullSafe(F.struct(*key))
    islands = events.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(run, "island", *key).agg(F.count(F.lit(1)).alias("n"), F.max_by("status", F.struct(*order)).alias("last_status"), F.countDistinct("detail").alias("details"))


def layer_status(events: DataFrame, run: str, layer: str, order: list[str]) -> DataFrame:
    """Last status of each layer but for "running", and whether an error was followed by a success (degraded)."""
    at = F.struct(*order)
    last = F.max_by("status", F.when(F.col("status") != "running", at))
    error = F.min(F.when(F.col("status") == "error", at))
    good = F.max(F.when(F.col("status").isin("ok", "empty", "skipped"), at))
    return events.groupBy(run, layer).agg(last.alias("last"), error.alias("e"), good.alias("g")).select(
        run, layer, first_that([(F.coalesce((F.col("e") < F.col("g")) & (F.col("last") != "error"), F.lit(False)), "degraded")], F.coalesce("last", F.lit("running"))).alias("status")
    )


def live_state(events: DataFrame, run: str, order: list[str]) -> DataFrame:
    at = F.struct(*order)
    return events.groupBy(run).agg(F.max_by("layer", at).alias("layer"), F.max_by("status", at).alias("status"), F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("status") == "error").alias("errors"))


def message_sequence(messages: DataFrame, run: str, order: list[str]) -> DataFrame:
    return messages.withColumn("seq", F.row_number().over(Window.partitionBy(run).orderBy(*order)))
