"""Search plans: gates, ladders, coverage and adapter roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bylines.functions.text import first_that
from bylines.schemas import RAN, STATUS_RANK


def capabilities(spark: SparkSession) -> DataFrame:
    """A small table of adapters: null means no limit."""
    rows = [(f"src{i}", [None, 30, 400][i % 3], [None, ["en"], ["en", "fr"], ["de", "es"]][i % 4], i % 5 == 4) for i in range(20)]
    return spark.createDataFrame(rows, "adapter string, max_age_days int, languages array<string>, requires_key boolean")


def article_age(published: Column, now: Column) -> Column:
    """Whole days, never below 0; null where the date does not parse."""
    at = F.try_to_timestamp(published)
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400)
    return F.when(at.isNotNull(), F.greatest(F.lit(0), days)).cast("int")


def capability_gate(runs: DataFrame, adapters: DataFrame, has_key: bool = False) -> DataFrame:
    """(run_id, adapter, status, checks_skipped) before any search; ``runs`` has run_id, age_days and language.

    Age is checked before the key and the key before the language. Unknown metadata never closes a
    gate, it is named in checks_skipped. The adapters are a fixed small list.
    """
    met = runs.join(F.broadcast(adapters), how="cross")
    too_old = F.col("age_days") > F.col("max_age_days")
    foreign = F.col("languages").isNotNull() & F.col("language").isNotNull() & ~F.array_contains("languages", F.col("language"))
    status = first_that([(F.coalesce(too_old, F.lit(False)), "skipped_out_of_range"), (F.col("requires_key") & F.lit(not has_key), "skipped_no_key"), (F.coalesce(foreign, F.lit(False)), "skipped_out_of_range")], "run")
    skipped = F.filter(F.array(F.when(F.col("age_days").isNull() & F.col("max_age_days").isNotNull(), F.lit("age")), F.when(F.col("language").isNull() & F.col("languages").isNotNull(), F.lit("language"))), lambda x: x.isNotNull())
    return met.select("run_id", "adapter", status.alias("status"), skipped.alias("checks_skipped"), "languages", "max_age_days")


def collapse_reports(reports: DataFrame) -> DataFrame:
    """One row for each run and adapter: sums, the best status, the first reason, and all skipped checks."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS_RANK]), F.col("status"))
    return reports.groupBy("run_id", "adapter").agg(
        F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("queries_run"), F.min_by("status", rank).alias("status"),
        F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("pos"))).alias("reason"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("checks_skipped")))).alias("checks_skipped"),
    )


def tool_status(status: Column) -> Column:
    return first_that([(status == "ok", "ok"), (status == "empty", "empty"), (status == "error", "error")], "skipped")


def coverage(reports: DataFrame, now: Column) -> DataFrame:
    """Per run, over adapters that ran: languages reached ("any" without limit) and the earliest date, null if any is unbounded."""
    ran = reports.where(F.col("status").isin(RAN))
    deepest = F.when(F.bool_and(F.col("max_age_days").isNotNull()), F.max("max_age_days"))
    return ran.groupBy("run_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("languages", F.array(F.lit("any"))))))).alias("languages_covered"),
        F.date_format(F.date_sub(now, deepest), "yyyy-MM-dd").alias("earliest_reachable_date"), F.count(F.lit(1)).alias("adapters_run"),
    )


def ladder(rungs: DataFrame) -> DataFrame:
    """(run_id, outcome, strength, attempts_run, hits) from rungs (run_id, attempt, strength, hits); rows with attempt null plan nothing.

    The first rung with a hit ends the ladder; later rungs count as not run.
    """
    w = Window.partitionBy("run_id")
    first = F.min(F.when(F.col("hits") > 0, F.col("attempt"))).over(w)
    marked = rungs.withColumn("first", first)
    ran = F.col("attempt").isNotNull() & (F.col("first").isNull() | (F.col("attempt") <= F.col("first")))
    here = F.col("attempt") == F.col("first")
    out = marked.groupBy("run_id").agg(F.count_if(ran).alias("attempts_run"), F.max(F.when(here, F.col("strength"))).alias("s"), F.coalesce(F.max(F.when(here, F.col("hits"))), F.lit(0)).alias("hits"))
    return out.select("run_id", first_that([(F.col("attempts_run") == 0, "not_planned"), (F.col("s").isNotNull(), "matched")], "exhausted").alias("outcome"), F.coalesce("s", F.lit("none")).alias("strength"), "attempts_run", "hits")
