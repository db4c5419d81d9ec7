"""Gapless numbers within groups, without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunks_for(rows: int, chunk_rows: int) -> int:
    return max(1, -(-rows // chunk_rows))


def number_within(df: DataFrame, group: str, key: Column, order: list[Column], out: str, rows: int, chunk_rows: int = 50_000) -> DataFrame:
    """Add ``out``: 0, 1, 2... within each value of ``group``.

    Each group is cut by a hash of ``key`` into chunks of about ``chunk_rows`` rows; a chunk's
    numbers start where the running sum of the counts of the chunks before it ends. Only the
    counts, one row for each chunk, meet in one task. ``order`` numbers rows within a chunk. Rows
    with equal ``key`` share a chunk; ``rows`` is the number of rows, or near it.
    """
    n = chunks_for(rows, chunk_rows)
    dealt = df.withColumn("_chunk", F.pmod(F.xxhash64(key), F.lit(n)))
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(group, "_chunk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(F.col(group).alias("_g"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    local = dealt.withColumn("_i", F.row_number().over(Window.partitionBy(group, "_chunk").orderBy(*order)) - 1)
    met = local.join(starts.hint("merge"), (local[group] == starts["_g"]) & (local["_chunk"] == starts["_c"]))
    return met.withColumn(out, (F.col("_start") + F.col("_i")).cast("long")).drop("_chunk", "_i", "_g", "_c", "_start")
