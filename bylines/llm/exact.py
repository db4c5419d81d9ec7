"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bylines.llm.texts import lower_ascii, text_or_empty
from bylines.scratch import written

PREFIX_CHARS = 256


def _survivors(keys: DataFrame, by: list[str]) -> DataFrame:
    """Keys that at least two rows share; written, so that joins with it are planned by its true size."""
    return written(keys.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))


def _length(text: Column) -> Column:
    return F.octet_length(text)


def _prefix(text: Column) -> Column:
    return F.xxhash64(lower_ascii(F.substring(text, 1, PREFIX_CHARS)))


def full_hash(text: Column) -> Column:
    return F.sha2(lower_ascii(text).cast("binary"), 256)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of two or more equal texts: (sha, keep_id, group_size).

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Lengths that two
    rows share go on to a hash of the first characters, lengths and prefixes that two rows share
    go on to SHA-256, and only rows of surviving groups are hashed whole. No text is shuffled:
    each pass reads the column, and rows of a few bytes meet. A group of any size costs one
    pre-aggregated row from each task. The largest id stays (null only if all are null).
    """
    return (
        _candidates(df, id_col, text_col)
        .groupBy("sha")
        .agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )


def _candidates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, sha) of the rows that share length and prefix hash with another row."""
    t = text_or_empty(text_col)
    rows = df.select(F.col(id_col).alias("_id"), t.alias("_t"), _length(t).alias("_len"))
    lengths = _survivors(rows, ["_len"])
    rows = rows.join(lengths, "_len", "left_semi").withColumn("_pre", _prefix(F.col("_t")))
    prefixes = _survivors(rows, ["_len", "_pre"])
    keyed = df.select(F.col(id_col).alias("_id"), t.alias("_t"), _length(t).alias("_len"), _prefix(t).alias("_pre"))
    return keyed.join(prefixes, ["_len", "_pre"], "left_semi").select("_id", full_hash(F.col("_t")).alias("sha"))


def exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id) of the rows that have an equal text of a larger id, and (id) of those that stay but stand there more than once.

    Only rows that survive the refinement are hashed whole. A null id is smaller than any other. An empty table gives none.
    """
    rows = written(_candidates(df, id_col, text_col))
    groups = written(rows.groupBy("sha").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    met = rows.join(groups.hint("merge"), "sha")
    stays = F.col("_id").eqNullSafe(F.col("keep_id"))
    again = met.where(stays).groupBy("sha", "keep_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return met.where(~stays).select(F.col("_id").alias(id_col)), again.select(F.col("keep_id").alias(id_col))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A decision for every row: (id, keep_id, group_size, kept, text_sha256).

    Rows that repeat both id and text are one record and share its decision. Rows outside any
    group keep themselves. An empty table gives no rows; other columns are not read.
    """
    groups = written(exact_groups(df, id_col, text_col)).select("keep_id", "group_size", F.col("sha").alias("text_sha256"))
    rows = df.select(F.col(id_col), full_hash(text_or_empty(text_col)).alias("text_sha256"))
    met = rows.join(groups, "text_sha256", "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col(id_col)).otherwise(F.col("keep_id"))
    return met.select(
        F.col(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col(id_col).eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
