"""The driver's tables in the roles that the evidence jobs know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bylines.functions.text import body_hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Documents, or those rows of them in ``docs``, as hits of one run: publisher is the source."""
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    title = F.left(F.substring_index("text", "\n", 1), F.lit(120))
    return docs.select(
        F.lit(0).alias("run_id"), F.col("doc_id").alias("doc"), F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("doc_id").cast("string")).alias("canonical_url"),
        F.col("source").alias("publisher_id"), title.alias("title"), "text", F.col("lang").alias("language"), body_hash(F.col("text")).alias("body_hash"), F.lit(None).cast("string").alias("wire"),
    )


def owners(spark: SparkSession) -> DataFrame:
    """Odd sources belong to one of seven groups, even ones to nobody known."""
    n = F.col("id").cast("int")
    return spark.range(20).select(F.concat(F.lit("src"), n.cast("string")).alias("publisher_id"), F.when(n % 2 == 1, F.concat(F.lit("group"), (n % 7).cast("string"))).alias("parent_group"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as claims."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim"), "text")


def key_of(event_props: Column) -> Column:
    return F.get_json_object(event_props, "$.k").cast("int")
