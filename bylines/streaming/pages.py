"""Structured Streaming jobs over arriving pages and trace events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bylines.functions.url import canonical_url
from bylines.scratch import shared_dir


def first_arrivals(pages: DataFrame, time_col: str, url_col: str = "url", delay: str = "1 day") -> DataFrame:
    """Pages whose canonical URL was not seen within the watermark; state is bounded by ``delay``."""
    return pages.withColumn("grouping_url", canonical_url(F.col(url_col))).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["grouping_url"])


def windowed_statuses(events: DataFrame, time_col: str = "ts", width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events of each type and window, final once the watermark passes."""
    return events.withWatermark(time_col, delay).groupBy(F.window(time_col, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def enriched(pages: DataFrame, owners: DataFrame, key: str = "publisher_id") -> DataFrame:
    """Stream joined with the small static ownership table; unmapped publishers stay."""
    return pages.join(F.broadcast(owners), key, "left")


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drive a stream through all that is available into a table in the shared folder and read it."""
    spark: SparkSession = stream.sparkSession
    base = f"{shared_dir(spark)}/bylines-streams/{uuid.uuid4().hex}"
    query: StreamingQuery = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
