"""Tables written between the steps of a job, in the folder that the whole cluster shares.

A written table cuts lineage, survives the loss of an executor and gives the optimiser true
sizes, so a join with it is planned from what is there and not from a guess.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-bylines-")
    return f"file://{_own[app]}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/bylines-tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def rows_at_once(spark: SparkSession, most: int) -> Iterator[None]:
    """Within it, what is written goes to Python in Arrow batches of at most ``most`` rows, which JVM and worker both hold; results are the same."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most if int(before) <= 0 else min(most, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def clear(spark: SparkSession) -> None:
    """Delete the tables that earlier jobs wrote; call it once their results are stored."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/bylines-tables")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
