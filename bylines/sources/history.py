"""The run history as a table of files: idempotent saves, the latest word on each run, and one import of older records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "run_id string, created_at timestamp, updated_at timestamp, original_text string, original_url string, headline string, phase string, status string, completed_layer int, envelope string"
NAMES = [c.split()[0] for c in RUN.split(", ")]
LEGACY = "envelope struct<run_id:string,created_at:string,phase:string,status:string,completed_layer:int,headline:string>, original_text string, original_url string"
IMPORTED = "0-imported"


def display_headline(headline: Column, url: Column, text: Column, run_id: Column) -> Column:
    """What a run is listed as: its headline or else its URL, cut to 200 characters, else the start of its text, else its id."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    short = F.concat(F.left(flat, F.lit(80)), F.when(F.char_length(flat) > 80, "…").otherwise(""))
    return F.coalesce(F.nullif(F.left(F.trim(headline), F.lit(200)), F.lit("")), F.nullif(F.left(F.trim(url), F.lit(200)), F.lit("")), F.nullif(short, F.lit("")), run_id)


class RunHistory:
    """Saves of runs in a shared folder, a folder for each save of a writer.

    Nothing is changed in place: a save is written as a whole under its own name, and written again under that name if it is
    repeated, so writers need no lock and a replay changes nothing. What counts of a run is its row with the latest
    updated_at, of equal ones that with the greater name; the first created_at stays.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folders(self) -> list[str]:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = lambda x: fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{x}/_SUCCESS"))
        return [str(x) for x in (s.getPath() for s in fs.listStatus(p)) if done(x)] if fs.exists(p) else []

    def save(self, runs: DataFrame, name: str) -> None:
        """Write ``runs`` (columns of RUN) as the save ``name``; rows without a run_id are left out."""
        runs.where("run_id IS NOT NULL").select(NAMES).write.mode("overwrite").parquet(f"{self.path}/save={name}")

    def rows(self) -> DataFrame:
        """All rows of all complete saves."""
        found = self._folders()
        if not found:
            return self.spark.createDataFrame([], f"{RUN}, save string")
        return self.spark.read.schema(f"{RUN}, save string").option("basePath", self.path).parquet(*found)

    def latest(self) -> DataFrame:
        """One row for each run."""
        last = self.rows().groupBy("run_id").agg(F.min("created_at").alias("first"), F.max_by(F.struct(*NAMES[2:]), F.struct("updated_at", "save")).alias("x"))
        return last.select("run_id", F.coalesce("first", "x.updated_at").alias("created_at"), "x.*")

    def listed(self) -> DataFrame:
        """(run_id, created_at, updated_at, headline, phase, status, completed_layer), the latest updated first."""
        name = display_headline(F.col("headline"), F.col("original_url"), F.col("original_text"), F.col("run_id"))
        return self.latest().select("run_id", "created_at", "updated_at", name.alias("headline"), "phase", "status", "completed_layer").orderBy(F.col("updated_at").desc(), "run_id")

    def import_once(self, folder: str) -> bool:
        """Take over older records, a JSON file for each run, if there is no history yet; whether it did.

        Files that are no JSON or name no run are left out. A second import, or one after any save, does nothing.
        """
        if self._folders():
            return False
        old = self.spark.read.schema(f"{LEGACY}, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(folder)
        e = lambda c: F.col(f"envelope.{c}")
        at = F.coalesce(F.try_to_timestamp(e("created_at")), F.lit("1970-01-01 00:00:00").cast("timestamp"))
        rows = old.where("_bad IS NULL").select(
            e("run_id").alias("run_id"), at.alias("created_at"), at.alias("updated_at"), "original_text", "original_url", e("headline").alias("headline"), e("phase").alias("phase"), e("status").alias("status"), e("completed_layer").alias("completed_layer"),
            F.to_json("envelope").alias("envelope"),
        )
        self.save(rows.where("run_id <> ''"), IMPORTED)
        return True
