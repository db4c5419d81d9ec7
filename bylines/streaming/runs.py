"""The live state of runs as their trace arrives: each run's last word, and an error where a layer has gone quiet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RUN = pa.schema([("run_id", pa.int64()), ("us", pa.int64()), ("event_id", pa.int64()), ("layer", pa.string()), ("status", pa.string()), ("n_events", pa.int64()), ("errors", pa.int64()), ("due", pa.int64())])
OUT = "run_id long, layer string, status string, n_events long, errors long, stale boolean"
NAMES = [c.split()[0] for c in OUT.split(", ")]
NEVER = 1 << 62
BUCKETS = 256  # of runs; a task takes a bucket's runs together, as a call for each run costs some milliseconds


def live_states(events: DataFrame, quiet: str = "1 hour", delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Updates (run_id, layer, status, n_events, errors, stale) of a stream of events(run_id, ts, event_id, layer, status).

    The last event by time and id speaks for its run, in whatever order events come within ``delay``.
    A run whose last word is "running" and that says nothing for ``quiet``, by the stream's own clock, is an
    error: whoever ran the layer is gone. An event that comes after all brings it back to life. Events
    with a null run or time are left out. State holds one row for each run, in tables of a bucket of runs each, by a hash of
    the run; a bucket wakes when the first of its runs is due.
    """
    limit = int(pd.Timedelta(quiet).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs = pa.ipc.read_record_batch(pa.py_buffer(bytes(state.get[0])), RUN).to_pandas() if state.exists else RUN.empty_table().to_pandas()
        now, told = state.getCurrentWatermarkMs(), []
        for part in frames if not state.hasTimedOut else ():
            told.append(part["run_id"].unique())
            new = part.assign(n_events=1, errors=(part["status"] == "error").astype("int64"), due=NEVER)[RUN.names]
            # of the same time and id the earlier word stays
            both = pd.concat([new, runs] if len(runs) else [new], ignore_index=True).sort_values(["run_id", "us", "event_id"], kind="stable")
            sums = both.groupby("run_id")[["n_events", "errors"]].sum()
            runs = both.drop_duplicates("run_id", keep="last").assign(n_events=sums["n_events"].to_numpy(), errors=sums["errors"].to_numpy())
        heard = runs["run_id"].isin(np.concatenate(told)) if told else pd.Series(False, runs.index)
        due = np.where(heard, np.where(runs["status"] == "running", np.maximum(runs["us"] // 1000 + limit, now + 1), NEVER), runs["due"])
        stale = ~heard & (due < now)
        # counts stay, so that a late sign of life goes on from them
        runs = runs.assign(due=np.where(stale, NEVER, due))
        state.update((pa.RecordBatch.from_pandas(runs, RUN, preserve_index=False).serialize().to_pybytes(),))
        if (first := int(runs["due"].min())) < NEVER:
            state.setTimeoutTimestamp(first)
        out = runs[heard | stale].assign(stale=stale[heard | stale])
        yield out.assign(status=out["status"].mask(out["stale"], "error"))[NAMES]

    known = events.where("run_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    dealt = known.select(F.pmod(F.xxhash64("run_id"), F.lit(buckets)).alias("bucket"), F.col("run_id").cast("long").alias("run_id"), "ts", F.unix_micros("ts").alias("us"), "event_id", "layer", "status")
    return dealt.groupBy("bucket").applyInPandasWithState(step, OUT, "runs binary", "update", GroupStateTimeout.EventTimeTimeout)


def drive(updates: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream of updates through all that is available; each micro-batch is a folder, which a repeat of it replaces."""

    def put(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={n}")

    updates.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last update of each run."""
    rows = spark.read.schema(f"{OUT}, batch long").option("basePath", path).parquet(f"{path}/batch=*")
    return rows.groupBy("run_id").agg(F.max_by(F.struct(*NAMES[1:]), "batch").alias("x")).select("run_id", "x.*")
