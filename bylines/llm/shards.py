"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bylines.operators.numbering import number_within


def rendezvous_shard(key: Column, weights: list[float]) -> Column:
    """The shard, 0 to ``len(weights) - 1``, that wins ``key``.

    Every shard draws -ln(u) / weight with u from a hash of (key, shard), and the smallest draw
    wins: shares follow the weights, and a new shard takes rows only into itself, as all other
    draws stay. Weights are positive. Equal keys meet in one shard; a null key counts as a key.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    draws = []
    for s, w in enumerate(weights):
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(s)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        draws.append(F.struct((-F.log(u) / F.lit(float(w))).alias("draw"), F.lit(s).alias("shard")))
    return F.array_min(F.array(*draws))["shard"]


def shard_records(df: DataFrame, key: str, weights: list[float], grown: list[float] | None = None, chunk_rows: int = 50_000) -> DataFrame:
    """Add shard, slot (gapless from 0 within a shard) and, with ``grown`` weights, grown_shard.

    Only ``key`` and the weights decide a row's shard. Slots are dealt in hashed chunks of keys,
    by key within a chunk, so no shard is sorted in one task. Repeated keys get slots of their
    own in any order; null keys share one shard; an empty table stays empty. Other columns pass
    through; those named shard, slot or grown_shard are replaced.
    """
    rows = df.select(F.count(F.lit(1))).head()[0]
    out = df.withColumn("shard", rendezvous_shard(F.col(key), weights))
    if grown is not None:
        out = out.withColumn("grown_shard", rendezvous_shard(F.col(key), grown))
    return number_within(out, "shard", F.col(key), [F.col(key).asc_nulls_first()], "slot", rows // len(weights), chunk_rows)
