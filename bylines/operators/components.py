"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bylines.scratch import written


def connected_components(edges: DataFrame, a: str, b: str, keys: tuple[str, ...] = (), max_rounds: int = 60) -> DataFrame:
    """Rows (``keys``, node, component): for each node of an edge, the smallest node it reaches.

    Each round every node, and the parent it points at, takes the smallest grandparent among its
    neighbours; paths halve, so rounds grow with the logarithm of the longest path. A round moves
    one row for each edge and node, pre-aggregated with ``min``, so a hub costs no more than its
    edges. Edges with a null end are ignored, repeated edges and loops do no harm, an empty table
    gives an empty result. Nodes are compared within equal ``keys`` only; ``keys`` hold no nulls.
    """
    ks = list(keys)
    one = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = one.select(*ks, F.col(a).alias("u"), F.col(b).alias("v")).union(one.select(*ks, F.col(b).alias("u"), F.col(a).alias("v")))
    both = written(both.distinct())
    f = written(both.groupBy(*ks, "u").agg(F.min("v").alias("m")).select(*ks, F.col("u").alias("node"), F.least("u", "m").alias("p")))
    for _ in range(max_rounds):
        up = f.select(*ks, F.col("node").alias("p"), F.col("p").alias("gp"))
        g = f.join(up, [*ks, "p"]).select(*ks, "node", "p", "gp")
        near = both.join(g.select(*ks, F.col("node").alias("v"), "gp"), [*ks, "v"]).groupBy(*ks, "u").agg(F.min("gp").alias("m"))
        met = g.join(near.withColumnRenamed("u", "node"), [*ks, "node"])
        offers = met.select(*ks, F.explode(F.array(
            F.struct(F.col("node"), F.least("gp", "m").alias("p"), F.col("p").alias("old")),
            F.struct(F.col("p").alias("node"), F.least("gp", "m").alias("p"), F.lit(None).cast(f.schema["p"].dataType).alias("old")),
        )).alias("x")).select(*ks, "x.*")
        after = written(offers.groupBy(*ks, "node").agg(F.min("p").alias("p"), F.max("old").alias("old")))
        f = after.select(*ks, "node", "p")
        if after.where(F.col("p") != F.col("old")).isEmpty():
            return f.withColumnRenamed("p", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
