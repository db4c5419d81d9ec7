"""Greedy dedupe within a publisher: each page folds into the first page kept before it that it repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bylines.schemas import DUPLICATE
from bylines.scratch import written

_SAME_PAGE = ["run_id", "publisher_id", "rep", "body_hash"]


def _nodes(docs: DataFrame, members: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): documents of one run, publisher, shingle class and body hash have the same duplicates and are one node, named by the first of them.

    A document with neither words nor a hash repeats nothing and is a node of its own.
    """
    alone = F.when(F.col("rep").isNull() & F.col("body_hash").isNull(), F.col("doc"))
    first = F.struct(*order, "doc").alias("ord")
    met = docs.join(members.select(F.col("id").alias("doc"), "rep").hint("merge"), "doc", "left").withColumn("alone", alone).withColumn("ord", first)
    rows = written(met.select(*_SAME_PAGE, "alone", "doc", "ord"))
    return rows, written(rows.groupBy(*_SAME_PAGE, "alone").agg(F.min("ord").alias("ord")))


def _edges(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(run_id, a, b), a before b in order, of nodes of one publisher that repeat each other.

    Where both have a body hash only equal hashes count, else similar texts. Copies are one node, so
    a large group of them has no edges, and of the pairs of two classes at least one end has no hash.
    """
    x = nodes.select("run_id", "publisher_id", "rep", "body_hash", F.col("ord").alias("a"))
    y = nodes.select("run_id", "publisher_id", F.col("rep").alias("other"), F.col("body_hash").alias("hash_b"), F.col("ord").alias("b"))
    by_hash = x.join(y.where("hash_b IS NOT NULL").withColumnRenamed("hash_b", "body_hash").hint("merge"), ["run_id", "publisher_id", "body_hash"]).where("a < b").select("run_id", "a", "b")
    linked = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("rep", "other").union(nodes.where("rep IS NOT NULL").select("rep", F.col("rep").alias("other")).distinct())
    near = x.join(written(linked).hint("merge"), "rep").join(y.hint("merge"), ["run_id", "publisher_id", "other"])
    by_text = near.where("a < b AND NOT (body_hash IS NOT NULL AND hash_b IS NOT NULL)").select("run_id", "a", "b")
    return by_hash.union(by_text).distinct()


def leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, ord, leader) for ``nodes(run_id, ord)``: what a loop in order keeps, and the first kept one that each other node repeats.

    A node whose earlier neighbours have all been dropped is kept, and a node with an earlier kept
    neighbour is dropped, as in the loop; each round decides all nodes for which one of the two is
    certain. The first undecided node always is, so this ends; rounds grow with the longest chain of
    neighbours in ascending order, and every round shuffles open edges only. ``edges(run_id, a, b)``
    run from the earlier to the later end; runs are apart.
    """
    ends = edges.select("run_id", F.col("a").alias("ord")).union(edges.select("run_id", F.col("b").alias("ord"))).distinct()
    state, open_edges = written(ends.withColumn("kept", F.lit(None).cast("boolean"))), edges
    while not state.where("kept IS NULL").isEmpty():
        early, late = state.select("run_id", F.col("ord").alias("a"), "kept"), state.where("kept IS NULL").select("run_id", F.col("ord").alias("b"))
        told = open_edges.join(early.hint("merge"), ["run_id", "a"]).where("kept IS NULL OR kept")
        told = written(told.join(late.hint("merge"), ["run_id", "b"], "left_semi").select("run_id", "a", "b", "kept"))
        seen = told.groupBy("run_id", F.col("b").alias("ord")).agg(F.bool_or(F.coalesce("kept", F.lit(False))).alias("led"))
        now = F.coalesce("kept", F.when(F.col("led").isNull(), True).when(F.col("led"), False))
        state = written(state.join(seen.hint("merge"), ["run_id", "ord"], "left").select("run_id", "ord", now.alias("kept")))
        open_edges = told.drop("kept")
    kept = state.where("kept").select("run_id", F.col("ord").alias("a"))
    first = edges.join(kept.hint("merge"), ["run_id", "a"], "left_semi").groupBy("run_id", F.col("b").alias("ord")).agg(F.min("a").alias("led_by"))
    met = nodes.select("run_id", "ord").join(state.where("NOT kept").hint("merge"), ["run_id", "ord"], "left").join(first.hint("merge"), ["run_id", "ord"], "left")
    return met.select("run_id", "ord", F.when(F.col("kept").isNull(), F.col("ord")).otherwise(F.col("led_by")).alias("leader"))


def greedy_dedupe(docs: DataFrame, members: DataFrame, pairs: DataFrame, order: list[str]) -> DataFrame:
    """(run_id, doc, kept_doc) for every row of ``docs(run_id, doc, publisher_id, body_hash, *order)``.

    The loop takes a run's pages by ``order`` and doc, which puts the page that is to represent a group
    first: most complete, then by URL. A page is dropped if one that was kept before it, of the same
    publisher, repeats it: equal body hashes where both have one, else five-word shingles alike to
    DUPLICATE. It folds into the first such page. Pages of other publishers stay whatever they say, as
    that is for independence to explain. Chains are not closed: with a~b~c and a kept, b is dropped
    and c is kept unless it repeats a. ``members`` and ``pairs`` are those of ``similar_texts``;
    order columns hold no nulls where their place matters, as nulls come first. An empty table gives no rows.
    """
    rows, nodes = _nodes(docs, members, order)
    edges = written(_edges(nodes, pairs.where(F.col("jaccard") >= DUPLICATE - 1e-12)))
    found = leaders(nodes, edges).select("run_id", F.col("ord").alias("first"), F.col("leader.doc").alias("kept_doc"))
    same = [rows[c].eqNullSafe(nodes[c]) for c in (*_SAME_PAGE, "alone")]
    named = rows.join(nodes.select(*_SAME_PAGE, "alone", F.col("ord").alias("first")).hint("merge"), on=same[0] & same[1] & same[2] & same[3] & same[4])
    return named.select(rows["run_id"], rows["doc"], "first").join(found.hint("merge"), ["run_id", "first"]).select("run_id", "doc", "kept_doc")
