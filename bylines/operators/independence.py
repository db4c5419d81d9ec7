"""From pages to independent newsrooms: merge edges, components, evidence, counts and existence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bylines.functions.text import first_that, normal_title
from bylines.operators.components import connected_components
from bylines.operators.similarity import jaccard_pairs, shingle_classes
from bylines.schemas import MERGE_REASONS, REPRINT, SAME_WIRE
from bylines.scratch import written


def completeness(cols: list[str]) -> Column:
    """How many of the fields are neither null nor blank."""
    return sum((F.when(F.trim(F.col(c).cast("string")) != "", 1).otherwise(0) for c in cols), F.lit(0))


def best_per_url(hits: DataFrame, run: str, url: str, fields: list[str], tie: list[str]) -> DataFrame:
    """One hit for each run and URL: the most complete, then the first by ``tie``."""
    w = Window.partitionBy(run, url).orderBy(F.col("completeness").desc(), *tie)
    return hits.withColumn("completeness", completeness(fields)).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def owner_edges(docs: DataFrame, owners: DataFrame) -> DataFrame:
    """(run_id, a, b, rank) from each document to the first of its parent group; unmapped publishers have none."""
    mapped = docs.join(owners, "publisher_id").where("parent_group IS NOT NULL")
    least = written(mapped.groupBy("run_id", "parent_group").agg(F.min("doc").alias("a")))
    return mapped.join(least, ["run_id", "parent_group"]).where("a <> doc").select("run_id", "a", F.col("doc").alias("b"), F.lit(MERGE_REASONS.index("same_owner")).alias("rank"))


def hash_edges(docs: DataFrame) -> DataFrame:
    """Reprints by body hash among documents without a wire: where a hash has two publishers, all its documents are connected."""
    hashed = docs.where("body_hash IS NOT NULL AND wire IS NULL")
    groups = written(hashed.groupBy("run_id", "body_hash").agg(F.min("doc").alias("a"), F.min("publisher_id").alias("p"), F.max("publisher_id").alias("q")).where("p <> q").drop("p", "q"))
    return hashed.join(groups, ["run_id", "body_hash"]).where("a <> doc").select("run_id", "a", F.col("doc").alias("b"), F.lit(MERGE_REASONS.index("reprint")).alias("rank"))


def text_edges(docs: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Reprints by text between documents without a wire, of which at most one has a body hash.

    Pairs stand between classes of equal shingle sets. Documents of one or two linked classes are
    nodes of a complete multipartite graph by publisher and by having no hash, so one star replaces
    its pairs: each class keeps, in each run, the smallest unhashed document of its two smallest
    publishers as hubs, and every document links to a hub of another publisher.
    """
    free = docs.where("wire IS NULL").join(members, docs["doc"] == members["id"]).select("run_id", "doc", "publisher_id", F.col("body_hash").isNotNull().alias("hashed"), "rep")
    free = written(free)
    by_publisher = free.groupBy("run_id", "rep", "hashed", "publisher_id").agg(F.min("doc").alias("hub"))
    w = Window.partitionBy("run_id", "rep", "hashed").orderBy("publisher_id")
    hubs = written(by_publisher.withColumn("_r", F.row_number().over(w)).where("_r <= 2").drop("_r").select("run_id", F.col("rep").alias("other"), F.col("hashed").alias("hub_hashed"), F.col("publisher_id").alias("hub_publisher"), "hub"))
    linked = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("rep", "other").union(members.select(F.col("rep"), F.col("rep").alias("other")).distinct())
    met = free.join(written(linked), "rep").join(hubs, ["run_id", "other"]).where("publisher_id <> hub_publisher AND NOT (hashed AND hub_hashed)")
    return met.select("run_id", F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b"), F.lit(MERGE_REASONS.index("reprint")).alias("rank")).distinct()


def wire_edges(docs: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Documents of one wire credit with equal body hashes or similar texts, as stars to the first of each hash or class."""
    wired = written(docs.where("wire IS NOT NULL").withColumn("wire", F.lower(F.trim("wire"))).join(members, docs["doc"] == members["id"], "left"))
    rank = F.lit(MERGE_REASONS.index("same_wire")).alias("rank")

    def star(key: str) -> DataFrame:
        least = wired.where(F.col(key).isNotNull()).groupBy("run_id", "wire", key).agg(F.min("doc").alias("a"))
        return wired.join(least.hint("merge"), ["run_id", "wire", key]).where("a <> doc").select("run_id", "a", F.col("doc").alias("b"), rank)

    firsts = written(wired.where("rep IS NOT NULL").groupBy("run_id", "wire", "rep").agg(F.min("doc").alias("doc")))
    x, y = firsts.select("run_id", "wire", F.col("rep").alias("a"), F.col("doc").alias("da")), firsts.select("run_id", "wire", F.col("rep").alias("b"), F.col("doc").alias("db"))
    across = pairs.join(x, "a").join(y, ["run_id", "wire", "b"]).select("run_id", F.least("da", "db").alias("a"), F.greatest("da", "db").alias("b"), rank)
    return star("body_hash").union(star("rep")).union(across)


def similar_texts(texts: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Class members and class pairs at the lower of the two thresholds."""
    members, sets = shingle_classes(texts, id_col, text_col)
    return members, written(jaccard_pairs(members, sets, SAME_WIRE))


def merge_edges(docs: DataFrame, owners: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(run_id, a, b, rank) of all reasons to count two documents as one newsroom, as stars."""
    close = pairs.where(F.col("jaccard") >= REPRINT - 1e-12)
    return wire_edges(docs, members, pairs).union(owner_edges(docs, owners)).union(hash_edges(docs)).union(text_edges(docs, members, close))


def independent_sources(docs: DataFrame, owners: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(run_id, doc, source, reason) for every row of ``docs(run_id, doc, publisher_id, body_hash, wire)``.

    A source is named by its smallest document; its reason is the strongest edge inside it, in the
    order of MERGE_REASONS. Similarity may be computed once over all runs, but components are
    closed within a run only. Unknown owners and lone pages stay independent.
    """
    docs = written(docs.select("run_id", "doc", "publisher_id", "body_hash", "wire"))  # body hashes are dear and read by every rule
    edges = written(merge_edges(docs, owners, members, pairs))
    comps = written(connected_components(edges, "a", "b", keys=("run_id",)))
    reasons = edges.join(comps, (edges["run_id"] == comps["run_id"]) & (edges["a"] == comps["node"])).groupBy(comps["run_id"], "component").agg(F.min("rank").alias("rank"))
    names = F.array(*[F.lit(r) for r in MERGE_REASONS])
    found = docs.select("run_id", "doc").join(comps.select("run_id", F.col("node").alias("doc"), "component"), ["run_id", "doc"], "left")
    found = found.join(written(reasons), ["run_id", "component"], "left")
    return found.select("run_id", "doc", F.coalesce("component", "doc").alias("source"), F.coalesce(F.get(names, "rank"), F.lit("none")).alias("reason"))


def source_summary(sources: DataFrame, docs: DataFrame) -> DataFrame:
    """One row for each source: member count, reason and its checkable evidence (first six outlets by name, and how many more)."""
    outlets = F.array_sort(F.collect_set("publisher_id"))
    rows = sources.join(docs.select("run_id", "doc", "publisher_id"), ["run_id", "doc"]).groupBy("run_id", "source", "reason").agg(F.count(F.lit(1)).alias("members"), outlets.alias("outlets"))
    more = F.size("outlets") - 6
    listed = F.concat(F.array_join(F.slice("outlets", 1, 6), ", "), F.when(more > 0, F.format_string(" and %d more", more)).otherwise(""))
    text = F.when(F.col("reason") == "none", F.concat(F.lit("independent: "), listed)).otherwise(F.concat(F.col("reason"), F.lit(": "), listed))
    return rows.select("run_id", "source", "reason", "members", text.alias("evidence"))


def pages_vs_newsrooms(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """document_count and independent_source_count of every run, zero where nothing was found, and pages beyond the newsrooms."""
    counts = sources.groupBy("run_id").agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("source").alias("sources"))
    met = runs.select("run_id").join(counts, "run_id", "left")
    d, s = F.coalesce("documents", F.lit(0)), F.coalesce("sources", F.lit(0))
    return met.select("run_id", d.alias("document_count"), s.alias("independent_source_count"), F.greatest(d - s, F.lit(0)).alias("republished"))


def existence_class(contexts: DataFrame, hits: DataFrame, sources: DataFrame, ladder: DataFrame, reports: DataFrame) -> DataFrame:
    """How the submitted article itself was found, from the most to the least specific; unsearched is kept apart from unfound.

    contexts(run_id, canonical_url, headline, body_hash), hits(run_id, doc, canonical_url, title, body_hash),
    sources(run_id, doc, reason), ladder(run_id, outcome, strength), reports(run_id, ran).
    """
    c = contexts.select("run_id", F.col("canonical_url").alias("c_url"), normal_title(F.col("headline")).alias("c_title"), F.col("body_hash").alias("c_hash"))
    met = hits.join(c, "run_id").join(sources.select("run_id", "doc", "reason"), ["run_id", "doc"], "left")
    same_title = (F.col("c_title") != "") & (normal_title(F.col("title")) == F.col("c_title"))
    same_hash = F.coalesce(F.col("body_hash") == F.col("c_hash"), F.lit(False))
    flag = lambda x, name: F.coalesce(F.bool_or(x), F.lit(False)).alias(name)
    flags = met.groupBy("run_id").agg(
        flag((F.col("c_url") != "") & (F.col("canonical_url") == F.col("c_url")), "url"), flag((same_title | same_hash) & (F.col("reason") == "same_wire"), "wire"),
        flag(same_hash, "hash"), flag(same_title, "title"),
    )
    ran = reports.groupBy("run_id").agg(F.bool_or("ran").alias("any_ran"))
    on = lambda x: F.coalesce(F.col(x), F.lit(False))
    row = contexts.select("run_id").join(flags, "run_id", "left").join(ladder, "run_id", "left").join(ran, "run_id", "left")
    matched = (F.col("outcome") == "matched") & F.col("strength").isin("exact", "loose")
    unseen = (F.col("any_ran") == F.lit(False)) | (F.coalesce("outcome", F.lit("not_planned")) == "not_planned")
    return row.select("run_id", first_that([(on("url"), "exact_url"), (on("wire"), "syndicated"), (on("hash"), "near_duplicate"), (on("title"), "title_match"), (F.coalesce(matched, F.lit(False)), "title_match"), (F.coalesce(unseen, F.lit(False)), "out_of_range")], "not_found").alias("existence"))
