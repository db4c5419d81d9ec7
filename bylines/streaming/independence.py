"""Independence kept up to date as pages arrive: each batch meets a stored shingle index and merges old newsrooms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from bylines.functions.shingles import shingle_sets
from bylines.operators.components import connected_components
from bylines.operators.independence import merge_edges
from bylines.operators.similarity import candidates, ends, frequent_shingles, index_rows, prefix_index, verified
from bylines.schemas import MERGE_REASONS, SAME_WIRE
from bylines.scratch import written

DOC = "run_id long, doc long, publisher_id string, body_hash string, wire string, class string, batch long"
TEXT = f"{DOC.removesuffix(', batch long')}, c long, n int, p array<long>, text string, batch long"
INDEX = "c long, n int, p array<long>, batch long"
ORDER = "h long, f long, batch long"
PAIR = "a long, b long, jaccard double, batch long"
SOURCE = "run_id long, doc long, source long, rank int, batch long"
TABLES = {"texts": TEXT, "docs": DOC, "index": INDEX, "order": ORDER, "pairs": PAIR, "sources": SOURCE}


class Store:
    """Append-only tables in a shared folder, a folder for each batch; a batch counts once its last file, the mark, is there.

    A batch that failed half way has no mark, is not read, and is written again from its start.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, *parts: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def batches(self) -> list[int]:
        """Numbers of the batches that are complete."""
        fs, marks = self._folder("marks")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(marks)) if fs.exists(marks) else []

    def add(self, batch: int, name: str, rows: DataFrame) -> DataFrame:
        """Write the rows of a batch, and read them back."""
        fields, path = TABLES[name].removesuffix(", batch long"), f"{self.path}/{name}/batch={batch}"
        rows.select(*[c.split()[0] for c in fields.split(", ")]).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(fields).parquet(path)

    def complete(self, batch: int) -> None:
        fs, mark = self._folder("marks", str(batch))
        fs.create(mark, True).close()

    def read(self, name: str) -> DataFrame:
        paths = [f"{self.path}/{name}/batch={b}" for b in self.batches()]
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).option("basePath", f"{self.path}/{name}").parquet(*paths)

    def sources(self) -> DataFrame:
        """(run_id, doc, source, reason) of all pages so far: what the last batch that touched a run says."""
        last = self.read("sources").groupBy("run_id", "doc").agg(F.max_by(F.struct("source", "rank"), "batch").alias("x"))
        return last.select("run_id", "doc", "x.source", F.coalesce(F.get(F.array(*[F.lit(r) for r in MERGE_REASONS]), "x.rank"), F.lit("none")).alias("reason"))


def _new_pairs(fresh: DataFrame, stored: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of similar classes of which one is new, from indexes (c, n, p) of the classes' first shingles.

    Only shingles of a new class that another one has too go to the join, and only texts of candidates, which are cut again, are shuffled.
    """
    every = fresh.withColumn("new", F.lit(True)).union(stored.withColumn("new", F.lit(False)))
    shared = written(every.select("new", F.explode("p").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("f"), F.bool_or("new").alias("new")).where("f > 1 AND new").select("h"))
    x, y = written(index_rows(fresh, shared)), written(index_rows(stored, shared))
    met = candidates(x, x.union(y), SAME_WIRE, F.col("a") != F.col("b"))
    met = written(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sets = written(shingle_sets(ends(met, texts.select("c", "text")), ["c"], "text").select("c", "s"))
    return verified(met, sets, SAME_WIRE)


def fold_in(pages: DataFrame, batch: int, store: Store, owners: DataFrame) -> None:
    """Add a batch of ``pages(run_id, doc, publisher_id, body_hash, wire, text)`` and bring the sources of the runs it touches up to date.

    Pages that the store has, by run and doc, and repeats within the batch change nothing, whether the batch comes
    again under its number or another. Only texts that come are cut into shingles, and only pairs with a new
    text are compared, through the stored index. It follows the frequencies of the first batch with words for good: whatever
    they become, what is stored stays valid. Texts are stored as they come, their sets are not. Merge edges are drawn among the pages of touched runs;
    those within an old source fall away, and components are sought among old sources and new pages only,
    so the work of a batch follows its runs, not the corpus. Pages with a null run or doc are left out.
    """
    if batch in store.batches():
        return
    keep = ("run_id", "doc", "publisher_id", "body_hash", "wire", "class", "text")
    cut = shingle_sets(pages.where("run_id IS NOT NULL AND doc IS NOT NULL"), [c for c in keep if c != "class"], "text").withColumn("c", F.xxhash64("class"))
    begun = not store.read("index").isEmpty()
    first = store.add(batch, "order", store.read("order").limit(0) if begun else frequent_shingles(cut))
    new = store.add(batch, "texts", prefix_index(cut, "c", store.read("order").select("h", "f") if begun else first, SAME_WIRE, keep))
    known = store.read("docs").select("run_id", "doc")
    docs = store.add(batch, "docs", new.select(*keep[:-1]).dropDuplicates(["run_id", "doc"]).join(known.hint("merge"), ["run_id", "doc"], "left_anti"))
    stored = store.read("index").select("c", "n", "p")
    unseen = written(docs.where("class IS NOT NULL").select(F.xxhash64("class").alias("c")).distinct().join(stored.select("c").hint("merge"), "c", "left_anti"))
    fresh = store.add(batch, "index", new.select("c", "n", "p").join(unseen.hint("merge"), "c", "left_semi").dropDuplicates(["c"]))
    texts = store.read("texts").select("c", "text").union(new.select("c", "text"))
    pairs = store.add(batch, "pairs", _new_pairs(fresh, stored, texts))
    touched = written(docs.select("run_id").distinct())
    here = written(store.read("docs").drop("batch").join(touched.hint("merge"), "run_id", "left_semi").union(docs))
    # classes are named by text digests in the store and by a page of theirs in the edge rules
    names = written(here.where("class IS NOT NULL").groupBy("class").agg(F.min("doc").alias("rep")).withColumn("c", F.xxhash64("class")))
    members = written(here.join(names.select("class", "rep").hint("merge"), "class").select(F.col("doc").alias("id"), "rep").distinct())
    all_pairs = store.read("pairs").drop("batch").union(pairs)
    named = all_pairs.join(names.select(F.col("c").alias("a"), F.col("rep").alias("x")).hint("merge"), "a").join(names.select(F.col("c").alias("b"), F.col("rep").alias("y")).hint("merge"), "b")
    edges = written(merge_edges(here, owners, members, written(named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard"))))
    before = store.sources().join(touched.hint("merge"), "run_id", "left_semi").select("run_id", "doc", "source")
    named_now = written(here.select("run_id", "doc").join(before.hint("merge"), ["run_id", "doc"], "left").select("run_id", "doc", F.coalesce("source", "doc").alias("old")))
    end = lambda c, to: named_now.select("run_id", F.col("doc").alias(c), F.col("old").alias(to)).hint("merge")
    across = written(edges.join(end("a", "u"), ["run_id", "a"]).join(end("b", "v"), ["run_id", "b"]).where("u != v").select("run_id", "u", "v").distinct())
    merged = connected_components(across, "u", "v", keys=("run_id",)).withColumnRenamed("node", "old")
    now = written(named_now.join(merged.hint("merge"), ["run_id", "old"], "left").select("run_id", "doc", F.coalesce("component", "old").alias("source")))
    ranks = edges.select("run_id", F.col("a").alias("doc"), "rank").join(now.hint("merge"), ["run_id", "doc"]).groupBy("run_id", "source").agg(F.min("rank").alias("rank"))
    store.add(batch, "sources", now.join(ranks.hint("merge"), ["run_id", "source"], "left").select("run_id", "doc", "source", F.col("rank").cast("int")))
    store.complete(batch)


def keep_independent(pages: DataFrame, store: Store, owners: DataFrame, checkpoint: str) -> StreamingQuery:
    """Start a stream that folds every micro-batch of ``pages`` into the store; a restart goes on where the marks end."""
    return pages.writeStream.foreachBatch(lambda df, n: fold_in(df, n, store, owners)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
