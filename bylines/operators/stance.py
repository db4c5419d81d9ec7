"""Ranking, stance and fusion of claims with evidence."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bylines.functions.text import first_that, let, long_words
from bylines.schemas import BACKED, CONTESTED, MAX_EVIDENCE, NEGATIONS, SAME_ARTICLE, STANCE_THRESHOLD
from bylines.scratch import written

LOCAL_CELLS = 4_000_000  # bound of claims x grams that a task holds as a matrix


def collapsed(text_col: str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.col(text_col)), r"(?: [\s\x0B]|[\t-\r])[\s\x0B]*+", " "))  # single blanks stay as they are


def trigrams(text: str) -> np.ndarray:
    """The text's runs of three characters, each as one number."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:]


def trigram_bucket(gram: int, buckets: int) -> int:
    return crc32("".join(chr(gram >> k & 0x1FFFFF) for k in (42, 21, 0)).encode("utf-8")) % buckets


def trigram_vectors(rows: DataFrame, id_col: str, text_col: str, buckets: int | None = None) -> DataFrame:
    """(id, gram, w): character trigrams of the lower-cased text with white space collapsed, counts scaled to length 1.

    With ``buckets``, grams are numbers below it by crc32, so vectors agree between processes.
    """
    chars = rows.select(F.col(id_col).alias("id"), F.split(collapsed(text_col), "").alias("c"))
    grams = chars.where(F.size("c") >= 3).select("id", F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 3), lambda i: F.concat(F.get("c", i), F.get("c", i + 1), F.get("c", i + 2)))).alias("gram"))
    if buckets:
        grams = grams.withColumn("gram", F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(buckets)))
    counts = grams.groupBy("id", "gram").agg(F.count(F.lit(1)).alias("n"))
    norm = counts.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norm.hint("merge"), "id").select("id", "gram", (F.col("n") / F.col("norm")).alias("w"))


def trigram_top(claims: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, buckets: int | None = None, cells: int = LOCAL_CELLS) -> DataFrame:
    """(claim, doc, score, rank): for each claim the ``k`` documents whose whole texts have the greatest cosine of trigram vectors.

    ``claims`` are ``trigram_vectors`` that are written. Up to ``cells`` of claims x grams, each task
    holds them as a matrix and keeps its own ``k`` best of each claim, which the best of all are
    among; beyond, claims and documents meet on their grams. Only pairs that share a gram count.
    """
    order = [F.col("score").desc(), F.col("doc")]
    size = claims.agg(F.countDistinct("id"), F.countDistinct("gram")).head()
    if size[0] * size[1] > cells:
        c, d = claims.select(F.col("id").alias("claim"), "gram", F.col("w").alias("wc")), trigram_vectors(docs, id_col, text_col, buckets)
        met = d.select(F.col("id").alias("doc"), "gram", "w").hint("merge").join(c, "gram").groupBy("claim", "doc").agg(F.round(F.sum(F.col("w") * F.col("wc")), 6).alias("score"))
        return top_k(met, "claim", order, k)
    vectors = claims.toArrow()
    names, who = np.unique(vectors.column("id").to_numpy(), return_inverse=True)
    at: dict = {}
    where = [at.setdefault(g, len(at)) for g in vectors.column("gram").to_pylist()]
    matrix = np.zeros((len(at), len(names)))
    matrix[where, who] = vectors.column("w").to_numpy()
    # a document's grams have three characters, so others of a claim meet none
    numbers = {g if buckets else int(trigrams(g)[0]): row for g, row in at.items() if buckets or len(g) == 3}
    known = np.sort(np.fromiter(numbers, np.int64, len(numbers)))
    shared = docs.sparkSession.sparkContext.broadcast((names, known, np.array([numbers[g] for g in known.tolist()], np.int64), matrix))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known, place, matrix = shared.value
        hashes: dict[int, int] = {}
        scores, ids = np.full((len(names), k), -np.inf), np.zeros((len(names), k), np.int64)

        def bucket(g: int) -> int:
            if (h := hashes.get(g)) is None:
                h = trigram_bucket(g, buckets)
                if len(hashes) < 200_000:
                    hashes[g] = h
            return h

        for b in batches:
            for begin in range(0, b.num_rows, 100):
                part = b.slice(begin, 100)
                x = np.zeros((part.num_rows, len(matrix)))
                for i, t in enumerate(part.column(1).to_pylist()):
                    g = np.sort(trigrams(t))
                    if not len(g) or not len(known):
                        continue
                    first = np.flatnonzero(np.diff(g, prepend=-1))
                    g, counts = g[first], np.diff(first, append=len(g))
                    if buckets:
                        n = np.bincount(np.fromiter(map(bucket, g.tolist()), np.int64, len(g)), counts, buckets)
                        g = np.flatnonzero(n)
                        counts = n[g].astype(np.int64)
                    met = np.minimum(np.searchsorted(known, g), len(known) - 1)
                    hit = known[met] == g
                    x[i, place[met[hit]]] = counts[hit] / int(counts @ counts) ** 0.5
                got = (x @ matrix).T
                got = np.where(got > 0, np.round(got, 6), -np.inf)
                scores = np.concatenate([scores, got], axis=1)
                ids = np.concatenate([ids, np.broadcast_to(part.column(0).to_numpy(), got.shape)], axis=1)
                first = np.lexsort((ids, -scores), axis=-1)[:, :k]
                scores, ids = np.take_along_axis(scores, first, 1), np.take_along_axis(ids, first, 1)
        c, i = np.nonzero(scores > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(names[c], pa.int64()), pa.array(ids[c, i]), pa.array(scores[c, i])], names=["claim", "doc", "score"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc"), collapsed(text_col).alias("t")).where("t IS NOT NULL AND doc IS NOT NULL")
    return top_k(texts.mapInArrow(best, "claim long, doc long, score double"), "claim", order, k)


def top_k(scored: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def stance_window(evidence: DataFrame, most: int = MAX_EVIDENCE, has_text: Column | None = None) -> DataFrame:
    """The first ``most`` documents with text of each claim by ``score``; source_id numbers the unfiltered ranking."""
    has_text = F.trim("premise") != "" if has_text is None else has_text
    order = Window.partitionBy("claim").orderBy(F.col("score").desc(), "doc")
    ranked = evidence.withColumn("position", F.row_number().over(order)).withColumn("source_id", F.concat(F.lit("s"), F.col("position").cast("string")))
    return ranked.where(has_text).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def lexical_stance(premise: Column, claim: Column) -> Column:
    """struct(label, score): word overlap leans to entailment, a one-sided negation with overlap to contradiction.

    This reads words, not polarity; finding no contradiction says nothing about there being none.
    """
    cues = F.array(*[F.lit(w) for w in NEGATIONS])
    out = lambda label, score: F.struct(F.lit(label).alias("label"), F.round(score, 6).alias("score"))

    def of(x: Column) -> Column:
        p, h, overlap = x["p"], x["h"], F.size(F.array_intersect(x["p"], x["h"])) / F.greatest(F.size(x["h"]), F.lit(1))
        one_sided = F.arrays_overlap(p, cues) != F.arrays_overlap(h, cues)
        return (
            F.when((F.size(p) == 0) | (F.size(h) == 0), out("neutral", F.lit(0.5)))
            .when(one_sided & (overlap > 0.3), out("contradiction", F.lit(0.6)))
            .when(overlap >= 0.45, out("entailment", F.least(0.58 + overlap * 0.3, F.lit(0.85))))
            .otherwise(out("neutral", F.greatest(F.lit(0.4), 1 - overlap)))
        )

    return let(F.struct(long_words(premise).alias("p"), long_words(claim).alias("h")), of)


def by_newsroom(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """``pairs(run_id, doc, ...)`` with source and missed: the independent source that ``sources(run_id, doc, source)`` puts a document in.

    A document that no source holds is one of its own, which counts too many rather than too few,
    and says so in ``missed``; a run without any sources misses all its documents. A document stands once in ``sources``.
    """
    known = sources.select("run_id", "doc", F.concat(F.lit("source "), F.col("source").cast("string")).alias("_s"))
    met = pairs.join(known.hint("merge"), ["run_id", "doc"], "left")
    return met.withColumn("source", F.coalesce("_s", F.concat(F.lit("page "), F.col("doc").cast("string")))).withColumn("missed", F.col("_s").isNull()).drop("_s")


def join_misses(joined: DataFrame) -> DataFrame:
    """(run_id, documents, sources, misses) of each run."""
    return joined.groupBy("run_id").agg(F.countDistinct("doc").alias("documents"), F.countDistinct("source").alias("sources"), F.countDistinct(F.when(F.col("missed"), F.col("doc"))).alias("misses"))


def direction(support: Column, contradict: Column) -> Column:
    return first_that([((support == 0) & (contradict == 0), "none"), (contradict > support, "contradict"), (support > contradict, "support")], "mixed")


def fuse_claims(claims: DataFrame, pairs: DataFrame, existence: DataFrame, threshold: float = STANCE_THRESHOLD) -> DataFrame:
    """One row for each claim: distinct newsrooms for and against by engine, directions, agreement and state.

    pairs(run_id, claim, doc, source, label, score, analyst): ``analyst`` is support, contradict, unrelated or
    null where no analyst took part. Directions count documents, states count newsrooms. A claim
    without pairs is not assessed, which is not the same as nothing found.
    """
    by = lambda cond: F.countDistinct(F.when(cond, F.col("source")))
    n = lambda cond: F.countDistinct(F.when(cond, F.col("doc")))
    sure = F.col("score") >= threshold
    up, down = sure & (F.col("label") == "entailment"), sure & (F.col("label") == "contradiction")
    a_up, a_down = F.coalesce(F.col("analyst") == "support", F.lit(False)), F.coalesce(F.col("analyst") == "contradict", F.lit(False))
    sums = pairs.groupBy("run_id", "claim").agg(
        F.count(F.lit(1)).alias("pairs"), by(up).alias("nli_support"), by(down).alias("nli_contradict"), by(a_up).alias("llm_support"), by(a_down).alias("llm_contradict"),
        by(up | a_up).alias("support"), by(down | a_down).alias("contradict"), direction(n(up), n(down)).alias("nli"), direction(n(a_up), n(a_down)).alias("llm"), F.bool_or(F.col("analyst").isNotNull()).alias("took_part"),
    )
    row = claims.select("run_id", "claim").join(sums, ["run_id", "claim"], "left").join(existence, "run_id", "left")
    row = row.fillna(0, ["pairs", "nli_support", "nli_contradict", "llm_support", "llm_contradict", "support", "contradict"]).fillna("none", ["nli", "llm"]).fillna(False, ["took_part"])
    nli, llm = F.col("nli"), F.when(F.col("took_part"), F.col("llm")).otherwise("none")
    agreement = first_that([
        ((nli == "none") & (llm == "none"), "none"), (llm == "none", "nli_only"), (nli == "none", "llm_only"), (nli == llm, "convergent"),
    ], "contested")
    row = row.withColumn("agreement", agreement)
    s, c = F.col("support"), F.col("contradict")
    state = first_that([
        (F.col("pairs") == 0, "not_assessed"), ((c >= 1) & (s >= 1), "contested_reporting"), (c >= 2, "contested_reporting"),
        (F.col("existence").isin(SAME_ARTICLE) & (F.col("agreement") == "convergent") & (s >= 1), "corroborated_coverage"),
        (s >= 2, "event_corroborated"), (s == 1, "single_source"), (F.col("agreement") == "contested", "contested"),
    ], "no_corroboration_found")
    return row.select("run_id", "claim", "existence", "nli_support", "nli_contradict", "llm_support", "llm_contradict", "support", "contradict", "agreement", state.alias("state"))


def overall_state(fused: DataFrame) -> DataFrame:
    some = lambda c: F.bool_or(c)
    st = F.col("state")
    return fused.groupBy("run_id").agg(first_that([
        (F.bool_and(st == "not_assessed"), "not_assessed"), (some(st == "contested_reporting"), "contested_reporting"), (some(F.col("agreement") == "contested"), "contested"),
        (some(st == "corroborated_coverage"), "corroborated_coverage"), (some(st == "event_corroborated"), "event_corroborated"), (some(st == "single_source"), "single_source"),
    ], "no_corroboration_found").alias("state"))


def support_rate(fused: DataFrame) -> DataFrame:
    """Counts and the half-even share of scored claims that are backed; null with a reason where it does not apply.

    Of a run whose article is out of range nothing counts as scored, whatever was. ``fused`` holds the claims
    of runs; a row with a null state stands for a run without any claim.
    """
    out = fused.groupBy("run_id").agg(
        F.count("state").alias("claims"), F.count_if(F.col("state") != "not_assessed").alias("s"), F.count_if(F.col("state").isin(BACKED)).alias("b"), F.count_if(F.col("state").isin(CONTESTED)).alias("c"),
        F.coalesce(F.bool_or(F.col("existence") == "out_of_range"), F.lit(False)).alias("beyond"),
    )
    why = F.when(F.col("claims") == 0, "no_claims").when(F.col("beyond"), "out_of_range").when(F.col("s") == 0, "not_assessed")
    known = lambda c: F.when(why.isNull(), F.col(c)).otherwise(0)
    pct = F.when(why.isNull(), F.bround(F.try_divide(100 * F.col("b"), F.col("s")))).cast("int")
    return out.select("run_id", known("s").alias("scored"), known("b").alias("backed"), known("c").alias("contested"), (F.col("claims") - known("s")).alias("unassessed"), pct.alias("support_pct"), why.alias("omitted_because"))


def vector_top_k(vectors: DataFrame, id_col: str, vec_col: str, every: int = 20, k: int = 5, block: int = 50_000, share: int = 100_000) -> DataFrame:
    """(query, neighbour, rank, cosine): for ids divisible by ``every``, the ``k`` nearest of all other rows.

    The stated query set meets all rows block by block: queries are dealt into blocks of about ``block`` and
    rows into shares of about ``share``; a task multiplies a block by a share, as matrices of bounded size, and only
    its k best per query move. The work is that of all pairs, and so quadratic; memory is not.
    """
    norm = F.sqrt(F.aggregate(vec_col, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = written(vectors.where((F.size(vec_col) > 0) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double") / norm).alias("v")))
    asked = unit.where(F.col("id") % every == 0)
    blocks = max(1, -(-asked.count() // block))
    shares = max(8, -(-unit.count() // share))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = asked.select("id", "v", deal(blocks).alias("block"), each(shares).alias("share"))
    rows = unit.select("id", "v", each(blocks).alias("block"), deal(shares).alias("share"))
    schema = "query long, neighbour long, cosine double"

    def best(q: pa.Table, r: pa.Table) -> pa.Table:
        out = []
        if q.num_rows and r.num_rows:
            r = r.sort_by("id")  # of equal cosines the smallest ids come first
            ids, qids = r.column("id").to_numpy(), q.column("id").to_numpy()
            sizes = pc.list_value_length(r.column("v")).to_numpy()
            of_size = pc.list_value_length(q.column("v")).to_numpy()
            for d in np.unique(of_size):
                inside, asking = np.flatnonzero(sizes == d), np.flatnonzero(of_size == d)
                if not len(inside):
                    continue
                matrix = lambda t, at: pc.list_flatten(t.column("v").take(pa.array(at))).to_numpy().reshape(len(at), d)  # noqa: E731, B023
                m = matrix(r, inside)
                for begin in range(0, len(asking), 64):
                    at = asking[begin : begin + 64]
                    c = matrix(q, at) @ m.T
                    c[ids[inside][None, :] == qids[at][:, None]] = -np.inf
                    n = min(k, c.shape[1])
                    least = np.partition(c, c.shape[1] - n, axis=1)[:, -n]
                    for j, row in enumerate(c):
                        near = np.flatnonzero((row >= least[j] - 2e-6) & (row > -np.inf))  # what rounds to the same counts as equal
                        score = np.round(row[near], 6) + 0.0
                        first = np.argsort(-score, kind="stable")[:k]
                        out.append((np.full(len(first), qids[at[j]]), ids[inside][near[first]], score[first]))
        cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.table({"query": cols[0], "neighbour": cols[1], "cosine": cols[2]})

    local = queries.groupBy("block", "share").cogroup(rows.groupBy("block", "share")).applyInArrow(best, schema)
    return top_k(local, "query", [F.col("cosine").desc(), F.col("neighbour")], k)
