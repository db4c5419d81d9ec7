"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bylines.llm.texts import text_or_empty
from bylines.scratch import written

SAMPLES = 64
LANE = 8  # samples of a term that one row computes; more would outgrow what the JVM compiles
WIDTH = 4  # hex digits that a sample keeps in the fingerprint
BUCKETS = 1024  # bound of the neighbour buckets, so of the cut points that the driver sees
BUCKET_ROWS = 2_000


def sample_value(term: Column, log_weight: Column, seed: Column) -> Column:
    """ln a of a consistent weighted sample of one term: the term with the least value wins.

    r and c are Gamma(2, 1), each minus the log of two uniforms from one hash, beta is uniform;
    t = floor(ln w / r + beta) is the level the weight reaches and a = c / (y e^r) with
    ln y = r (t - beta). Terms of two documents win with one value exactly when they are one term at
    one level, which happens with the probability of the generalised Jaccard similarity. ``seed``
    is a multiple of 3, one for each sample.
    """
    mask = F.lit(0xFFFFFFFF).cast("long")

    def gamma(seed: Column) -> Column:
        h = F.xxhash64(term, seed)
        return F.lit(64 * math.log(2)) - F.log((F.shiftrightunsigned(h, 32) + F.lit(0.5)) * (h.bitwiseAND(mask) + F.lit(0.5)))

    r, c = gamma(seed), gamma(seed + 1)
    beta = F.shiftrightunsigned(F.xxhash64(term, seed + 2), 11) * F.lit(2.0**-53)
    return F.log(c) - r * (F.floor(log_weight / r + beta) - beta + F.lit(1.0))


def terms(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def signatures(df: DataFrame, keys: list[str], text: Column, samples: int = SAMPLES) -> DataFrame:
    """(keys, sig array<int>): one number of WIDTH hex digits for each sample of the words of ``text`` weighted by their counts.

    If ``df`` is dealt by some of ``keys`` already, nothing is shuffled. Rows that agree in
    ``keys`` are one document. A text without words has one pseudo-term of its own. Each distinct
    term of a document becomes one row for each lane of LANE samples.
    """
    words = df.select(*keys, F.explode_outer(terms(text)).alias("w"))
    counts = words.groupBy(*keys, F.xxhash64("w").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    lanes = counts.select(*keys, "term", F.log("n").alias("lw"), F.explode(F.array(*[F.lit(3 * k) for k in range(0, samples, LANE)])).alias("lane"))
    least = lanes.groupBy(*keys, "lane").agg(*[F.min(sample_value(F.col("term"), F.col("lw"), F.col("lane") + 3 * k)).alias(f"m{k}") for k in range(LANE)])
    cut = F.lit((1 << (4 * WIDTH)) - 1).cast("long")
    part = F.array(*[F.xxhash64(f"m{k}").bitwiseAND(cut).cast("int") for k in range(LANE)])
    parts = least.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lane", part.alias("part")))).alias("parts"))
    return parts.select(*keys, F.slice(F.flatten(F.transform("parts", lambda p: p["part"])), 1, samples).alias("sig"))


def as_hex(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), WIDTH, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of samples in which two signatures agree: an estimate of the generalised Jaccard similarity."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return same / F.size(a)


def neighbour_buckets(df: DataFrame, id_col: str, rows: int) -> Column:
    """A bucket for each id, in the order of ids, with about BUCKET_ROWS rows or at most BUCKETS buckets; nulls come first."""
    n = max(1, min(BUCKETS, rows // BUCKET_ROWS))
    cuts = df.select(F.percentile_approx(id_col, [i / n for i in range(1, n)], 10 * n)).head()[0] if n > 1 else []
    cuts = sorted(set(cuts or []))

    def place(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(id_col) <= cuts[mid], place(lo, mid)).otherwise(place(mid + 1, hi))

    return F.when(F.col(id_col).isNull(), F.lit(0)).otherwise(place(0, len(cuts)))


def edited_text(text: Column, following: Column) -> Column:
    """``text`` with its last half, rounded down, replaced by as many first code points (or all) of ``following``."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprint_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(id, text hash, n_chars, sig, edited_sha256, edited_sig, next_sig) for every row.

    The next row is the one with the next id (after the last: the first); rows with equal ids are
    ordered by text and null ids come first. Rows are dealt once, into buckets of adjacent ids, and
    words, counts and samples of a row are made where it lies. The first row of each bucket, at
    most BUCKETS of them, is all that buckets need of each other.
    """
    t = text_or_empty(text_col)
    docs = df.select(F.col(id_col).alias("id"), t.alias("text"))
    rows = df.select(F.count(F.lit(1))).head()[0]
    bucket = neighbour_buckets(docs, "id", rows)
    parts = max(1, min(BUCKETS, rows // BUCKET_ROWS))

    first_ids = written(docs.groupBy(bucket.alias("bucket")).agg(F.min(F.struct(F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63))).alias("o"), F.col("id"))).alias("f")).select("bucket", "f.id"))
    heads = docs.withColumn("bucket", bucket).join(F.broadcast(first_ids.withColumnRenamed("bucket", "b").withColumnRenamed("id", "i")), F.col("id").eqNullSafe(F.col("i")) & (F.col("bucket") == F.col("b")))
    heads = heads.groupBy("bucket").agg(F.min("text").alias("text"))
    around = Window.partitionBy(F.lit(0)).orderBy("bucket")
    every = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def before(table: DataFrame, value: str) -> DataFrame:
        """The head that follows each bucket; after the last one comes the first."""
        return written(table.select(F.col("bucket").alias("b"), F.coalesce(F.lead(value).over(around), F.first(value).over(every)).alias("head")))

    inner = Window.partitionBy("bucket").orderBy(F.col("id").asc_nulls_first(), "text")
    dealt = docs.withColumn("bucket", bucket).repartition(parts, "bucket")
    led = dealt.select("bucket", "id", "text", F.row_number().over(inner).alias("place"), F.lead("text").over(inner).alias("following"))
    led = led.join(before(heads, "text").hint("shuffle_hash"), F.col("bucket") == F.col("b"), "left")
    led = led.withColumn("edited", edited_text(F.col("text"), F.coalesce("following", "head", F.lit(""))))
    facts = led.select("bucket", "place", "id", F.xxhash64("text").alias("key"), F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    both = led.select("bucket", "place", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("x")).select("bucket", "place", "x.*")
    sigs = signatures(both, ["bucket", "place", "kind"], F.col("t"), samples)
    pick = lambda k: F.first(F.when(F.col("kind") == k, F.col("sig")), ignorenulls=True)
    pairs = sigs.groupBy("bucket", "place").agg(pick(0).alias("sig"), pick(1).alias("edited_sig"))
    table = written(facts.hint("merge").join(pairs, ["bucket", "place"]))

    firsts = before(table.where("place = 1").select("bucket", "sig"), "sig")
    by_place = Window.partitionBy("bucket").orderBy("place")
    out = table.withColumn("following", F.lead("sig").over(by_place)).join(firsts.hint("shuffle_hash"), F.col("bucket") == F.col("b"), "left")
    return out.select(F.col("id").alias(id_col), "key", "n_chars", "edited_sha256", "sig", "edited_sig", F.coalesce("following", "head").alias("next_sig"))
