"""SimHash near-duplicates by a segment-popcount embedding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bylines.llm.jaccard import similar_sets
from bylines.llm.texts import lower_ascii, text_or_empty
from bylines.operators.components import connected_components
from bylines.scratch import written

SEGMENTS = 16  # of four bits: each count is 0 to 4 and takes one hex digit of a long
SHINGLE_WORDS = 3
DIRECT_CELL = 64  # fingerprints in a cell up to which pairs are compared directly
VIEWS = 12  # fingerprints of a text in tests, which hold simhash_groups against what they find; it uses none itself
NEAR_WORDS, NEAR_PER_CENT = 5, 80  # of shingles, and how many of them near duplicates share


def words(text: Column) -> Column:
    """Words of the text with A-Z lowered, between runs of ASCII white space."""
    return F.filter(F.split(lower_ascii(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles(seq: Column, n: int = SHINGLE_WORDS) -> Column:
    """Space-joined runs of ``n`` words; the whole sequence if it is shorter, none if it is empty."""
    runs = F.transform(F.sequence(F.lit(0), F.size(seq) - n), lambda i: F.concat_ws(" ", *[F.get(seq, i + k) for k in range(n)]))
    short = F.when(F.size(seq) > 0, F.array(F.array_join(seq, " "))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(seq) >= n, runs).otherwise(short)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, copies, fp long) for each distinct pair of id and text: bit k is set when over half of the shingles' XXH64 have it.

    Each hash is cut into 32 words of two lanes, so 32 sums count all 64 bits. The sums of a row
    are made where the row is read, and one row for each document is shuffled. Rows that repeat
    both id and text count together in ``copies``. A null text is empty, and a text without words
    has fingerprint 0.
    """
    t = text_or_empty(text_col)
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(t).alias("_k"), words(t).alias("_w"))
    h = rows.select("id", "_k", F.posexplode_outer(shingles(F.col("_w"))).alias("pos", "s")).select("id", "_k", "pos", F.when(F.col("s").isNotNull(), F.xxhash64("s")).alias("h"))
    lanes = F.lit(0x0000000100000001).cast("long")
    sums = h.groupBy("id", "_k").agg(
        F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("copies"),
        F.count("h").alias("n"),
        *[F.sum(F.shiftrightunsigned("h", k).bitwiseAND(lanes)).alias(f"s{k}") for k in range(32)],
    )
    return sums.select("id", "copies", _bits(F.col("n")).alias("fp"))


def _bits(n: Column) -> Column:
    fp = F.lit(0).cast("long")
    low = F.lit(0xFFFFFFFF).cast("long")
    for k in range(32):
        for half, part in ((k, F.col(f"s{k}").bitwiseAND(low)), (k + 32, F.shiftrightunsigned(f"s{k}", 32))):
            bit = -(1 << 63) if half == 63 else 1 << half
            fp = fp.bitwiseOR(F.when(part * 2 > n, F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return fp


def popcounts(fp: Column) -> Column:
    """Bit counts of the 16 four-bit segments, packed as hex digits of one long (never negative)."""
    one, two = F.lit(0x5555555555555555), F.lit(0x3333333333333333)
    a, b = fp.bitwiseAND(one), F.shiftrightunsigned(fp, 1).bitwiseAND(one)
    pairs = a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))
    return pairs.bitwiseAND(two) + F.shiftrightunsigned(pairs, 2).bitwiseAND(two)


def grid_cells(v: Column) -> Column:
    """The cell of ``v`` and those at Manhattan distance 1: any two points at distance 2 or less share one."""
    cells = [v]
    for s in range(SEGMENTS):
        step = F.lit(1 << (4 * s)).cast("long")
        here = F.shiftrightunsigned(v, 4 * s).bitwiseAND(F.lit(15).cast("long"))
        cells += [F.when(here < 4, v + F.when(here < 4, step).otherwise(0)), F.when(here > 0, v - F.when(here > 0, step).otherwise(0))]
    return F.filter(F.array(*cells), lambda c: c.isNotNull())


def near_links(fps: DataFrame, keys: tuple[str, ...] = (), cells: Callable[[Column], Column] = grid_cells) -> DataFrame:
    """All pairs (``keys``, a, b), a < b, of distinct fingerprints ``fp`` at Hamming distance 2 or less.

    Fingerprints are compared within equal ``keys`` only, which hold no nulls; ``cells`` gives any two
    points at Manhattan distance 2 or less a common cell.

    The Manhattan distance of segment popcounts never exceeds the Hamming distance, so a pair
    within 2 shares a grid cell. In cells of up to DIRECT_CELL fingerprints each pair is verified
    bit by bit. Larger cells never emit their pairs: their fingerprints also take the 65 words
    within one flipped bit, where two fingerprints share a word exactly when they differ in at
    most 2 bits. A word is within one bit of 65 fingerprints at most, so no word has many pairs.
    """
    ks = list(keys)
    keyed = fps.select(*ks, "fp", F.explode(cells(popcounts(F.col("fp")))).alias("cell")).hint("merge")
    counts = written(keyed.groupBy(*ks, "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = written(keyed.join(counts, [*ks, "cell"]))
    small = shared.where(f"n <= {DIRECT_CELL}").drop("n")
    a, b = small.withColumnRenamed("fp", "a"), small.withColumnRenamed("fp", "b")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    direct = a.hint("merge").join(b, [*ks, "cell"]).where((F.col("a") < F.col("b")) & close).select(*ks, "a", "b")
    large = shared.where(f"n > {DIRECT_CELL}").select(*ks, "fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(-(1 << 63) if k == 63 else 1 << k).cast("long")) for k in range(64)])
    words = written(large.select(*ks, "fp", F.explode(flips).alias("word")))
    x, y = words.withColumnRenamed("fp", "a"), words.withColumnRenamed("fp", "b")
    flipped = x.hint("merge").join(y, [*ks, "word"]).where("a < b").select(*ks, "a", "b")
    return direct.union(flipped).distinct()


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row: component_id is the smallest id reachable over fingerprints at distance 2 or less.

    Copies share a fingerprint, so links run between distinct fingerprints only, each standing
    for its smallest id. Rows that repeat id and text come out as often as they came in. Ids
    that are null are reached like others but never are the smallest. An empty table gives no rows.
    """
    rows = written(fingerprints(df, id_col, text_col))
    least = written(rows.groupBy("fp").agg(F.min("id").alias("least")))
    links = near_links(least.select("fp"))
    comps = connected_components(links, "a", "b")
    whole = least.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = written(whole.join(smallest, "component").select("fp", "component_id"))
    each = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy")
    return rows.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id", each).drop("_copy")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) for every row: the smallest id reachable over links between near-duplicate texts.

    Texts are linked if they share NEAR_PER_CENT of their five-word shingles, and no link between different texts is lost:
    fingerprints, however many, miss some, so the pairs come from the exact join of operator 13, at this size and similarity.
    What SimHash links and these shingles confirm is among them. Texts with equal shingles count once; null, empty and blank
    texts have none and are one group. Repeated rows come out each; ids that are null are reached like others but never are
    the smallest. An empty table gives no rows.
    """
    members, links = similar_sets(df, id_col, text_col, NEAR_WORDS, NEAR_PER_CENT, every_link=False)
    rows = members.select("id", F.coalesce("key", F.lit(b"")).alias("node"))
    least = rows.groupBy("node").agg(F.min("id").alias("least"))
    comps = connected_components(links.select("a", "b"), "a", "b")
    whole = written(least.hint("merge").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node")))
    smallest = written(whole.groupBy("component").agg(F.min("least").alias("component_id")))
    by_node = written(whole.join(smallest.hint("merge"), "component").select("node", "component_id"))
    return rows.join(by_node.hint("merge"), "node").select(F.col("id").alias(id_col), "component_id")
