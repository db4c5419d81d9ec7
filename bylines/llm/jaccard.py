"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence with size-derived bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bylines.llm.texts import give_back_memory
from bylines.operators.components import connected_components
from bylines.scratch import written

WORDS = 3  # of an n-gram
PER_CENT = 90  # least Jaccard similarity
FREQUENT = 250_000  # n-grams whose frequency every task knows; others count as rare, which costs time, never results
SAMPLE_GRAMS = 1_000_000  # n-grams of a task that are counted together
FILTER_BITS = 1 << 26  # of the filter of documents whose sets are needed
LONG_WORD = 64  # bytes
STRETCH = 1 << 20  # bytes that are hashed at once
TEXTS = 200  # that a task cuts at once
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]  # odd numbers


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _byte_values() -> np.ndarray:
    """A 64-bit number for each byte; A-Z have those of a-z."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) * _MIX[0])
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


_VALUE = _byte_values()
_PLACE = np.cumprod(np.full(LONG_WORD, _MIX[1]))  # powers, modulo 2^64
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts, how many words each text has).

    Words stand between ASCII white space, A-Z count as a-z. A word's bytes, each weighed by its place, are
    summed for all words at once; words beyond LONG_WORD bytes are hashed one by one.
    """
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    hashes, counts = [], np.zeros(len(texts), np.int64)
    at = 0
    while at < len(buf):
        to = len(buf)
        if to - at > STRETCH:  # a stretch ends behind a blank
            found = np.flatnonzero(_BLANK[buf[at : at + STRETCH]])
            k = at + STRETCH
            while not len(found):
                found = k - at + np.flatnonzero(_BLANK[buf[k : k + STRETCH]])
                k += STRETCH
            to = at + int(found[-1]) + 1
        part = buf[at:to]
        blank = _BLANK[part]
        edges = np.flatnonzero(np.diff(blank, prepend=True))
        starts, sizes = edges[0::2], np.diff(edges)[0::2]
        if len(starts):
            first = np.cumsum(sizes) - sizes
            held = part[~blank]
            place = np.minimum(np.arange(len(held)) - np.repeat(first, sizes), LONG_WORD - 1)
            h = mixed(np.add.reduceat(_VALUE[held] * _PLACE[place], first) + sizes.astype(np.uint64) * _MIX[2])
            for i in np.flatnonzero(sizes > LONG_WORD):
                h[i] = xxhash.xxh64_intdigest(part[starts[i] : starts[i] + sizes[i]].tobytes().lower(), 42)
            hashes.append(h)
            counts += np.bincount(np.searchsorted(text_ends, starts + at, side="right"), minlength=len(texts))
        at = to
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts


class Grams:
    """Distinct n-grams of texts as sorted 64-bit hashes."""

    def __init__(self, n: int = WORDS):
        self.n = n

    def _hashed(self, h: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all runs of n words."""
        if len(h) < n:
            return np.zeros(0, np.int64)
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = mixed((out + h[k : len(h) - n + 1 + k]) * _MIX[k % 3])
        return out.view(np.int64)

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """Fewer than n words are one gram of all; no words give none."""
        h, sizes = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts])
        runs, out, at = self._hashed(h, self.n), [], 0
        for size in sizes.tolist():
            s = np.sort(runs[at : at + size - self.n + 1] if size >= self.n else self._hashed(h[at : at + size], size) if size else runs[:0])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
            at += size
        return out


def key_of(grams: np.ndarray) -> bytes | None:
    """A 128-bit name of a set of n-grams; the empty set has none."""
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def prefix_size(n: int, per_cent: int) -> int:
    """How many of its rarest n-grams a set of n indexes: of two similar sets each has one of them in common with the other's."""
    return n - -(-per_cent * n // 100) + 1


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def frequent_grams(docs: DataFrame, words: int, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, frequency) of at most ``most`` n-grams that occur in many documents, over the whole table.

    Tasks count the n-grams of runs of SAMPLE_GRAMS and send those that occur twice or more there; of the sums,
    those above the least power of two that leaves at most ``most`` are kept. Any table gives the
    same results: it sets the order in which n-grams are indexed, and so how many candidates there are.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, held, size = Grams(words), [], 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1]), pa.array(n[n > 1].astype(np.int64))], names=["h", "n"])

        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                held += grams.of(b.column(0).slice(at, TEXTS).to_pylist())
                size += sum(map(len, held[-TEXTS:]))
                if size >= SAMPLE_GRAMS:
                    yield flush()
                    held, size = [], 0
            give_back_memory()
        if held:
            yield flush()

    sums = written(docs.select("_t").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    by_power = {r["p"]: r["c"] for r in sums.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()}  # 64 rows at most
    least, total = 64, 0
    for p in sorted(by_power, reverse=True):
        total += by_power[p]
        if total > most:
            break
        least = p
    kept = sums.where(F.col("n") >= F.lit(1 << least if least < 63 else (1 << 63) - 1)).toPandas()  # ``most`` rows at most
    kept = kept.sort_values("h")
    return kept["h"].to_numpy(np.int64), kept["n"].to_numpy(np.int64)


def indexed_rows(docs: DataFrame, words: int, per_cent: int, table: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, key, n, prefix, r): the name and size of each row's set, its rarest n-grams, rarest first, and the frequency of the last of them."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    schema = docs.select("id").schema.add("key", "binary").add("n", "integer").add("prefix", T.ArrayType(T.LongType())).add("r", "long")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, (hashes, freq) = Grams(words), shared.value
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                keys, sizes, prefixes, last = [], [], [], []
                for s in grams.of(part.column(1).to_pylist()):
                    keys.append(key_of(s))
                    sizes.append(len(s))
                    rank = np.zeros(len(s), np.int64)
                    if len(hashes) and len(s):
                        i = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                        rank = np.where(hashes[i] == s, freq[i], 0)
                    order = np.argsort(rank, kind="stable")[: prefix_size(len(s), per_cent)] if len(s) else []
                    prefixes.append(s[order] if len(s) else s)
                    last.append(int(rank[order[-1]]) if len(s) else 0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), _lists(prefixes), pa.array(last, pa.int64())], names=schema.names)
            give_back_memory()

    return docs.select("id", "_t").mapInArrow(apply, schema)


def wanted_sets(docs: DataFrame, words: int, wanted: DataFrame) -> DataFrame:
    """(key, s) for each row of ``wanted(id, key)``: its set of n-grams, made again from the texts.

    A filter of fixed size tells tasks which ids to look at, so most texts are neither cut nor
    sent; a crowded filter lets more through, and the join with ``wanted`` decides.
    """
    spot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    bits = wanted.select(F.shiftright(spot, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(spot, F.lit(64)).cast("int")).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[bits["at"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    schema = docs.select("id").schema.add("key", "binary").add("s", T.ArrayType(T.LongType()))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, filled = Grams(words), shared.value.view(np.uint64)
        for b in batches:
            at = b.column(2).to_numpy()
            inside = np.flatnonzero((filled[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1))
            for i in range(0, len(inside), TEXTS):
                part = b.take(pa.array(inside[i : i + TEXTS]))
                sets = grams.of(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([key_of(s) for s in sets], pa.binary()), _lists(sets)], names=schema.names)
            give_back_memory()

    found = docs.select("id", "_t", spot.alias("spot")).mapInArrow(apply, schema)
    return found.join(wanted.select("key").hint("merge"), "key", "left_semi").groupBy("key").agg(F.first("s").alias("s"))


def _needed(na: Column, nb: Column, per_cent: int) -> Column:
    """Least overlap of two sets of these sizes at the similarity."""
    return F.ceil((na + nb) * per_cent / F.lit(100 + per_cent) - 1e-9)


def _product(a: DataFrame, b: DataFrame, per_cent: int, apart: Column) -> DataFrame:
    """(a, b) whose sets may be similar, of two blocks of the index(h, key, n, i, j, r, e, w), as keys.

    Rows of one column multiply; a cell's overlaps add up over the columns, each of which stands for w. At each common column the places i tell
    how many more n-grams two sets can share behind it, j how many columns that others have too they can share before, and
    sizes how many they must share: pairs below are discarded, first by each column alone. In the end all that two sets share up to the place where the index of one of them stops
    has been counted, so what may follow is what that one has left; pairs that miss their number with it are discarded too.
    """
    mine = ("key", "n", "i", "j", "r", "e", "w")
    more = [c for c in a.columns if c not in ("h", *mine)]
    x = a.select("h", F.col("key").alias("a"), *[F.col(c).alias(f"{c}a") for c in (*mine[1:], *more)])
    y = b.select("h", F.col("key").alias("b"), *[F.col(c).alias(f"{c}b") for c in (*mine[1:], *more)])
    need = _needed(F.col("na"), F.col("nb"), per_cent)
    close = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * per_cent) & (F.least("ja", "jb") + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= need)
    cells = x.hint("merge").join(y, "h").where(apart & close)
    left = lambda n: F.col(n) - (F.col(n) - F.ceil(F.col(n) * per_cent / F.lit(100) - 1e-9) + 1)
    first = F.when(F.struct("ra", "ea") < F.struct("rb", "eb"), left("na")).when(F.struct("ra", "ea") > F.struct("rb", "eb"), left("nb")).otherwise(F.least(left("na"), left("nb")))
    return cells.groupBy("a", "b", "na", "nb", first.alias("after")).agg(F.sum("wa").alias("c")).where(F.col("c") + F.col("after") >= need).select("a", "b", "na", "nb")


def similar_pairs(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """(a, b, common) of the pairs that are similar, exactly."""
    left = pairs.hint("merge").join(sets.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a")
    both = left.hint("merge").join(sets.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b")
    found = both.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("common"))
    return found.where(F.col("common") * (100 + per_cent) >= (F.col("na") + F.col("nb")) * per_cent).select("a", "b", "na", "nb", "common")


def similar_sets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, per_cent: int = PER_CENT, every_link: bool = True) -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, key, n) for each row, and (a, b, na, nb, common) for pairs of similar sets, by key.

    The incidence matrix has a row for each distinct set, as equal texts share a key, and is cut into
    blocks of columns. The first block holds each set's rarest n-grams, as many as two similar sets
    cannot both do without; its product with itself gives the pairs and part of their overlap. Bounds
    from the sizes discard most pairs; the other columns are multiplied for the rest only. Columns of the same
    sets are one column of their number at the first one's places, so that near copies meet once and not in each n-gram.

    With ``every_link`` false, the links have the same connected components but not all pairs: first
    every column's sets meet the one of them that has the fewest rarer n-grams of its own, and sets that are
    similar to the same one meet no more. A large group of near copies then costs a star and not its square.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t"))
    table = frequent_grams(docs, words)
    rows = written(indexed_rows(docs, words, per_cent, table))
    reps = written(rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "r", "prefix")]))
    each = reps.select("key", "n", "r", F.element_at("prefix", -1).alias("e"), F.posexplode("prefix").alias("i", "h"))
    same = [F.bit_xor(F.xxhash64(F.lit(seed), "key")) for seed in (1, 2)]  # a name of the set of a column's rows
    columns = written(each.groupBy("h").agg(F.count(F.lit(1)).alias("f"), *[x.alias(f"x{k}") for k, x in enumerate(same)]).where("f > 1").select("h", F.xxhash64("f", "x0", "x1").alias("g")))
    own = Window.partitionBy("key").orderBy("i")  # a set's few columns
    placed = each.hint("merge").join(columns, "h").withColumn("j", F.row_number().over(own) - 1)
    index = written(placed.groupBy(F.col("g").alias("h"), "key", "n", "r", "e").agg(F.min("i").alias("i"), F.min("j").alias("j"), F.count(F.lit(1)).alias("w")).select("h", "key", "n", "i", "j", "r", "e", "w"))
    members = rows.select("id", "key", "n")

    def similar(a: DataFrame, b: DataFrame, apart: Column) -> DataFrame:
        """The similar ones of two blocks' candidates; only sets that are in a candidate are made again."""
        pairs = written(_product(a, b, per_cent, apart))
        keys = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
        wanted = written(reps.select("id", "key").join(keys.hint("merge"), "key", "left_semi"))
        return written(similar_pairs(pairs, written(wanted_sets(docs, words, wanted)), per_cent))

    if every_link:
        return members, similar(index, index, F.col("a") < F.col("b"))
    chosen = written(index.groupBy("h").agg(F.min(F.struct((F.col("i") - F.col("j")).alias("alone"), "i", "key", "n", "j", "r", "e", "w")).alias("hub"))).select("h", "hub.key", "hub.n", "hub.i", "hub.j", "hub.r", "hub.e", "hub.w")
    star = similar(chosen, index, F.col("a") != F.col("b"))
    ends = star.select("a", F.col("b").alias("key")).union(star.select("a", F.col("a").alias("key")))
    label = written(ends.groupBy("key").agg(F.min("a").alias("label")))
    labelled = written(index.join(label.hint("merge"), "key", "left"))
    apart = (F.col("a") < F.col("b")) & ~F.coalesce(F.col("labela") == F.col("labelb"), F.lit(False))
    return members, star.union(similar(labelled, labelled, apart))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, per_cent: int = PER_CENT) -> DataFrame:
    """(id, n_shingles, component_id) for every row: the smallest id that links of similar texts reach, itself included.

    Texts whose sets of n-grams have a Jaccard similarity of ``per_cent`` or more are linked; equal sets are.
    Null texts and texts without words have no n-grams and no links, so each keeps its own id.
    Repeated rows come out each; an id that is null is reached like others but never is the smallest; an
    empty table gives no rows; other columns are not read. Sets are compared by 64-bit hashes of n-grams.
    """
    members, links = similar_sets(df, id_col, text_col, words, per_cent, every_link=False)
    comps = connected_components(links.select("a", "b"), "a", "b")
    keyed = members.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("least"))
    whole = keyed.join(comps.withColumnRenamed("node", "key").hint("merge"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = written(whole.groupBy("component").agg(F.min("least").alias("component_id")))
    by_key = written(whole.hint("merge").join(least, "component").select(F.col("key").alias("_key"), "component_id"))
    met = members.join(by_key.hint("merge"), F.col("key") == F.col("_key"), "left")
    own = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return met.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))
