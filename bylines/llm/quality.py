"""Quality classifier: interpolated modified Kneser-Ney character n-grams trained on trusted text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bylines.llm.texts import give_back_memory, text_or_empty
from bylines.scratch import written

ORDER = 4  # characters of 16 bits, so that an n-gram is one long
PAD, AGAIN = "\x02", 0xE000
TRUST_QUANTILE, SLACK = 0.99, 2.0
LOCAL_ROWS = 4_000_000  # model rows, 24 bytes each, up to which each task holds the model
TRUSTED_LOCAL = 4_000_000  # trusted ids up to which the trusted texts are picked without a shuffle
FLUSH_CHARS = 2_000_000
SCORED_CHARS = 250_000  # that are scored at once, or one text; grams and their order take some 60 bytes a character
_DIGIT = re.compile(r"[0-9]")


def grams(text: str) -> np.ndarray:
    """N-grams of the text's characters as 16-bit characters of one long, the latest lowest.

    White space is one blank and a digit is 0; characters beyond 16 bits count as one. A word that
    repeats the one before is a single gram: AGAIN after what stood there in truth, so that a
    run of one word stays as unlikely as its first repeat.
    """
    words = _DIGIT.sub("0", text).split()
    if not words:
        return np.zeros(0, np.int64)
    c = np.frombuffer((PAD * (ORDER - 1) + " ".join(words)).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    c = np.minimum(c, 0xFFFF).astype(np.uint64)
    n = len(c) - ORDER + 1
    g = sum(c[i : i + n] << np.uint64(16 * (ORDER - 1 - i)) for i in range(ORDER))
    if repeats := [i for i in range(1, len(words)) if words[i] == words[i - 1]]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = (np.cumsum(lengths + 1) - lengths - 1)[repeats]
        g[starts] = (g[starts] & ~np.uint64(0xFFFF)) | np.uint64(AGAIN)
        gone = np.zeros(n + 1, np.int64)
        np.add.at(gone, starts + 1, 1)
        np.add.at(gone, starts + lengths[repeats], -1)
        g = g[np.cumsum(gone[:n]) == 0]
    return g.view(np.int64)


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of each FLUSH_CHARS characters or so of a task."""
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            g, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])
        held.clear()

    for b in batches:
        for text, lang in zip(b.column(0), b.column(1), strict=True):
            held.setdefault(lang.as_py(), []).append(g := grams(text.as_py()))
            size += len(g)
            if size >= FLUSH_CHARS:
                yield from flush()
                size = 0
    yield from flush()
    give_back_memory()


def trusted_texts(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """The rows of ``docs`` whose id some label marks 1; ids beyond TRUSTED_LOCAL are joined by a shuffle."""
    ids = written(labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("_id")).where("_id IS NOT NULL").distinct())
    ids = F.broadcast(ids) if ids.count() <= TRUSTED_LOCAL else ids.hint("merge")
    return docs.join(ids, docs[id_col] == ids["_id"], "left_semi")


def kneser_ney(counts: DataFrame) -> DataFrame:
    """Model rows (lang, level, gram, logp, back) from counts (lang, gram, n) of the highest order.

    A row of ``level`` k has the log probability of the last of its k characters after the others
    and, for a gram that is a context of level k + 1, the log weight of backing off. Below the
    highest order a gram counts once for each character it was seen after. The three discounts of
    a level come from its numbers of grams seen once to four times in the language. Contexts meet
    their grams, and grams the shorter ones they end in, by joins sharded on (lang, gram).
    """
    levels = {ORDER: written(counts.select("lang", "gram", "n"))}
    for k in range(ORDER - 1, 0, -1):
        mask = F.lit((1 << (16 * k)) - 1)
        levels[k] = written(levels[k + 1].groupBy("lang", F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    alphabet = written(levels[1].groupBy("lang").agg((F.count(F.lit(1)) + 1).alias("v")))
    model, lower = None, None
    for k in range(1, ORDER + 1):
        seen = levels[k]
        by = seen.groupBy("lang").agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)])
        y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))
        cut = lambda i: F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), F.coalesce(i - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0)), F.lit(0.5))))  # noqa: B023, E731
        cuts = by.withColumn("y", F.coalesce(y, F.lit(0.5))).select("lang", *[cut(i).alias(f"d{i}") for i in (1, 2, 3)])
        context = F.shiftrightunsigned("gram", 16)
        stats = seen.groupBy("lang", context.alias("ctx")).agg(F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("m1"), F.count_if(F.col("n") == 2).alias("m2"), F.count_if(F.col("n") > 2).alias("m3"))
        stats = stats.join(F.broadcast(cuts), "lang")  # one row for each language
        stats = written(stats.withColumn("back", (F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("total")))
        off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        at = seen.withColumn("ctx", context).withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << (16 * (k - 1))) - 1)))
        met = at.join(stats.hint("merge"), ["lang", "ctx"])
        if k == 1:
            met = met.join(F.broadcast(alphabet), "lang").withColumn("below", 1 / F.col("v"))
        else:
            met = met.join(lower.hint("merge"), ["lang", "suffix"])
        p = written(met.select("lang", "gram", ((F.col("n") - off) / F.col("total") + F.col("back") * F.col("below")).alias("p")))
        backs = stats.select("lang", F.lit(k - 1).alias("level"), F.col("ctx").alias("gram"), F.lit(None).cast("double").alias("logp"), F.log("back").alias("back"))
        probs = p.select("lang", F.lit(k).alias("level"), "gram", F.log("p").alias("logp"), F.lit(None).cast("double").alias("back"))
        part = probs.union(backs)
        model = part if model is None else model.union(part)
        lower = p.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
    unseen = alphabet.select("lang", F.lit(0).alias("level"), F.lit(0).cast("long").alias("gram"), F.log(1 / F.col("v")).alias("logp"), F.lit(None).cast("double").alias("back"))
    return written(model.union(unseen).groupBy("lang", "level", "gram").agg(F.max("logp").alias("logp"), F.max("back").alias("back")))


class LocalModel:
    """The model's rows as sorted arrays, for one language and level each."""

    def __init__(self, table: pa.Table):
        self.of: dict[tuple[str, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        langs = np.array(table.column("lang").to_pylist(), dtype=object)
        level, gram, logp, back = (table.column(c).to_numpy() for c in ("level", "gram", "logp", "back"))
        for lang in set(langs.tolist()):
            for k in range(ORDER + 1):
                i = np.flatnonzero((langs == lang) & (level == k))
                i = i[np.argsort(gram[i], kind="stable")]
                self.of[lang, k] = gram[i], logp[i], back[i]

    def look(self, lang: str, k: int, g: np.ndarray, which: int) -> np.ndarray:
        keys, *values = self.of[lang, k]
        if not len(keys):
            return np.full(len(g), np.nan)
        at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        return np.where(keys[at] == g, values[which][at], np.nan)

    def logp(self, lang: str, g: np.ndarray) -> np.ndarray:
        """Of distinct n-grams: the longest seen ending, after the weights of backing off to it."""
        out, weight, left = np.zeros(len(g)), np.zeros(len(g)), np.arange(len(g))
        for k in range(ORDER, -1, -1):
            here = g[left] & np.int64((1 << (16 * k)) - 1 if k < 4 else -1)
            p = self.look(lang, k, here, 0)
            hit = ~np.isnan(p)
            out[left[hit]] = weight[left[hit]] + p[hit]
            left, here = left[~hit], here[~hit]
            if k:
                weight[left] += np.nan_to_num(self.look(lang, k - 1, (here.view(np.uint64) >> np.uint64(16)).view(np.int64), 1))
        return out


def parts(b: pa.RecordBatch, col: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have at most ``most`` bytes together, or of one row."""
    ends = np.cumsum(pc.binary_length(b.column(col)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < b.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield b.slice(at, to - at)
        at = to


def score_locally(rows: DataFrame, model: DataFrame) -> DataFrame:
    """(id, lang, blank, loss) with the model, whose size the caller has checked, in each task."""
    shared = rows.sparkSession.sparkContext.broadcast(LocalModel(model.toArrow()))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = shared.value
        give_back_memory()
        for b in batches:
            for part in parts(b, 2, SCORED_CHARS):
                langs, gs = part.column(1).to_pylist(), [grams(t) for t in part.column(2).to_pylist()]
                loss: list[float | None] = [None] * len(gs)
                for lang in {x for x in langs if (x, ORDER) in local.of}:
                    mine = [i for i, x in enumerate(langs) if x == lang and len(gs[i])]
                    if mine:
                        g, where = np.unique(np.concatenate([gs[i] for i in mine]), return_inverse=True)
                        each = local.logp(lang, g)[where]
                        starts = np.cumsum([0, *(len(gs[i]) for i in mine[:-1])])
                        for i, total in zip(mine, np.add.reduceat(each, starts).tolist(), strict=True):
                            loss[i] = -total / len(gs[i])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in (0, 1, 3)), pa.array(loss, pa.float64())], names=schema.names)
            give_back_memory()

    schema = rows.select("id", "lang", "blank").schema.add("loss", "double")
    return rows.select("id", "lang", "text", "blank").mapInArrow(apply, schema)


def score_sharded(rows: DataFrame, model: DataFrame) -> DataFrame:
    """(id, lang, blank, loss) by joins of each row's n-gram counts with the model, sharded on (lang, gram).

    Rows that repeat an id, a text and a language are counted once, and each of them comes out.
    """
    keyed = rows.withColumn("key", F.xxhash64("id", "text")).select("key", "lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, lang, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                g, n = np.unique(grams(text), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(g), pa.int64()), pa.array([lang] * len(g), pa.string()), pa.array(g, pa.int64()), pa.array(n, pa.int64())], names=["key", "lang", "gram", "n"])

    counts = written(keyed.dropDuplicates(["key", "lang"]).mapInArrow(counted, "key long, lang string, gram long, n long"))
    asked = counts.select("lang", "gram").distinct()
    for k in range(ORDER, -1, -1):
        here = F.col("gram").bitwiseAND(F.lit((1 << (16 * k)) - 1)) if k < 4 else F.col("gram")
        level = model.where(F.col("level") == k).select(F.col("lang").alias("_l"), F.col("gram").alias("_g"), F.col("logp").alias(f"p{k}"), F.col("back").alias(f"b{k}")).hint("merge")
        asked = asked.withColumn("_here", here).join(level.drop(f"b{k}"), (F.col("lang") == F.col("_l")) & (F.col("_here") == F.col("_g")), "left").drop("_l", "_g")
        if k:
            asked = asked.withColumn("_ctx", F.shiftrightunsigned("_here", 16))
            backs = model.where(F.col("level") == k - 1).select(F.col("lang").alias("_l"), F.col("gram").alias("_g"), F.col("back").alias(f"b{k}")).hint("merge")
            asked = asked.join(backs, (F.col("lang") == F.col("_l")) & (F.col("_ctx") == F.col("_g")), "left").drop("_l", "_g", "_ctx")
        asked = asked.drop("_here")
    logp = F.col("p0")
    for k in range(1, ORDER + 1):
        logp = F.coalesce(F.col(f"p{k}"), F.coalesce(f"b{k}", F.lit(0.0)) + logp)
    known = written(asked.select("lang", "gram", logp.alias("logp")).where("logp IS NOT NULL"))
    sums = counts.join(known.hint("merge"), ["lang", "gram"]).groupBy("key", "lang").agg((-F.sum(F.col("n") * F.col("logp")) / F.sum("n")).alias("loss"))
    ids = rows.select(F.xxhash64("id", "text").alias("key"), "id", "lang", "blank")
    return ids.join(sums.hint("merge"), ["key", "lang"], "left").select("id", "lang", "blank", "loss")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """The model of every language from the whole texts of all trusted rows, those that a label marks 1."""
    trusted = trusted_texts(docs, labels, id_col, label_col).select(text_or_empty(text_col).alias("t"), _lang(lang_col).alias("lang"))
    counts = trusted.mapInArrow(gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return kneser_ney(counts)


def _lang(lang_col: str) -> Column:
    return F.coalesce(F.col(lang_col), F.lit(""))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", local_rows: int = LOCAL_ROWS, quantile: float = TRUST_QUANTILE, slack: float = SLACK) -> DataFrame:
    """(id, lang, perplexity, threshold, kept) for every row of ``docs``.

    Perplexity is per character under the model of the row's language, a null language being one
    of its own. A language's threshold is ``slack`` times the ``quantile`` of its trusted rows'
    perplexities. Rows above it go, and so do rows without a word, whose perplexity is null. Where
    no row of the language is trusted, perplexity and threshold are null and rows with words stay.
    A model of up to ``local_rows`` rows is held by each task; a larger one is joined by shards. An empty table gives no rows.
    """
    t = text_or_empty(text_col)
    model = train(docs, labels, id_col, text_col, lang_col, label_col)
    rows = docs.select(F.col(id_col).alias("id"), _lang(lang_col).alias("lang"), t.alias("text"), (~t.rlike(r"(?U)\S")).alias("blank"))
    scored = score_locally(rows, model) if model.count() <= local_rows else score_sharded(rows, model)
    scored = written(scored.withColumn("perplexity", F.exp("loss")))
    trusted = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("_id")).distinct()
    limits = scored.join(trusted, scored["id"] == trusted["_id"], "left_semi").groupBy("lang").agg((F.lit(slack) * F.percentile_approx("perplexity", quantile, 10_000)).alias("threshold"))
    met = scored.join(F.broadcast(written(limits)), "lang", "left")  # one row for each language
    fine = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.col("threshold").isNull() & ~F.col("blank"))
    return met.select(F.col("id").alias(id_col), F.col("lang"), "perplexity", "threshold", fine.alias("kept"))
