"""Cross-tokenizer alignment by divide and conquer at shared cuts, and corpus-wide counts of linked ids."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bylines.llm.texts import give_back_memory, text_or_empty
from bylines.scratch import written

PRE_TOKENS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # of byte-level vocabularies
BLOCK_BYTES = 2_000_000  # bytes of a block of documents; it ends with the text that reaches this
BLOCK_DOCS = 2_000
LONG_TEXT = 1 << 20  # characters that are encoded at once
STRETCH = 1 << 19  # tokens whose digits are laid out at once
FIRST_WINDOW, WIDEN = 1, 4

# A space after a letter, digit or ASCII mark begins a pre-token of one tokenizer and a piece of the
# other, whatever stands before, so what lies between such spaces encodes alone.
_CUT = re.compile(r"(?<=[\w!-/:-@\[-`{-~]) ")


def stretches(text: str) -> Iterator[str]:
    """The text, or if it is long its parts between such spaces; each part stands for itself after one space."""
    at = 0
    while len(text) - at > LONG_TEXT and (cut := _CUT.search(text, at + LONG_TEXT)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters for themselves, the others, in order, from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TwoEncoders:
    """Ids of texts, after a space, by both tokenizers, and the bytes of every id.

    A is a byte-level vocabulary whose ids follow its merges, as those of the public files do; then
    ranks say all, and are what encodes. Any other raises an error.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            model = json.load(f)
        to_byte, vocab = byte_level(), model["model"]["vocab"]
        added = {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in s): i for s, i in vocab.items() if s not in added}
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["model"]["merges"]]
        if model["normalizer"] or model["pre_tokenizer"]["type"] != "ByteLevel" or [vocab[m] for m in merges] != sorted(vocab[m] for m in merges):
            raise ValueError("A must be a byte-level vocabulary in the order of its merges")
        self.a = tiktoken.Encoding("a", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.space = self.b.piece_to_id("▁")
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        whole = lambda i, s: bytes([int(s[3:5], 16)]) if self.b.is_byte(i) else s.replace("▁", " ").encode()
        self.bytes_b = [whole(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.len_a, self.len_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.pieces = [pa.array(side, pa.binary()) for side in (self.bytes_a, self.bytes_b)]
        digits = [[f"{i}{end}" for i in range(n)] for n, ends in ((len(self.bytes_a), ",|"), (len(self.bytes_b), (",", ";", ""))) for end in ends]
        self.digits = pa.array([x for part in digits for x in part])

    def _joined_as(self, k: int, ids: np.ndarray, upto: np.ndarray, want: list[bytes]) -> np.ndarray:
        """Which texts' bytes the tokens of a side join to."""
        ends = np.concatenate([[0], np.cumsum((self.len_a, self.len_b)[k][ids])])
        data = self.pieces[k].take(pa.array(ids.astype(np.int32))).buffers()[2]
        joined, at = data.to_pybytes() if data else b"", ends[upto].tolist()
        return np.fromiter((joined[a:b] == w for a, b, w in zip([0, *at], at, want)), bool, len(want))

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """([ids of A, ids of B] of all texts one after another, [how many each text has]); texts that are empty or whose bytes differ have none."""
        parts = [list(stretches(t)) if t else [] for t in texts]
        flat = [p for own in parts for p in own]
        a = [self.a.encode_to_numpy(" " + p) for p in flat]
        b = [ids if p else [self.space] for p, ids in zip(flat, self.b.encode(flat, num_threads=1), strict=True)]  # no space is added to an empty text
        doc = np.repeat(np.arange(len(texts)), [len(own) for own in parts])
        ids = [np.concatenate(a).astype(np.int64) if a else np.zeros(0, np.int64), np.fromiter(chain.from_iterable(b), np.int64)]
        n = [np.bincount(doc, weights=[len(x) for x in side], minlength=len(texts)).astype(np.int64) if side else np.zeros(len(texts), np.int64) for side in (a, b)]
        want = [(" " + t).encode() if t else b"" for t in texts]
        right = np.logical_and(*[self._joined_as(k, ids[k], np.cumsum(n[k]), want) for k in (0, 1)])
        if not right.all():
            ids = [x[np.repeat(right, m)] for x, m in zip(ids, n, strict=True)]
            n = [np.where(right, m, 0) for m in n]
        return ids, n


@cache
def encoders(path_a: str, path_b: str) -> TwoEncoders:
    return TwoEncoders(path_a, path_b)


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Places in ``ends_a``, ascending, of the ends within [lo, hi) of each interval that ``ends_b`` has too.

    Divide and conquer: an interval looks around its middle for an end that a bisection finds on the
    other side, in windows that widen, splits at the nearest one and goes on in both halves. An
    interval without any is a leaf. All open intervals take a step at once, so steps grow with
    the logarithm of the longest interval.
    """
    found, width = [], np.full(len(lo), FIRST_WINDOW, np.int64)
    while True:
        some = lo < hi
        lo, hi, width = lo[some], hi[some], width[some]
        if not len(lo):
            return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        mid = (lo + hi) // 2
        left, right = np.maximum(lo, mid - width + 1), np.minimum(hi, mid + width)
        sizes = right - left
        starts = np.cumsum(sizes) - sizes
        at = np.repeat(left - starts, sizes) + np.arange(int(sizes.sum()))
        there = np.minimum(np.searchsorted(ends_b, ends_a[at]), len(ends_b) - 1)
        off = at - np.repeat(mid, sizes)
        rank = np.where(ends_b[there] == ends_a[at], 2 * np.abs(off) + (off < 0), np.iinfo(np.int64).max)
        best = np.minimum.reduceat(rank, starts)
        hit = best < np.iinfo(np.int64).max
        cut = mid[hit] + np.where(best[hit] % 2, -1, 1) * (best[hit] // 2)
        found.append(cut)
        wider = ~hit & (sizes < hi - lo)
        again = np.full(2 * len(cut), FIRST_WINDOW, np.int64)
        lo, hi, width = (np.concatenate(x) for x in ((lo[hit], cut + 1, lo[wider]), (cut, hi[hit], hi[wider]), (again, width[wider] * WIDEN)))


class Aligned:
    """Texts aligned at shared cuts: per side ids and, per group, where it ends; per text how many of each."""

    def __init__(self, enc: TwoEncoders, texts: list[str]):
        self.enc = enc
        self.ids, self.n = enc.encode(texts)
        self.bytes = [np.cumsum(size[ids]) for size, ids in zip((enc.len_a, enc.len_b), self.ids, strict=True)]
        upto = np.cumsum(self.n[0])
        last = upto[self.n[0] > 0] - 1  # the ends of texts are shared
        cuts = np.sort(np.concatenate([last, shared_cuts(*self.bytes, upto - self.n[0], upto - 1)])) if len(last) else np.zeros(0, np.int64)
        self.ends = [cuts + 1, np.searchsorted(self.bytes[1], self.bytes[0][cuts]) + 1]
        self.upto = [upto, np.cumsum(self.n[1])]
        self.groups_upto = np.searchsorted(cuts, upto - 1, side="right") if len(cuts) else np.zeros(len(texts), np.int64)
        self.n_groups = np.diff(self.groups_upto, prepend=0)

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups in decimal, empty for a text without tokens, laid out a stretch of tokens at a time."""
        va, vb = len(self.enc.bytes_a), len(self.enc.bytes_b)
        total = len(self.ids[0]) + len(self.ids[1])
        which, text_end = np.zeros(total, np.int32), self.upto[0] + self.upto[1]
        for k, (ids, ends) in enumerate(zip(self.ids, self.ends, strict=True)):
            kind = np.zeros(len(ids), np.int64)
            kind[ends - 1] = 1
            if k:
                kind[self.upto[1][self.n[1] > 0] - 1] = 2
            sizes = np.diff(ends, prepend=0)
            before = self.ends[0] if k else np.concatenate([[0], self.ends[1][:-1]]) if len(ends) else ends
            which[np.arange(len(ids)) + np.repeat(before, sizes)] = (ids + kind * (vb if k else va) + (2 * va if k else 0)).astype(np.int32)
        hashes, doc, texts = [hashlib.sha256() for _ in text_end], 0, len(text_end)
        for at in range(0, total, STRETCH):
            part = self.enc.digits.take(pa.array(which[at : at + STRETCH]))
            bounds, data = np.frombuffer(part.buffers()[1], np.int32), memoryview(part.buffers()[2])
            done, here = at, min(at + STRETCH, total)
            while done < here:
                while doc < texts and text_end[doc] <= done:
                    doc += 1
                end = min(int(text_end[doc]), here)
                hashes[doc].update(data[bounds[done - at] : bounds[end - at]])
                done = end
        return [h.hexdigest() if n else "" for h, n in zip(hashes, self.n[0].tolist(), strict=True)]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, pair) of each link, where pair is A's id in the upper and B's in the lower 32 bits.

        Each stretch of bytes between neighbouring ends of either side lies in one token of each.
        """
        size = int(self.bytes[0][-1]) + 1 if len(self.bytes[0]) else 0
        marks = np.zeros((2, size), bool)
        for k in (0, 1):
            marks[k][self.bytes[k]] = True
        ends = np.flatnonzero(marks[0] | marks[1])
        a, b = (np.cumsum(m)[ends] - m[ends] for m in marks)  # how many ends lie before
        return np.repeat(np.arange(len(self.n[0])), self.n[0])[a], self.ids[0][a] << 32 | self.ids[1][b]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start = held = 0
        for i, size in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
            held += size
            if held >= BLOCK_BYTES or i + 1 - start >= BLOCK_DOCS:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def align(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a_ids, b_ids, a_ends, b_ends) for every row: both tokenizers' ids, and after how many of each every group ends.

    Texts that are null or empty, or whose tokens' joined bytes on either side are not those of a
    space and the text, have empty lists. Repeated rows come out each; an empty table gives no
    rows; other columns are not read.
    """
    rows = df.select(F.col(id_col), text_or_empty(text_col).alias("_t"))
    names, ints = ("a_ids", "b_ids", "a_ends", "b_ends"), T.ArrayType(T.IntegerType())
    schema = rows.select(id_col).schema
    for name in names:
        schema = schema.add(name, ints)

    def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values.astype(np.int32)))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoders(path_a, path_b)
        for part in _blocks(batches):
            x = Aligned(enc, part.column(1).to_pylist())
            own = [ends - np.repeat(upto - n, x.n_groups) for ends, upto, n in zip(x.ends, x.upto, x.n, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *(lists(i, u) for i, u in zip(x.ids, x.upto, strict=True)), *(lists(o, x.groups_upto) for o in own)], names=schema.names)

    return rows.mapInArrow(apply, schema)


def link_counts(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row, weighed by the corpus.

    A link is a pair of token occurrences whose bytes overlap; a pair of ids counts the rows that
    hold it linked. n_best counts the links whose pair is the most frequent of its A id, ties
    included; count_sum adds up their counts. groups_sha256 digests the groups of ids.

    A task aligns its documents by blocks and sends each distinct pair of a block once, with its
    count of documents, so a pair that every document holds costs one row for each block. Counts are
    summed by pair, go back to the blocks that hold them, and meet there what each document holds.
    The best count of each A id is as long as A's vocabulary and is broadcast.
    Nulls, repeats and empty tables: as ``align``. Ids of any type are carried along.
    """
    rows = df.select(F.col(id_col), text_or_empty(text_col).alias("_t"))
    id_type = rows.schema[0].dataType
    totals = ("n_a", "n_b", "n_groups", "n_links")
    spec = T.StructType().add("block", "long").add("id", id_type)
    for c in totals:
        spec = spec.add(c, "long")
    spec = spec.add("groups_sha256", "string").add("slots", T.ArrayType(T.IntegerType())).add("times", T.ArrayType(T.IntegerType())).add("pairs", T.ArrayType(T.LongType())).add("held", T.ArrayType(T.IntegerType()))
    arrow = to_arrow_schema(spec)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoders(path_a, path_b), TaskContext.get()
        block = (task.partitionId() if task else 0) << 32
        for part in _blocks(batches):
            give_back_memory()
            n = part.num_rows
            x = Aligned(enc, part.column(1).to_pylist())
            doc, pair = x.links()
            pairs, slot = np.unique(pair, return_inverse=True)
            held, times = np.unique(doc * max(1, len(pairs)) + slot, return_counts=True)
            doc_of, slot_of = np.divmod(held, max(1, len(pairs)))
            bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc_of, minlength=n))]).astype(np.int32))
            per = {"block": np.full(n, block), "id": part.column(0), "n_a": x.n[0], "n_b": x.n[1], "n_groups": x.n_groups, "n_links": np.bincount(doc, minlength=n), "groups_sha256": x.digests()}
            per |= {"slots": pa.ListArray.from_arrays(bounds, pa.array(slot_of.astype(np.int32))), "times": pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int32)))}
            yield pa.RecordBatch.from_arrays([per[f.name] if isinstance(per.get(f.name), pa.Array) else pa.array(per[f.name], f.type) if f.name in per else pa.nulls(n, f.type) for f in arrow], schema=arrow)
            one = {"block": [block], "pairs": [pairs], "held": [np.bincount(slot_of, minlength=len(pairs)).astype(np.int32)]}
            yield pa.RecordBatch.from_arrays([pa.array(one.get(f.name, [None]), f.type) for f in arrow], schema=arrow)
            block += 1

    found = written(rows.mapInArrow(apply, spec))
    sent = found.where("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("slot", "x")).select("block", "slot", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    counts = written(sent.groupBy("pair").agg(F.sum("held").alias("n")))
    a = F.shiftright("pair", 32)
    best = counts.groupBy(a.alias("a")).agg(F.max("n").alias("top"))  # one row for each id of A at most
    weighed = counts.withColumn("a", a).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("is_best"))
    back = sent.select("block", "slot", "pair").join(weighed.hint("merge"), "pair").select(F.col("block").alias("of_block"), "slot", "n", "is_best")
    out = T.StructType().add(id_col, id_type)
    for c in (*totals, "n_best", "count_sum"):
        out = out.add(c, "long")
    out = out.add("groups_sha256", "string")

    def weigh(docs: pa.Table, block: pa.Table) -> pa.Table:
        slots, n, is_best = (block.column(c).to_numpy() for c in ("slot", "n", "is_best"))
        count, top = np.zeros(len(slots), np.int64), np.zeros(len(slots), np.int64)
        count[slots], top[slots] = n, is_best
        lists, times = docs.column("slots").combine_chunks(), docs.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
        at = lists.flatten().to_numpy()
        doc = np.repeat(np.arange(docs.num_rows), lists.value_lengths().to_numpy())
        add = lambda values: np.bincount(doc, weights=values * times, minlength=docs.num_rows).astype(np.int64)  # noqa: E731  exact below 2^53
        return pa.table([docs.column("id"), *(docs.column(c) for c in totals), pa.array(add(top[at])), pa.array(add(count[at])), docs.column("groups_sha256")], names=out.names)

    per_doc = found.where("pairs IS NULL").select("block", "id", *totals, "groups_sha256", "slots", "times")
    return per_doc.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(weigh, out)
