"""Packing by power-of-two decomposition of tokenised documents."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bylines.llm.texts import give_back_memory, text_or_empty
from bylines.operators.numbering import number_within
from bylines.scratch import written

MAX_TOKENS = 2048
END_ID = 1
CACHED_WORDS = 900_000  # words and stems that a worker keeps between texts, some 180 MB; it starts over beyond that
TEXTS, TEXT_BYTES = 1_000, 8 << 20  # that are cut into words at once, as Arrow columns of some four times their bytes and a list of the words that differ
TAIL = ".,!?;:#%*&$)]}\"'"  # marks that are cut off the end of a word before it is learnt
PIECE = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])
CHUNK_BYTES = 16 << 20
LEARNT = 5_000  # words that go to the tokenizer at once
WORD_END = "</w>"  # at the end of a token that ends a word
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"  # that are the same in normal form and lower case, whatever letters of these stand beside
_ONLY_LETTERS = re.compile(f"[{LETTERS}]+").fullmatch


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space, so that words between blanks encode alone, each once.

    As by the library's defaults, a special token spelled out in a text becomes that token.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.cached = Tokenizer.from_file(path), cached
        self.bare = Tokenizer(self.tokenizer.model)  # for words that are in normal form already and one run each
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.as_is = self.tokenizer.normalizer.normalize_str(LETTERS) == LETTERS and len(self.tokenizer.pre_tokenizer.pre_tokenize_str(LETTERS)) == 1
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith(WORD_END) for i in range(self.tokenizer.get_vocab_size())])  # ids that end a run of letters
        self.stays: dict[str, bool] = {}  # last characters, and whether they still are letters or digits in normal form
        self.known = {"": b""}

    def learn(self, words: list[str]) -> None:
        e = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(e.ids, dtype="<u4").tobytes()
        ends = 4 * np.searchsorted(np.array(e.word_ids, dtype=np.int64), np.arange(1, len(words) + 1))
        self.keep(words, ids, ends)

    def learn_letters(self, words: list[str]) -> None:
        """Words of nothing but LETTERS, each of which the tokenizer takes as it is in one run, whose last id is marked as the end."""
        ids = np.array(self.bare.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if not self.as_is or len(ends) != len(words):
            return self.learn(words)
        self.keep(words, ids.tobytes(), ends)

    def keep(self, words: list[str], ids: bytes, ends: np.ndarray) -> None:
        at = 0
        for w, end in zip(words, ends.tolist(), strict=True):
            self.known[w] = ids[at:end]
            at = end

    def parts(self, w: str) -> tuple[str, str]:
        """The word's stem and its last marks, which encode alone after a letter or digit; a plain stem is in lower case, as the tokenizer takes it.

        What counts is the character that the tokenizer sees: its normal form may end in a mark where the stem ends in a letter.
        """
        stem = w.rstrip(TAIL)
        if "<|" in w or not stem or not stem[-1].isalnum():
            return w, ""
        if stem.isascii() or _ONLY_LETTERS(stem.lower()):
            return stem.lower(), w[len(stem) :]
        last = stem[-1]
        if last not in self.stays:
            self.stays[last] = self.tokenizer.normalizer.normalize_str(last)[-1:].isalnum()
        return (stem, w[len(stem) :]) if self.stays[last] else (w, "")

    def learn_all(self, words: list[str]) -> None:
        """Of the words, those that are not known yet."""
        if len(self.known) > self.cached:
            self.known = {"": b""}
        known = self.known
        new = [(w, *self.parts(w)) for w in filterfalse(known.__contains__, words)]
        unknown = {stem for _, stem, _ in new}.union(tail for _, _, tail in new).difference(known)
        letters = list(filter(_ONLY_LETTERS, unknown))
        for found, learn in ((letters, self.learn_letters), (list(unknown.difference(letters)), self.learn)):
            for at in range(0, len(found), LEARNT):
                learn(found[at : at + LEARNT])
        for w, stem, tail in new:
            known[w] = known[stem] + known[tail] if tail else known[stem]

    def encode_column(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, pa.Buffer]:
        """All ids as little-endian unsigned 32-bit numbers, each text's followed by ``end``, and the bytes at which texts begin, and the last ends."""
        for blank in "\t\n\r":
            texts = pc.replace_substring(texts, blank, " ")
        split = pc.split_pattern(texts, " ")
        at = np.asarray(split.offsets).astype(np.int64)
        words = pc.dictionary_encode(split.flatten())
        own = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn_all(own)
        ids = pa.array([*map(self.known.__getitem__, own), end], pa.large_binary())
        places = np.insert(np.asarray(words.indices), at[1:] - at[0], len(own))
        laid = ids.take(pa.array(places))
        _, offsets, data = laid.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(laid) + 1)
        return offsets[at - at[0] + np.arange(len(at))], data

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        at, data = self.encode_column(pa.array(texts, pa.string()))
        return [bytes(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@cache
def encoder(path: str, cached: int) -> WordEncoder:
    return WordEncoder(path, cached)


def shares(texts: pa.Array, rows: int, most: int) -> Iterator[tuple[int, int]]:
    """(start, length) of stretches of at most ``rows`` texts and ``most`` bytes, or of one text."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64)
    at = 0
    while at < len(texts):
        full = int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right"))
        end = min(at + rows, max(at + 1, full))
        yield at, end - at
        at = end


def binary_pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of whole pieces of ``longest``, a power of two, then one for each binary digit of the rest."""
    cuts = [(at, longest) for at in range(0, n - n % longest, longest)]
    at = n - n % longest
    while at < n:
        size = 1 << ((n - at).bit_length() - 1)
        cuts.append((at, size))
        at += size
    return cuts


def tokenised_pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", longest: int = MAX_TOKENS, cached: int = CACHED_WORDS, keep: bool = True, at_once: int = TEXTS) -> DataFrame:
    """(id, start, length, ids, doc_tokens) for each piece of each row; ``ids`` are little-endian unsigned 32-bit numbers.

    A document is its ids and END_ID, so a null or empty text is one piece of one id. Texts are
    encoded whole, ``at_once`` of them together. Without ``keep`` a worker lets its encoder go after each task.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    rows = df.select(F.col(id_col), text_or_empty(text_col).alias("_t"))
    schema = rows.select(id_col).schema.add("start", "long").add("length", "long").add("ids", "binary").add("doc_tokens", "long")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, cached)
        give_back_memory()
        for batch in batches:
            for share in shares(batch.column(1), at_once, TEXT_BYTES):
                part = batch.slice(*share)
                ends, ids = enc.encode_column(part.column(1), END_ID.to_bytes(4, "little"))
                tokens = np.diff(ends) // 4
                cuts = [(row, n, *cut) for row, n in enumerate(tokens.tolist()) for cut in binary_pieces(n, longest)]
                where, of, start, length = np.array(cuts, dtype=np.int64).reshape(-1, 4).T.copy()
                at_bytes = np.append(0, 4 * np.cumsum(length))  # pieces lie one after another, as the ids do
                cut = pa.Array.from_buffers(pa.large_binary(), len(where), [None, pa.py_buffer(at_bytes), ids]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(where)), pa.array(start), pa.array(length), cut, pa.array(of)], names=schema.names)
            give_back_memory()
        if not keep:
            del enc
            encoder.cache_clear()
            give_back_memory()

    return rows.mapInArrow(encode, schema)


def bucket_pieces(pieces: DataFrame, id_col: str = "doc_id", chunk_rows: int = 50_000) -> DataFrame:
    """Add sequence_id and offset: every piece is a sequence of its own, and pieces of one length have adjacent numbers.

    Lengths are powers of two, so a batch of one length needs no padding and no sequence crosses
    documents. Longer buckets come first. Numbers are dealt in hashed chunks of documents.
    """
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each power of two
    first, at = F.lit(0).cast("long"), 0
    for size in sorted(sizes, reverse=True):
        first = F.when(F.col("length") == size, F.lit(at)).otherwise(first)
        at += sizes[size]
    key = F.xxhash64(id_col, "start")
    placed = number_within(pieces, "length", key, [F.col(id_col), F.col("start")], "_place", max(sizes.values(), default=0), chunk_rows)
    return placed.withColumn("sequence_id", (first + F.col("_place")).cast("long")).withColumn("offset", F.lit(0).cast("long")).drop("_place")


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", longest: int = MAX_TOKENS, cached: int = CACHED_WORDS, keep: bool = True, at_once: int = TEXTS) -> DataFrame:
    """Packed pieces with their ids: (id, start, length, ids, doc_tokens, sequence_id, offset).

    Rows that repeat an id are packed each; other columns are not read; an empty table gives no
    rows. The pieces are written to the shared folder once, as three passes number them, in
    chunks of CHUNK_BYTES of ids at most. ``cached`` words stay with a worker, some 200 bytes each, without ``keep`` until a task ends.
    """
    pieces = written(tokenised_pieces(df, tokenizer, id_col, text_col, longest, cached, keep, at_once))
    return bucket_pieces(pieces, id_col, max(1, CHUNK_BYTES // (4 * longest)))


def pack_digests(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", longest: int = MAX_TOKENS) -> DataFrame:
    """As ``pack``, with ids_crc32 (unsigned) in place of the ids."""
    pieces = tokenised_pieces(df, tokenizer, id_col, text_col, longest).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return bucket_pieces(written(pieces), id_col)
