"""Word shingles of whole texts as sorted arrays of 64-bit hashes, made batch by batch inside tasks."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bylines.schemas import SHINGLE_WORDS

TEXTS = 200  # that a task cuts at once
STRETCH = 1 << 20  # bytes whose places are hashed at once
HEAD = 12  # binary logarithm of the most bytes that a passage is looked up by
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_WORD = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))


def _mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_VALUE = _mixed(np.arange(1, 257, dtype=np.uint64) * _ODD[0])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words [a-z0-9]+ of all texts, how many each text has): a word's bytes, each weighed by its place, are summed for all words at once."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = _WORD[buf]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, sizes = edges[0::2], np.diff(edges)[0::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.cumsum(sizes) - sizes
    held = buf[inside]
    place = np.arange(len(held)) - np.repeat(first, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), _ODD[1]))
    h = _mixed(np.add.reduceat(_VALUE[held] * powers[place], first) + sizes.astype(np.uint64) * _ODD[2])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h, np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(texts))


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    if len(h) < n:
        return np.zeros(0, np.int64)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mixed((out + h[k : len(h) - n + 1 + k]) * _ODD[k % 3])
    return out.view(np.int64)


def shingles_of(texts: list[str], n: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The distinct shingles of each lower-cased text, ascending; fewer than n words are one shingle, no words none."""
    h, sizes = word_hashes([t.encode("utf-8", "surrogatepass") for t in texts])
    runs, out, at = _runs(h, n), [], 0
    for size in sizes.tolist():
        s = np.sort(runs[at : at + size - n + 1] if size >= n else _runs(h[at : at + size], size) if size else runs[:0])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
        at += size
    return out


def lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def lowered(text_col: str) -> Column:
    return F.lower(F.coalesce(F.col(text_col), F.lit("")))


def shingle_sets(rows: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """``keep`` and (class string, n, s): a digest of each row's shingle set, its size, and the set ascending; without words the class is null."""
    cut = rows.select(*keep, lowered(text_col).alias("_t"))
    schema = cut.select(*keep).schema.add("class", "string").add("n", "integer").add("s", T.ArrayType(T.LongType()))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                sets = shingles_of(part.column(len(keep)).to_pylist())
                names = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(names, pa.string()), pa.array([len(s) for s in sets], pa.int32()), lists(sets)], names=schema.names)

    return cut.mapInArrow(apply, schema)


def shingles_within(rows: DataFrame, keep: list[str], text_col: str, asked: np.ndarray | None) -> DataFrame:
    """``keep`` and h, a row for each shingle of a text that stands in ``asked``, ascending; for every shingle if it is None."""
    cut = rows.select(*keep, lowered(text_col).alias("_t"))
    schema = cut.select(*keep).schema.add("h", "long")
    shared = rows.sparkSession.sparkContext.broadcast(asked)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                sets = shingles_of(part.column(len(keep)).to_pylist())
                if wanted is not None:
                    every = np.concatenate(sets)
                    met = np.zeros(len(every), bool)
                    if len(wanted):
                        met = wanted[np.minimum(np.searchsorted(wanted, every), len(wanted) - 1)] == every
                    sizes = np.cumsum([len(s) for s in sets])
                    which, held = np.searchsorted(sizes, np.flatnonzero(met), side="right"), every[met]
                else:
                    which, held = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
                yield pa.RecordBatch.from_arrays([c.take(pa.array(which)) for c in part.columns[: len(keep)]] + [pa.array(held)], names=schema.names)

    return cut.mapInArrow(apply, schema)


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    n = STRETCH + (1 << HEAD)
    return np.cumprod(np.full(n, _ODD[1])), np.cumprod(np.full(n, np.uint64(pow(int(_ODD[1]), -1, 1 << 64))))


def place_hashes(buf: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(at, h) for each stretch of bytes: the hashes of the ``size`` bytes that begin at each place from ``at`` on."""
    up, back = _powers()
    for at in range(0, len(buf) - size + 1, STRETCH):
        part = buf[at : at + STRETCH + size - 1]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[part] * up[: len(part)])])
        yield at, _mixed((sums[size:] - sums[:-size]) * back[: len(part) - size + 1] + np.full(1, size, np.uint64) * _ODD[2])


def headed(parts: DataFrame) -> DataFrame:
    """(item, part, size, h) of ``parts(item, part)``, part binary: how many first bytes, a power of two, a part is looked up by, and their hash; an empty part has size 0."""
    schema = T.StructType([*parts.schema.fields, T.StructField("size", T.IntegerType()), T.StructField("h", T.LongType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, hashes = [], []
            for x in b.column(1).to_pylist():
                sizes.append(1 << min(HEAD, len(x).bit_length() - 1) if x else 0)
                hashes.append(int(next(place_hashes(np.frombuffer(x[: sizes[-1]], np.uint8), sizes[-1]))[1].view(np.int64)[0]) if x else 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, pa.int32()), pa.array(hashes, pa.int64())], names=schema.names)

    return parts.mapInArrow(apply, schema)


def holding(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """(item, id) of ``texts(id, text)``, text binary and not null, that hold a part of ``headed`` parts, which every task knows.

    The heads of all parts are looked up at every place of a text, all places at once; parts whose head stands in it are searched.
    """
    known = parts.orderBy(F.col("size") == 0, "h").toArrow()
    table = tuple(known.column(c).combine_chunks() for c in ("item", "part", "size", "h"))
    shared = texts.sparkSession.sparkContext.broadcast(table)
    schema = T.StructType([parts.schema["item"], texts.schema["id"]])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, passages, sizes, hashes = shared.value
        passages, sizes, hashes = passages.to_pylist(), sizes.to_numpy(), hashes.to_numpy()
        empty = np.flatnonzero(sizes == 0)
        hashes = hashes[: len(hashes) - len(empty)]
        ends = np.searchsorted(hashes, hashes, side="right")
        shift = np.uint64(64 - min(24, max(16, len(hashes).bit_length() + 4)))
        spots = np.zeros(1 << (64 - int(shift)), bool)
        spots[hashes.view(np.uint64) >> shift] = True
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                held = part.column(1).to_pylist()
                buf = np.frombuffer(b"\xff".join(held), np.uint8)  # no text has that byte
                starts, pairs = np.cumsum([len(t) + 1 for t in held]), [np.zeros(0, np.int64)]
                for size in set(sizes[: len(hashes)].tolist()):
                    for start, h in place_hashes(buf, size):
                        near = np.flatnonzero(spots[h >> shift])
                        h = h[near].view(np.int64)
                        k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                        met = hashes[k] == h
                        pairs.append(np.unique(np.searchsorted(starts, near[met] + start, side="right") * len(hashes) + k[met]))
                met = [divmod(x, len(hashes)) for x in np.unique(np.concatenate(pairs)).tolist()]
                found = [(row, i) for row, k in met for i in range(k, ends[k]) if passages[i] in held[row]] + [(row, i) for row in range(len(held)) for i in empty]
                rows, which = (pa.array([x[i] for x in found], pa.int64()) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([items.take(which), part.column(0).take(rows)], names=schema.names)

    return texts.mapInArrow(apply, schema)
