"""Byte-level BPE by a global shuffle of distinct words, and decoding by a join with the token-byte table."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bylines.llm.texts import text_or_empty

BLOCK_TOKENS = 3_000_000  # pre-tokens of a block; it ends with the text that reaches this
BLOCK_WORDS = 300_000  # distinct pre-tokens of a block, likewise
SHARD_BYTES = 8 << 20  # text for each shard of words, on which the number of shards depends
LONG_TEXT = 4 << 20  # characters beyond which a text's pre-tokens are listed in stretches
STRETCH = 1 << 19  # pre-tokens that are listed or laid out at once
DOCS_AT_ONCE = 500  # documents that are put together at once
DOCS = -1  # in place of a shard: the row that holds a block's documents and positions


@cache
def splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def pre_tokens(text: str, pattern: str) -> Iterator[list[str]]:
    """All matches of the pre-token pattern, in lists of bounded length where the text is long."""
    if len(text) <= LONG_TEXT:
        yield splitter(pattern).findall(text)
        return
    found = (m[0] for m in splitter(pattern).finditer(text))
    while part := list(islice(found, STRETCH)):
        yield part


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


def give_back_memory() -> None:
    """Arrow of this worker gives freed memory back to the system, as several workers of an executor wait for each other."""
    pa.set_memory_pool(pa.system_memory_pool())


def token_bytes(spark: SparkSession, path: str) -> DataFrame:
    """The token-byte table (token, bytes), as long as the vocabulary."""
    table = ranks(path)
    return spark.createDataFrame(pa.table({"token": pa.array(list(table.values()), pa.int32()), "bytes": pa.array(list(table), pa.binary())}))


def shut(body: bytes) -> bytes:
    """Compressed bytes after their length."""
    return len(body).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(body, asbytes=True)


def opened(value: bytes) -> bytes:
    return pa.decompress(value[8:], decompressed_size=int.from_bytes(value[:8], "little"), codec="zstd", asbytes=True)


def shut_numbers(x: np.ndarray) -> bytes:
    """Numbers below 2^32, all first bytes before all second ones, as high bytes are mostly alike."""
    return shut(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def opened_numbers(value: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(opened(value), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _rows(schema: pa.Schema, **columns: list) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)


def exploded(batches: Iterator[pa.RecordBatch], pattern: str, shards: int, block_tokens: int, block_words: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's (id, text) rows: the positions of all pre-tokens, and the distinct ones by shard.

    A block's distinct words have numbers, most frequent first. Its DOCS row holds the number at
    each position (body) and the count of positions of each document (sizes); for each shard that
    has words, a row holds their numbers, each less the one before, byte lengths (sizes) and bytes (body).
    """
    give_back_memory()
    task = TaskContext.get()
    block = (task.partitionId() if task else 0) << 32
    known: dict[str, int] = {}
    places: list[np.ndarray] = []
    docs, sizes, held = [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        at = np.concatenate(places) if places else np.zeros(0, np.uint32)
        by_count = np.argsort(-np.bincount(at, minlength=len(known)), kind="stable")
        number = np.empty(len(known), np.uint32)
        number[by_count] = np.arange(len(known), dtype=np.uint32)
        yield _rows(schema, key=[2 * block + 1], block=[block], shard=[DOCS], sizes=[shut_numbers(np.array(sizes))], body=[shut_numbers(number[at])], docs=[docs])
        words = [w.encode() for w in known]
        shard = np.fromiter((crc32(w) % shards for w in words), np.int64, len(words))
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
        out: dict[str, list] = {"key": [], "block": [], "shard": [], "numbers": [], "sizes": [], "body": []}
        for mine in np.split(order, cuts[1:]) if len(order) else []:
            mine = mine[np.argsort(number[mine])]
            here, s = [words[i] for i in mine.tolist()], int(shard[mine[0]])
            for c, v in zip(out.values(), (2 * s, block, s, shut_numbers(np.diff(number[mine], prepend=np.uint32(0))), shut_numbers(np.fromiter(map(len, here), np.uint32, len(here))), shut(b"".join(here))), strict=True):
                c.append(v)
        yield _rows(schema, **out)

    for b in batches:
        for i in range(b.num_rows):
            n = 0
            for part in pre_tokens(b.column(1)[i].as_py(), pattern):
                places.append(np.fromiter((known.setdefault(w, len(known)) for w in part), np.uint32, len(part)))
                n += len(part)
            docs.append(b.column(0)[i].as_py())
            sizes.append(n)
            held += n
            if held >= block_tokens or len(known) >= block_words:
                yield from flush()
                known, places, docs, sizes, held, block = {}, [], [], [], 0, block + 1
    if docs:
        yield from flush()


def encoded_words(batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Rows of words with their ids instead: sizes count the ids of each word, body holds them.

    Rows come by shard, so each distinct word of a shard is encoded once for all blocks.
    """
    encode, known, held = encoder(ranks_path, pattern).encode_ordinary, {}, DOCS
    for b in batches:
        at = {name: b.schema.get_field_index(name) for name in ("shard", "sizes", "body")}
        for i in range(b.num_rows):
            row = b.slice(i, 1)
            if (shard := row.column(at["shard"])[0].as_py()) == DOCS:
                yield row
                continue
            if shard != held:
                known, held = {}, shard
            ends = np.cumsum(opened_numbers(row.column(at["sizes"])[0].as_py())).tolist()
            body, start, ids = opened(row.column(at["body"])[0].as_py()), 0, []
            for end in ends:
                w = body[start:end]
                if (one := known.get(w)) is None:
                    one = known[w] = encode(w.decode())
                ids.append(one)
                start = end
            columns = row.columns
            columns[at["sizes"]] = pa.array([shut_numbers(np.fromiter(map(len, ids), np.uint32, len(ids)))], pa.binary())
            columns[at["body"]] = pa.array([shut_numbers(np.fromiter((x for one in ids for x in one), np.uint32))], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, schema=row.schema)


def laid_out(rows: pa.Table, id_col: str) -> pa.Table:
    """A block's documents with their ids, which the positions of their words put in order."""
    give_back_memory()
    shards = rows.column("shard").to_pylist()
    own = shards.index(DOCS)
    parts = [[opened_numbers(rows.column(c)[i].as_py()) for i in range(len(shards)) if i != own] for c in ("numbers", "sizes", "body")]
    number, size, ids = (np.concatenate(p) if p else np.zeros(0, np.uint32) for p in parts)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts[0]])])
    for a, b in zip(starts.tolist(), starts[1:].tolist()):
        number[a:b] = np.cumsum(number[a:b])
    begins, sizes = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    begins[number], sizes[number] = np.cumsum(size, dtype=np.int64) - size, size
    places = opened_numbers(rows.column("body")[own].as_py())
    doc_ends = np.cumsum(opened_numbers(rows.column("sizes")[own].as_py()), dtype=np.int64)
    upto = np.zeros(len(doc_ends) + 1, np.int32)  # where each document's ids end
    out, total = [], 0
    for at in range(0, len(places), STRETCH):
        here = places[at : at + STRETCH]
        n = sizes[here]
        after = np.cumsum(n)
        out.append(ids[np.repeat(begins[here] - (after - n), n) + np.arange(after[-1])].astype(np.int32))
        a, b = np.searchsorted(doc_ends, [at, at + STRETCH], side="right")
        upto[a + 1 : b + 1] = after[doc_ends[a:b] - at - 1] + total
        total += int(after[-1])
    a = np.searchsorted(doc_ends, 0, side="right")
    upto[: a + 1] = 0
    lists = pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate(out) if out else np.zeros(0, np.int32)))
    return pa.table({id_col: rows.column("docs")[own].values, "ids": lists})


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, block_words: int = BLOCK_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, ids array<int>) for every row, null texts as empty ones.

    A task explodes its texts into pre-tokens with positions, block by block; a block's distinct
    pre-tokens go to shards of a hash of the word, which encode each distinct word once for all
    blocks; their ids go back to the block, where positions put them in order. A word thus crosses
    once for each block, not once for each occurrence, so neither a frequent word nor a large group
    of copies loads one task, and no text crosses at all.

    ``df`` gives the same rows to the same tasks when a lost task is run again, as tables do.
    Repeated rows and ids are encoded each; a text longer than a block is a block of its own; an
    empty table gives no rows; other columns are not read.
    """
    rows = df.select(F.col(id_col), text_or_empty(text_col).alias("_t"))
    shards = max(1, (rows.agg(F.sum(F.octet_length("_t"))).head()[0] or 0) // shard_bytes)
    id_type = rows.schema[0].dataType
    spec = T.StructType().add("key", "long").add("block", "long").add("shard", "integer").add("numbers", "binary").add("sizes", "binary").add("body", "binary").add("docs", T.ArrayType(id_type))
    schema = to_arrow_schema(spec)
    sent = rows.mapInArrow(lambda batches: exploded(batches, pattern, shards, block_tokens, block_words, schema), spec)
    back = sent.repartition("key").sortWithinPartitions("shard").mapInArrow(lambda batches: encoded_words(batches, ranks_path, pattern), spec)
    return back.groupBy("block").applyInArrow(lambda table: laid_out(table, id_col), T.StructType().add(id_col, id_type).add("ids", T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with ``out_col``, the bytes of each row's ids.

    The distinct ids of each Arrow batch of rows become rows of their own before it, which meet the
    token-byte table in a join; as long as the vocabulary, that table is broadcast. Exploding and
    joining leave the order of rows within a task, so the batch behind finds its tokens' bytes
    before it and lays them out by position, without a shuffle. Null ids give null bytes and no ids
    give none. An id that the table lacks raises an error.
    """
    kept = [c for c in df.columns if c != out_col]
    schema = df.select(*kept).schema.add(out_col, "binary")
    types, ids_at = to_arrow_schema(schema), kept.index(ids_col)
    rows = df.select(F.struct(*kept).alias("row"), F.lit(None).cast("int").alias("token"))
    spec = T.StructType().add("row", rows.schema["row"].dataType).add("token", "integer")  # either may be null
    rows_schema = to_arrow_schema(spec)
    table = F.broadcast(token_bytes(df.sparkSession, ranks_path)).withColumnRenamed("token", "known")

    def with_distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        for b in batches:
            tokens = b.column(0).flatten()[ids_at].flatten().unique().drop_null().cast(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(tokens), rows_schema.field(0).type), tokens], schema=rows_schema)
            yield pa.RecordBatch.from_arrays(b.columns, schema=rows_schema)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        keys, values, behind = [], [], False
        for b in batches:
            told = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(told, prepend=~told[:1])).tolist()
            for start, end in zip(cuts, [*cuts[1:], len(told)]):
                run = b.slice(start, end - start)
                if told[start]:
                    if run.column(2).null_count:
                        raise ValueError("an id is not in the token-byte table")
                    if behind:
                        keys, values, behind = [], [], False
                    keys.append(run.column(1))
                    values.append(run.column(2))
                    continue
                behind = True
                yield from (laid(run.slice(at, DOCS_AT_ONCE), pa.concat_arrays(keys), pa.concat_arrays(values)) for at in range(0, run.num_rows, DOCS_AT_ONCE)) if keys else (laid(run, None, None),)

    def laid(run: pa.RecordBatch, keys: pa.Array | None, values: pa.Array | None) -> pa.RecordBatch:
        columns = run.column(0).flatten()
        ids = columns[ids_at]
        flat = ids.flatten()
        pieces = values.take(pc.index_in(flat.cast(pa.int32()), value_set=keys)) if len(flat) else pa.array([], pa.binary())
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())]).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), pieces), pa.scalar(b"", pa.binary()))
        return pa.RecordBatch.from_arrays([*columns, pc.if_else(ids.is_valid(), joined, pa.scalar(None, pa.binary()))], schema=types)

    each = rows.mapInArrow(with_distinct, spec)
    met = each.join(table, F.col("token") == F.col("known"), "left").select("row", "token", "bytes")
    return met.mapInArrow(put_together, schema)
